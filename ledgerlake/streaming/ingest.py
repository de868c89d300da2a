"""Landing folder as a file stream.

The reference ingests one landing file per run, then moves it to an
archive folder, and re-reads silver wholesale for the merge. As a
Structured Streaming job:

* ``readStream`` CSV over the landing folder - the stream checkpoint
  remembers which files were consumed (exactly-once file tracking);
  ``cleanSource=archive`` moves consumed files to an archive folder
  (Spark does this lazily, a file may stay until a later batch);
* ``trigger(availableNow=True)``: each run drains what has arrived, then
  stops - a scheduled batch job with streaming bookkeeping;
* ``foreachBatch``: each micro-batch becomes a load of its own, named by the
  stream's id (kept in its checkpoint) and the batch id, and goes through the
  same layers as a batch load. A batch that is run again finds its load in the
  run log and goes on from the layer that hasn't taken it; a new checkpoint is
  a new stream, whose files count unless bronze holds them already. Rows that
  no merge can take (bad lines, no key) are split off to quarantine first.

Checkpoint and archive folders must be on the shared file system the
cluster uses (the caller passes them; tests use scratch folders).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..jobs import medallion, runlog
from ..schemas import DIMENSIONS, REQUIRED
from ..sources import landing


def landing_stream(spark: SparkSession, landing_dir: str, table: str, archive_dir: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    schema = DIMENSIONS[table]["csv"]
    r = spark.readStream.format("csv").options(**landing.csv_options()).schema(landing.csv_read_schema(schema))
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return landing.parse_landing(r.load(landing_dir), schema, required=REQUIRED[table])


def process_batch(spark: SparkSession, root: str, table: str, batch: DataFrame, batch_id: int,
                  now: dt.datetime, stream: str = "") -> str:
    """Bronze, silver and gold of one micro-batch of a stream."""
    log = medallion._paths(root)["log"]
    tag = f"stream:{stream}:{table}:{batch_id}"
    if runlog.load_of(spark, log, "stream", table, tag) is not None:
        return "skipped"  # only a batch whose merge succeeded is done
    if runlog.load_of(spark, log, "bronze", table, tag) is None:
        held = medallion.loaded_files(spark, root, table).select(landing.SOURCE, landing.CHANGED)
        rows = batch.join(held, [landing.SOURCE, landing.CHANGED], "left_anti")
        loaded = medallion.load_rows(spark, root, table, rows, now, source=tag)
        if loaded.status != "success":
            raise ValueError(f"{tag}: bronze checks failed; the stream must not commit the batch")
    for step in (medallion.build_silver, medallion.merge_dimension):
        if step(spark, root, table, now).status == "failure":
            raise ValueError(f"{tag}: {step.__name__} failed its checks; the stream must not commit the batch")
    load = runlog.load_of(spark, log, "bronze", table, tag)
    runlog.append(spark, log, "stream", table, "success", now, load, source=tag)
    return "success"


def stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The id that a stream keeps in its checkpoint across restarts."""
    return json.loads(spark.read.text(f"{checkpoint_location.rstrip('/')}/metadata").first()[0])["id"]


def start_dimension_stream(spark: SparkSession, root: str, table: str, landing_dir: str,
                           checkpoint_location: str, archive_dir: str | None = None,
                           clock: Callable[[], dt.datetime] | None = None,
                           available_now: bool = True) -> StreamingQuery:
    clock = clock or (lambda: dt.datetime.now().replace(microsecond=0))
    stream = landing_stream(spark, landing_dir, table, archive_dir)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        process_batch(spark, root, table, batch, batch_id, clock(), stream_id(spark, checkpoint_location))

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
