"""Exact global NTILE / ROW_NUMBER without a single-partition window.

``NTILE(n) OVER (ORDER BY k)`` with no PARTITION BY sorts the whole input in
one task. The same numbers are produced here with a distributed sort:

1. ``repartitionByRange(P, k, tie)`` - range partitioning on the *full*
   ordering (value plus a unique tie-breaker), so one hot value of ``k``
   (e.g. a third of all customers with Frequency = 4) is still cut across
   several partitions; then ``sortWithinPartitions``;
2. position inside the partition from ``monotonically_increasing_id``
   (its low 33 bits count rows of the partition in iteration order);
3. the frame is checkpointed (reliable storage under ``spark.checkpoint.dir``)
   so the range bounds and positions are fixed once, even if an executor is
   lost or the plan is evaluated twice;
4. per-partition row counts (P rows) -> running offsets and the total N
   -> broadcast join (P rows, a proven bound) -> global 1-based index ``i``;
5. ``tile = i <= r(q+1) ? (i-1) div (q+1) + 1 : r + (i-1-r(q+1)) div q + 1``
   with ``q = N div n``, ``r = N mod n`` - the SQL NTILE rule (the first
   ``r`` tiles get one extra row).

The tie-breaker must make the order total (a unique key such as
CustomerID); SQL NTILE is otherwise non-deterministic on ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_LOW33 = (1 << 33) - 1


def _sort_cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c).asc() if isinstance(c, str) else c for c in order]


def global_row_number(df: DataFrame, order: Sequence[Column | str], out: str = "row_number",
                      partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Add a 1-based global row number following ``order`` (must be total).

    ``total``: optional column name for the overall row count N, taken from
    the same per-partition count table (no extra pass).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    order_cols = _sort_cols(order)
    # without a count AQE fits the number of ranges to the data
    ranged = df.repartitionByRange(*order_cols) if partitions is None else df.repartitionByRange(partitions, *order_cols)
    ranged = (
        ranged
        .sortWithinPartitions(*order_cols)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)))
        .checkpoint(eager=True)
    )
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                            F.sum("__n").over(everything).alias("__rows_total"))
    out_df = (
        ranged.join(F.broadcast(offsets), "__pid")  # P rows
        .withColumn(out, F.col("__off") + F.col("__pos") + 1)
    )
    if total:
        out_df = out_df.withColumnRenamed("__rows_total", total)
    return out_df.drop("__pid", "__pos", "__off", "__rows_total")


def ntile_from_index(i: str, total: str, n: int) -> Column:
    """SQL NTILE bucket for 1-based position column ``i`` of ``total`` rows."""
    q = f"({total} div {n})"
    r = f"({total} - {q} * {n})"
    big = f"({r} * ({q} + 1))"
    return F.expr(
        f"cast(case when {q} = 0 then {i} "
        f"when {i} <= {big} then ({i} - 1) div ({q} + 1) + 1 "
        f"else {r} + ({i} - 1 - {big}) div {q} + 1 end as int)"
    )


def global_ntile(df: DataFrame, n: int, order: Sequence[Column | str], out: str,
                 partitions: int | None = None) -> DataFrame:
    """Add ``NTILE(n) OVER (ORDER BY order)`` computed without a global window."""
    numbered = global_row_number(df, order, out="__i", partitions=partitions, total="__N")
    return numbered.withColumn(out, ntile_from_index("__i", "__N", n)).drop("__i", "__N")
