"""Running aggregates with SQL's default window frame.

``SUM(x) OVER (ORDER BY d)`` uses ``RANGE BETWEEN UNBOUNDED PRECEDING AND
CURRENT ROW``: every row sharing ``d`` (its peers - e.g. all brands of one
year) gets the same total. Evaluated literally that is a window without
PARTITION BY, i.e. every row of the input in one task.

Here the frame is rebuilt from a per-key rollup instead:

1. ``groupBy(order keys)`` -> sum / non-null count per key (partial
   aggregation on the map side; output = one row per distinct key, which is
   bounded by the calendar: years or months, not by the data volume);
2. cumulative sums over that small ordered table;
3. broadcast join back on the order keys (null-safe, so a NULL key keeps its
   peer group like the window would). The input is an aggregate (one row per
   group and period); it is checkpointed once so the rollup and the join
   back do not both re-run the fact pipeline. When the input already has one
   row per order key (``unique_keys``) the window runs on it directly.

AVG over the frame is ``sum / count`` of the non-null inputs, as in SQL; the
sum is kept in the input type (exact for decimals). A decimal input gives
Spark's AVG result (scale + 4, half-up), computed with exact integer
division, so the result does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.money import exact_avg


def _finish_avgs(df: DataFrame, src_types: dict, avgs: Mapping[str, str]) -> DataFrame:
    """Turn running ``__rs_<out>`` / ``__rn_<out>`` (sum, count) columns into
    SQL AVG: a ``decimal(p, s)`` input gives Spark's AVG result type
    ``decimal(., s + 4)`` rounded half-up, computed with exact integer
    division; other inputs give a double."""
    for out, src in avgs.items():
        t = src_types[src]
        total, n = f"`__rs_{out}`", f"`__rn_{out}`"
        if isinstance(t, DecimalType):
            units = f"cast({total} * {10 ** t.scale} as decimal(38,0))"
            expr = exact_avg(units, n, t.scale, t.scale + 4)
        else:
            expr = F.col(f"__rs_{out}").cast("double") / F.nullif(F.col(f"__rn_{out}"), F.lit(0))
        df = df.withColumn(out, expr).drop(f"__rs_{out}", f"__rn_{out}")
    return df


def running_by_order(
    df: DataFrame,
    order_cols: Sequence[str],
    sums: Mapping[str, str] | None = None,
    avgs: Mapping[str, str] | None = None,
    partition_cols: Sequence[str] = (),
    unique_keys: bool = False,
) -> DataFrame:
    """Add ``SUM(in) OVER (PARTITION BY p ORDER BY order_cols)`` / AVG columns.

    ``sums`` / ``avgs`` map output column -> input column. Sums are computed
    on the input's own type (exact for decimals); averages follow SQL AVG
    (decimal inputs: scale + 4, half-up, exact; others: double).
    """
    sums = dict(sums or {})
    avgs = dict(avgs or {})
    keys = list(partition_cols) + list(order_cols)
    if unique_keys:
        # ``df`` already has one row per key (it *is* the rollup): no join back
        w = Window.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if partition_cols:
            w = w.partitionBy(*partition_cols)
        cols = [F.sum(src).over(w).alias(out) for out, src in sums.items()]
        for out, src in avgs.items():
            cols += [F.sum(src).over(w).alias(f"__rs_{out}"), F.count(src).over(w).alias(f"__rn_{out}")]
        types = {src: df.schema[src].dataType for src in avgs.values()}
        return _finish_avgs(df.select(*df.columns, *cols), types, avgs)
    aggs = []
    for out, src in sums.items():
        aggs.append(F.sum(src).alias(f"__s_{out}"))
    for out, src in avgs.items():
        aggs.append(F.sum(src).alias(f"__as_{out}"))
        aggs.append(F.count(src).alias(f"__ac_{out}"))
    rollup = df.groupBy(*keys).agg(*aggs)

    # One row per distinct key: a ROWS frame over the rollup equals the
    # RANGE frame over the original rows (peers were merged by the groupBy).
    w = Window.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    # rename the keys: the rollup shares attribute ids with ``df``
    cum_cols = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    for out in sums:
        cum_cols.append(F.sum(f"__s_{out}").over(w).alias(out))
    for out in avgs:
        cum_cols.append(F.sum(f"__as_{out}").over(w).alias(f"__rs_{out}"))
        cum_cols.append(F.sum(f"__ac_{out}").over(w).alias(f"__rn_{out}"))
    cum = _finish_avgs(rollup.select(*cum_cols), {src: df.schema[src].dataType for src in avgs.values()}, avgs)

    cond = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        cond = c if cond is None else cond & c
    joined = df.join(F.broadcast(cum) if not partition_cols else cum, cond, "left")
    return joined.select(*df.columns, *(list(sums) + list(avgs)))
