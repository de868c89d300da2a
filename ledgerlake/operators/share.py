"""Part-to-whole and whole-partition aggregates.

``SUM(x) OVER ()`` (no PARTITION BY) moves every row into one task. A grand
total is a one-row global aggregate (partial sums per task, one row
shuffled each), so it is computed as such and read back as a scalar
subquery.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    ``one_row`` is a global aggregate (always exactly one row); its columns
    are packed into one struct and read through an uncorrelated scalar
    subquery (``DataFrame.scalar``): evaluated once, no join, no cross
    product in the plan.
    """
    cols = one_row.columns
    s = one_row.select(F.struct(*cols).alias("__scalars")).scalar()
    return df.withColumns({c: s[c] for c in cols})


def with_grand_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``SUM(value) OVER ()`` as column ``out``: a scalar subquery over the same
    aggregate, whose exchange Spark reuses."""
    total = df.agg(F.sum(value).alias(out))
    return attach_scalars(df, total)


def share_pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """ROUND(CAST(part AS DOUBLE) / whole * 100, digits)."""
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return F.round(p.cast("double") / F.nullif(w.cast("double"), F.lit(0.0)) * 100, digits)


def with_partition_total(df: DataFrame, keys: Sequence[str], value: str, out: str,
                         how: str = "sum") -> DataFrame:
    """Add ``SUM/AVG(value) OVER (PARTITION BY keys)`` via a grouped aggregate
    joined back on the keys (null-safe). Same result as the window; the
    aggregate is partial on the map side and skew-tolerant, where the window
    would sort every row of a hot key in one task."""
    fn = {"sum": F.sum, "avg": F.avg}[how]
    agg = df.groupBy(*keys).agg(fn(value).alias(out))
    agg = agg.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], out)
    cond = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        cond = c if cond is None else cond & c
    return df.join(agg, cond, "left").select(*df.columns, out)
