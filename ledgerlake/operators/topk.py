"""Top-k *with ties* (``RANK() OVER (ORDER BY v DESC) <= k``) without a global window.

RANK <= k holds exactly for rows whose value is >= the k-th largest value
(counting duplicates), and a row's rank is 1 + the number of rows with a larger
value. Both follow from the k largest values alone: every value larger than a
surviving one is among them. So:

1. the k largest values, as one array: ``orderBy(v desc).limit(k)`` is planned as
   TakeOrderedAndProject (each task keeps k values), read as a scalar subquery;
2. a row stays if its value is >= the least of them, and its rank is one more
   than how many of them are larger. However many rows tie at the k-th value,
   none of them moves.

Nothing runs while the plan is built. The subquery and the rows read the same
aggregate; its exchange is planned once and reused.

NULL values sort last in ``DESC`` (Spark and SQL agree) and only reach the
result when fewer than k non-null rows exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .share import attach_scalars


def top_k_with_ties(df: DataFrame, value: str, k: int, rank_col: str) -> DataFrame:
    """Rows of ``df`` whose ``RANK() OVER (ORDER BY value DESC)`` is <= k."""
    largest = df.select(value).orderBy(F.col(value).desc_nulls_last()).limit(k).agg(F.collect_list(value).alias("__top"))  # at most k values
    top, v = F.col("__top"), F.col(value)
    # a NULL stands behind all values; with fewer than k of them every row ranks within k
    larger = F.when(v.isNull(), F.size(top)).otherwise(F.size(F.filter(top, lambda x: x > v)))
    ranked = attach_scalars(df, largest).where((v >= F.array_min(top)) | (F.size(top) < k))
    return ranked.withColumn(rank_col, (larger + 1).cast("int")).drop("__top")
