"""Two exact COUNT(DISTINCT)s per group beside other aggregates, without Expand.

Spark plans several distinct counts by writing every input row once per count
(Expand) and shuffling all of the copies. Here the rows are reduced level by level:

1. one of the rows of each (keys, first) is marked; it stands for the value. If the
   input is partitioned by ``first`` already - order lines joined or bucketed by
   order - this level moves nothing, and a task holds one sort, which spills; a
   hash table of (keys, first, second) before it would hold nearly every row again;
2. one row per (keys, second): the marks are summed, the other aggregates taken.
   A hot key is spread over its second values, and in the first level over its firsts
   (rows without one by their second value);
3. one row per keys: sum of marks = distinct firsts, rows = distinct seconds.

Both shuffles have as many partitions as the input's size asks for (``sizing``), so
what a task hashes doesn't grow with the table.

NULL values of either column are counted by none, as in SQL, and their rows
take part in the other aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import partitions

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def two_distinct_counts(df: DataFrame, keys: Sequence[str], first: tuple[str, str], second: tuple[str, str],
                        aggs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``keys``, COUNT(DISTINCT first[0]) AS first[1], COUNT(DISTINCT second[0]) AS
    second[1], and ``aggs``: name -> ("sum" | "min" | "max", column)."""
    (a, n_a), (b, n_b) = first, second
    merged = [MERGE[how](name).alias(name) for name, (how, _) in aggs.items()]
    rows = df.select(*keys, a, b, *[c.alias(name) for name, (_, c) in aggs.items()], F.when(F.col(a).isNull(), F.hash(b)).alias("__spread"))
    mark = F.row_number().over(Window.partitionBy(*keys, a, "__spread").orderBy(b)) == 1
    rows = rows.withColumn(n_a, F.when(F.col(a).isNotNull() & mark, 1).otherwise(0))
    n = partitions(df)
    rows = rows.repartition(n, *keys, b).groupBy(*keys, b).agg(F.sum(n_a).alias(n_a), *merged)
    return rows.repartition(n, *keys).groupBy(*keys).agg(F.sum(n_a).alias(n_a), F.count(b).alias(n_b), *merged)
