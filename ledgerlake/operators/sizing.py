"""How many partitions a shuffle of a table needs.

AQE joins small shuffle partitions up to the session's parallelism or its advisory
size, so the rows that one task sorts or hashes grow with the table. Operators that
keep rows in memory state their number of partitions instead: one per
``PARTITION_BYTES`` of the files read, whatever the table holds. The sizes are those
of the file listings; nothing runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITION_BYTES = 4 << 20  # some 200,000 order lines as columns in files
_UNKNOWN = 1 << 50  # Spark's size of a source without statistics


def partitions(*inputs: DataFrame) -> int:
    """Partitions for a shuffle of what ``inputs`` read, 2 at least; the session's number if the size isn't known."""
    total = 0
    for df in inputs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if total >= _UNKNOWN:
        return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(2, -(-total // PARTITION_BYTES))


def with_heads(lines: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """Lines with what the head of their order says, in ``n`` partitions: the heads of
    a partition are hashed and the lines pass by, so that no task sorts its lines."""
    return lines.repartition(n, "OrderID").join(heads.repartition(n, "OrderID").hint("shuffle_hash"), "OrderID", "inner")
