"""Global row numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import write_table


def row_index(df: DataFrame, *order_by: Column | str, out: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in the given unique order.

    A range sort spreads the rows over all tasks. It is written with the number of the task
    and the place in it, so the count pass and the numbering pass agree even if executors
    are lost between them. Only the per-task counts meet in one place.
    """
    numbered = write_table(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "row-index",
    )
    before = (
        numbered.groupBy("_part")
        .agg(F.count("*").alias("n"))
        .selectExpr(
            "_part",
            "coalesce(sum(n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
        )
    )
    # One row per task of the sort.
    return (
        numbered.join(F.broadcast(before), "_part")
        .withColumn(out, F.col("_before") + F.col("_pos"))
        .drop("_part", "_pos", "_before")
    )
