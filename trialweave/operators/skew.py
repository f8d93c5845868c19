"""Joins that stay balanced when one key holds a large share of the rows.

Adaptive execution splits skewed partitions by their size in bytes; it cannot know that a
key with few bytes fans out to many result rows. These helpers split by row count and keep
every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 100_000
MAX_SMALL_ROWS = 10_000
MAX_BROADCAST_ROWS = 500_000


def join_small(
    df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = MAX_SMALL_ROWS
) -> DataFrame:
    """Join with a table that is expected to be label-sized.

    At most max_rows + 1 rows come to the driver. If the table fits, those rows are
    broadcast and `df` is not shuffled; otherwise it is an ordinary join.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df.join(small, list(keys), how)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, small.schema)), list(keys), how)


def hot_blocks(
    df: DataFrame, keys: Sequence[str], block_rows: int | None, fraction: float = 1.0
) -> DataFrame | None:
    """Keys with more than `block_rows` rows -> (keys, _blocks), or None where there is none.

    One counting pass, pre-aggregated before its shuffle; give it a written or checkpointed
    input if that is costly to compute, or rows of a sample together with its `fraction`:
    the blocks only spread the work, so the join result is exact either way. At most
    MAX_HOT_KEYS + 1 rows come to the driver. A table within that bound is broadcast, a
    longer one is joined. `block_rows=None` skips the pass.
    """
    if block_rows is None:
        return None
    blocks = (
        df.groupBy(*keys)
        .agg((F.count("*") / F.lit(fraction)).alias("_n"))
        .where(F.col("_n") > block_rows)
        .select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
    )
    rows = blocks.limit(MAX_HOT_KEYS + 1).collect()
    if not rows:
        return None
    if len(rows) > MAX_HOT_KEYS:
        return blocks
    return F.broadcast(df.sparkSession.createDataFrame(rows, blocks.schema))


def scatter(df: DataFrame, blocks: DataFrame | None, keys: Sequence[str], row_key: Sequence[Column | str]) -> DataFrame:
    """Put each row of a hot key into one block, by hash of `row_key`; adds `_block`."""
    if blocks is None:
        return df.withColumn("_block", F.lit(0))
    block = F.pmod(F.xxhash64(*row_key), F.col("_blocks")).cast("int")
    return df.join(blocks, list(keys), "left").withColumn("_block", F.coalesce(block, F.lit(0))).drop("_blocks")


def replicate(df: DataFrame, blocks: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Give each block of a hot key its own copy of the rows; adds `_block`."""
    if blocks is None:
        return df.withColumn("_block", F.lit(0))
    last = F.coalesce(F.col("_blocks"), F.lit(1)) - 1
    return (
        df.join(blocks, list(keys), "left")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
        .drop("_blocks")
    )


def fits(df: DataFrame, max_rows: int) -> bool:
    """At most `max_rows` rows; the count stops there."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def join_on_hot_key(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    row_key: Sequence[Column | str],
    how: str = "inner",
    sample: DataFrame | None = None,
    fraction: float = 1.0,
    block_rows: int = 1_000_000,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join where `keys` may be hot in `many` and is unique in `one`.

    A `one` side that is counted to fit is broadcast, so that `many` is not shuffled.
    Beyond that the hot keys, found on `sample` (a `fraction` of `many`), are scattered over
    blocks; the merge hint keeps Spark from broadcasting `many` on an estimate that does not
    know how far an explode spreads.
    """
    if fits(one, max_broadcast):
        return many.join(F.broadcast(one), list(keys), how)
    blocks = hot_blocks(many if sample is None else sample, keys, block_rows, fraction)
    return (
        scatter(many, blocks, keys, row_key)
        .hint("merge")
        .join(replicate(one, blocks, keys), [*keys, "_block"], how)
        .drop("_block")
    )
