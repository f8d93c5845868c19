"""Packing by optimal length buckets.

The histogram of lengths over all documents is the only thing the boundaries depend on. A
dynamic program over it finds the K boundaries with the least padding; batches of a token
budget then form inside each bucket, whose rows are padded to the longest of them. The
histogram is aggregated before it moves, and exact at every size. The driver holds one entry
per distinct length: u different lengths have u * (u - 1) / 2 tokens at least, so 10^10 tokens
have fewer than 141,422. Only a caller who asks for the `grid` has lengths over EXACT rounded up
by less than 1/STEPS for the choice of the boundaries, then at every size. Positions inside
a bucket come from slice counts and a rank within small slices, never from one sort of a
bucket.

A document longer than the budget is a batch of its own. Null text has length 0; empty
documents go to the first bucket and cost its boundary as every other one. Rows that repeat
an id are packed as often as they occur; rows of one length are placed by id, then as they
come. Other columns are not read; an id column that is named like a result comes back as
`<name>_id`. An empty table gives an empty result.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import WORD
from trialweave.session import write_table

#: With more distinct lengths the log says that the search for the boundaries takes a while; it is the same.
LENGTHS = 16_384
#: On the grid lengths up to EXACT stay; longer ones are rounded up to
#: STEPS values per doubling. GRID bounds the number of values up to 2^62.
EXACT = 2_048
STEPS = 128
GRID = EXACT + 1 + STEPS * 52
SLICE_ROWS = 20_000


def round_up(length):
    """The boundary grid as a column: the least grid value that is not below `length`."""
    shift = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") - 0.5)) - 7, F.lit(0))
    unit = F.pow(F.lit(2.0), shift).cast("bigint")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / unit).cast("bigint") * unit)


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` runs of the sorted `lengths` with the least padding.

    `counts` rows of `tokens` real tokens in all pad to the upper bound of their run. The
    cost of a run obeys the quadrangle inequality, so the best split point moves in one
    direction and each layer is solved by divide and conquer: K * U log U steps. Fewer
    buckets are used only where there are fewer lengths. Ties take the smallest split.
    """
    u = len(lengths)
    if u == 0:
        return []
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    t = np.concatenate([[0], np.cumsum(tokens)]).astype(np.float64)
    upper = np.asarray(lengths, np.float64)

    def cost(i, j):  # lengths i .. j-1 padded to lengths[j-1]
        return upper[j - 1] * (n[j] - n[i]) - (t[j] - t[i])

    k = min(buckets, u)
    best = np.full(u + 1, np.inf)
    best[0] = 0.0
    split = np.zeros((k + 1, u + 1), np.int64)
    for layer in range(1, k + 1):
        new = np.full(u + 1, np.inf)
        stack = [(layer, u, layer - 1, u - 1)]
        while stack:
            lo, hi, from_, to = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(from_, min(mid - 1, to) + 1)
            total = best[i] + cost(i, mid)
            at = int(np.argmin(total))
            new[mid], split[layer, mid] = total[at], i[at]
            stack += [(lo, mid - 1, from_, i[at]), (mid + 1, hi, i[at], to)]
        best = new
    bounds, j = [], u
    for layer in range(k, 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(split[layer, j])
    return bounds[::-1]


def length_histogram(lengths: DataFrame) -> DataFrame:
    """length -> (bound on the grid, rows, tokens), over all rows."""
    return lengths.groupBy(round_up(F.col("n_tokens")).alias("bound")).agg(
        F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")
    )


def boundaries(lengths: DataFrame, buckets: int, grid: bool = False) -> list[int]:
    """One row per distinct length reaches the driver, or with `grid` GRID at most."""
    if grid:
        counted = length_histogram(lengths)
    else:
        counted = lengths.groupBy(F.col("n_tokens").alias("bound")).agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    rows = sorted(counted.collect())
    if len(rows) > LENGTHS:
        logging.getLogger(__name__).info("boundaries among %d distinct lengths", len(rows))
    bound, count, tokens = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    return optimal_boundaries(bound, count, tokens, buckets)


RESULTS = ("n_tokens", "bucket", "padded", "batch", "slot")


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias(own_name(id_col)), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"))


def own_name(id_col: str) -> str:
    """An id column that is named like a result comes back as `<name>_id`."""
    return f"{id_col}_id" if id_col in RESULTS else id_col


def pack(
    lengths: DataFrame,
    id_col: str = "doc_id",
    buckets: int = 16,
    budget: int = 65_536,
    slice_rows: int = SLICE_ROWS,
    grid: bool = False,
) -> DataFrame:
    """(id, n_tokens) -> id, n_tokens, bucket, padded, batch, slot.

    A batch of a bucket has floor(budget / padded) rows, one at least; all batches of a
    bucket but the last are full. `lengths` should be a written table, as it is read for
    the histogram, the slice counts and the ranks.
    """
    bounds = boundaries(lengths, buckets, grid)
    if not bounds:
        bounds = [0]
    column = F.lit(len(bounds) - 1)
    for b in range(len(bounds) - 2, -1, -1):
        column = F.when(F.col("n_tokens") <= bounds[b], b).otherwise(column)
    total = lengths.count()
    slices = max(1, -(-total // slice_rows))
    # Rows that repeat an id would share a slice by id alone; the row's place spreads them.
    placed = write_table(
        lengths.select(id_col, "n_tokens")
        .withColumn("bucket", column)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_slice", F.pmod(F.xxhash64(id_col, "_row"), F.lit(slices)).cast("int")),
        "pack-slices",
    )
    # A bound of the grid may be longer than the longest row of its bucket.
    longest = dict(placed.groupBy("bucket").agg(F.max("n_tokens")).collect())
    padded = F.array(*[F.lit(longest.get(i, b)).cast("bigint") for i, b in enumerate(bounds)])
    before = Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket", "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("bucket", "_slice").orderBy("n_tokens", id_col, "_row")
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1))), F.lit(1))
    return (
        placed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["bucket", "_slice"])
        .withColumn("padded", padded[F.col("bucket")])
        .withColumn("_at", F.col("_before") + F.col("_rank"))
        .withColumn("_per", per_batch.cast("bigint"))
        .select(
            id_col,
            "n_tokens",
            "bucket",
            "padded",
            F.expr("_at div _per").alias("batch"),
            F.expr("cast(_at % _per as int)").alias("slot"),
        )
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return pack(write_table(word_lengths(docs, id_col, text_col), "pack-lengths"), own_name(id_col), **options)
