"""Exact top-k inner product search with block-at-a-time pruning.

Vectors are scaled to integers; a component is a term and its value the term's weight.
Vectors are brought into an order in which neighbours are alike: up to CENTERS centers are
fitted on at most SAMPLE vectors, every vector goes to its nearest one, and the table is
sorted by center in ranges. Every BLOCK vectors of one center form a document range with a
forward index (its matrix) and, per term, the largest and the smallest weight. For a query,
the sum of each term's best contribution bounds every score of a block.

The search has two rounds over the same cells of QUERY_ROWS queries and SHARD blocks. Cells
first see the blocks' bounds only. In the first round each query takes its FIRST blocks of
the largest bounds, which gives it a k-th score. In the second, a cell gets the queries and
the matrices of the blocks whose bounds reach the k-th score of one of its queries; a block
that all bounds of a cell exclude is not sent there. Inside a cell a query scores whole
blocks by descending bound until the next bound falls below its k-th score; equal bounds are
still scored, as ties go to the smaller id. One ranking per query merges the cells.

The order only serves the pruning: any order gives the same result, and where vectors have
no groups at all every block is scored. A cell's memory is fixed. Only the centers and the
number of rows reach the driver.

Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id, which could not be named. An empty vector takes part with the score 0.
Components that a shorter vector lacks count as zero; scores beyond a long are held at its
ends. Rows that repeat an id are rows of their own: only the query's own row is left out.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import map_arrow, share_of
from trialweave.session import scratch, ship_package, write_table

SCALE = 1_024
BLOCK = 64
SHARD = 128
QUERY_ROWS = 512
FIRST = 2
#: The order is fitted on at most about so many vectors, with so many centers.
SAMPLE = 8_192
CENTERS = 256
FIT_ROUNDS = 8
#: Below this, sums of products are exact in doubles.
EXACT = 2.0**53

MATRIX = "rows int, dims int, ids binary, rids binary, matrix binary"
BLOCKS = f"{MATRIX}, high binary, low binary"
FOUND = "number long, at long, query_rid long, query_id long, vec_id long, rid long, score long, blocks int"


def scaled(values: list[np.ndarray]) -> np.ndarray:
    """Integer weights, padded with zeros to the longest vector."""
    out = np.zeros((len(values), max(map(len, values), default=0)))
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
    return out


def _usable(v) -> bool:
    return v is not None and None not in v and bool(np.isfinite(np.asarray(v, np.float64)).all())


# ---- order ---------------------------------------------------------------------------------


def fit_centers(sample: np.ndarray, centers: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows; a center without rows stays where it is."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    at = sample[np.linspace(0, len(sample) - 1, min(centers, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(sample, at)
        counts = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        at[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return at


def nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    dims = min(vectors.shape[1], centers.shape[1])
    v, c = vectors[:, :dims], centers[:, :dims]
    return ((c * c).sum(axis=1)[None, :] - 2 * v @ c.T).argmin(axis=1)


def _placed(centers):
    """id, rid, vector -> with the nearest center; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            good = [i for i, (id_, v) in enumerate(zip(batch.column("id").to_pylist(), vectors, strict=True)) if id_ is not None and _usable(v)]
            if good:
                x = np.clip(scaled([vectors[i] for i in good]), -1e150, 1e150)
                kept = batch.take(pa.array(good, pa.int64()))
                yield pa.record_batch([*kept.columns, pa.array(nearest(x, centers.value), pa.int32())], [*kept.schema.names, "center"])

    return run


def in_order(vectors: DataFrame, centers: int, sample: int) -> DataFrame:
    """`vectors`: id, vector -> written: id, rid, vector, center, in ranges of alike vectors."""
    rows = vectors.withColumn("rid", F.monotonically_increasing_id())
    total = vectors.count()
    some = vectors.where(share_of(F.col("id"), sample / max(total, 1))).limit(2 * sample).collect()
    drawn = [r["vector"] for r in sorted((r for r in some if r["id"] is not None and _usable(r["vector"])), key=lambda r: (r["id"], r["vector"]))]
    fitted = fit_centers(np.clip(scaled(drawn), -1e150, 1e150), centers)
    spark = vectors.sparkSession
    kind = vectors.schema["vector"].dataType.simpleString()
    placed = map_arrow(rows, _placed(spark.sparkContext.broadcast(fitted)), f"id long, vector {kind}, rid long, center int")
    # The id splits a center that holds a large share of all rows over several ranges.
    return write_table(placed.repartitionByRange("center", "id", "rid").sortWithinPartitions("center", "id", "rid"), "topk-order")


# ---- blocks --------------------------------------------------------------------------------


def _row(held: list[tuple]) -> dict:
    ids, rids, vectors = zip(*held, strict=True)
    matrix = scaled(list(vectors))
    return {
        "rows": len(ids),
        "dims": matrix.shape[1],
        "ids": np.array(ids, np.int64).tobytes(),
        "rids": np.array(rids, np.int64).tobytes(),
        "matrix": matrix.tobytes(),
        "high": matrix.max(axis=0).tobytes(),
        "low": matrix.min(axis=0).tobytes(),
    }


def _blocks(size: int, by_center: bool):
    """Blocks of up to `size` rows; one center's rows only, unless a block would have under a quarter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            for *row, center in zip(*(batch.column(c).to_pylist() for c in ("id", "rid", "vector", "center")), strict=True):
                if held and (len(held) == size or by_center and center != last and len(held) * 4 >= size):
                    yield _batch([_row(held)])
                    held = []
                held.append(tuple(row))
                last = center
        if held:
            yield _batch([_row(held)])

    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"rows": pa.int32(), "dims": pa.int32()}
    return pa.record_batch({k: pa.array([r[k] for r in rows], kinds.get(k, pa.binary())) for k in rows[0]})


class _Matrix:
    """A block as it was written."""

    def __init__(self, row):
        self.ids, self.rids = (np.frombuffer(row[c], np.int64) for c in ("ids", "rids"))
        self.values = np.frombuffer(row["matrix"]).reshape(row["rows"], row["dims"])
        if "high" in row:
            self.high, self.low = np.frombuffer(row["high"]), np.frombuffer(row["low"])


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond the doubles' integers they are taken in whole numbers."""
    dims = min(queries.shape[1], vectors.shape[1])
    q, v = queries[:, :dims], vectors[:, :dims]
    if not dims or np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * dims < EXACT:
        return q @ v.T
    whole = [[int(x) for x in row] for row in v]
    return np.array([[sum(int(a) * b for a, b in zip(row, other, strict=True)) for other in whole] for row in q], object)


def block_bounds(q: np.ndarray, highs: list[np.ndarray], lows: list[np.ndarray]) -> np.ndarray:
    """(query, block): the most that a vector of the block can score."""
    bounds = np.zeros((len(q), len(highs)))
    for b, (high, low) in enumerate(zip(highs, lows, strict=True)):
        dims = min(q.shape[1], len(high))
        plus, minus = np.maximum(q[:, :dims], 0), np.minimum(q[:, :dims], 0)
        bounds[:, b] = plus @ high[:dims] + minus @ low[:dims]
        # Products are rounded once each and added up: their sizes bound the error.
        bounds[:, b] += 1e-12 * (plus @ np.abs(high[:dims]) - minus @ np.abs(low[:dims]))
    return bounds


# ---- search --------------------------------------------------------------------------------


def search_shard(queries: _Matrix, blocks: list[_Matrix], k: int, floors: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of these blocks for each query, and how many blocks it scored.

    `floors`: k-th scores that the queries have elsewhere.
    """
    q = queries.values
    bounds = block_bounds(q, [b.high for b in blocks], [b.low for b in blocks])
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple]] = [[] for _ in q]
    kth = np.full(len(q), -np.inf) if floors is None else floors.astype(np.float64)
    scored = np.zeros(len(q), np.int64)
    for r in range(len(blocks)):
        own = order[:, r]
        live = np.flatnonzero(bounds[np.arange(len(q)), own] >= kth)
        if not len(live):
            break
        scored[live] += 1
        for b in np.unique(own[live]):
            rows = live[own[live] == b]
            block = blocks[b]
            scores = products(q[rows], block.values)
            for at, row in enumerate(rows):
                hit = np.flatnonzero((scores[at] >= kth[row]) & (block.rids != queries.rids[row]))
                if len(hit):
                    if len(hit) > k:
                        # Smaller ids first among equals, as the k-th place may be shared.
                        hit = hit[np.lexsort((block.ids[hit], -scores[at][hit].astype(np.float64)))]
                        last = scores[at][hit[k - 1]]
                        hit = hit[scores[at][hit] >= last]
                    best[row] = sorted(best[row] + [(-int(scores[at][h]), int(block.ids[h]), int(block.rids[h])) for h in hit])[:k]
                    if len(best[row]) == k:
                        kth[row] = max(kth[row], -best[row][-1][0])
    found = []
    for i, own in enumerate(best):
        head = (i, int(queries.rids[i]), int(queries.ids[i]))
        found += [(*head, v, rid, max(-(1 << 63), min((1 << 63) - 1, -s)), 0) for s, v, rid in own]
        if scored[i]:
            found.append((*head, None, None, None, int(scored[i])))
    return pd.DataFrame(found, columns=["at", "query_rid", "query_id", "vec_id", "rid", "score", "blocks"]).astype("Int64")


def _bound_cell(first: int, floors: bool):
    """The pairs (query, block) of a cell to score: each query's `first` best bounds, or all that reach its floor."""

    def run(queries: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in queries.iterrows() if len(bounds) else ():
            own = _Matrix(row)
            found = block_bounds(own.values, [np.frombuffer(h) for h in bounds["high"]], [np.frombuffer(x) for x in bounds["low"]])
            if floors:
                at, of = np.nonzero(found >= np.frombuffer(row["floors"])[:, None])
            else:
                kept = np.argsort(-found, axis=1, kind="stable")[:, :first]
                at, of = np.repeat(np.arange(len(found)), kept.shape[1]), kept.ravel()
            out.append(pd.DataFrame({"number": row["number"], "at": at, "block": bounds["block"].to_numpy()[of], "bound": found[at, of]}))
        none = pd.DataFrame({"number": [], "at": [], "block": [], "bound": []})
        return pd.concat(out or [none]).astype({"number": "int64", "at": "int64", "block": "int64", "bound": "float64"})

    return run


def _score_cell(k: int):
    """Queries of a group against the blocks of a shard that one of them asks for."""

    def run(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        own = [_Matrix(row) for _, row in blocks.iterrows()]
        parts = [pd.DataFrame({c.split()[0]: pd.array([], "Int64") for c in FOUND.split(", ")})]
        for _, row in queries.iterrows() if own else ():
            floors = np.frombuffer(row["floors"]) if "floors" in row else None
            parts.append(search_shard(_Matrix(row), own, k, floors).assign(number=row["number"])[list(parts[0].columns)])
        return pd.concat(parts).astype("Int64")

    return run


def _with_floors(queries: pd.DataFrame, kth: pd.DataFrame) -> pd.DataFrame:
    """The query group with the k-th scores that its queries have so far."""
    floors = np.full(int(queries["rows"].iloc[0]), -np.inf)
    floors[kth["at"].to_numpy(int)] = kth["score"].to_numpy(float)
    return queries.assign(floors=floors.tobytes())


class _Search:
    """The written blocks and query groups, and the cells between them."""

    def __init__(self, blocks: DataFrame, queries: DataFrame, shard: int, k: int):
        self.blocks, self.queries, self.k = blocks, queries, k
        self.shards = max(1, -(-blocks.count() // shard))
        self.groups = queries.count()

    def to_score(self, queries: DataFrame, first: int, floors: bool) -> DataFrame:
        """number (of the query group), at (row of the group), block, bound."""
        shard = F.pmod(F.xxhash64("block"), F.lit(self.shards)).cast("int")
        left = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        right = self.blocks.select("block", "high", "low", shard.alias("shard")).withColumn(
            "number", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(self.groups, 1) - 1).cast("bigint")))
        )
        return (
            left.groupBy("number", "shard")
            .cogroup(right.groupBy("number", "shard"))
            .applyInPandas(_bound_cell(first, floors), "number long, at long, block long, bound double")
        )

    def score(self, queries: DataFrame, asked: DataFrame) -> DataFrame:
        """FOUND rows for the pairs `asked` (number, block); a block goes only to the groups that ask for it."""
        shard = F.pmod(F.xxhash64("block"), F.lit(self.shards)).cast("int")
        right = self.blocks.join(asked, "block").withColumn("shard", shard)
        left = queries.join(asked.select("number", shard.alias("shard")).distinct(), "number")
        return left.groupBy("number", "shard").cogroup(right.groupBy("number", "shard")).applyInPandas(_score_cell(self.k), FOUND)


def candidates(
    vectors: DataFrame, k: int, every: int, block: int, shard: int, query_rows: int, centers: int = CENTERS, sample: int = SAMPLE, first: int = FIRST
) -> DataFrame:
    """`vectors`: id, vector -> FOUND, written: what the cells found, and rows without vec_id that count scored blocks."""
    ship_package(vectors.sparkSession)
    with scratch() as keep:
        rows = in_order(vectors, centers, sample)
        blocks = write_table(map_arrow(rows, _blocks(block, True), BLOCKS).withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
        asked = rows.where(F.col("id") % every == 0)
        groups = max(1, -(-asked.count() // query_rows))
        asked = asked.repartitionByRange(groups, "center", "id", "rid").sortWithinPartitions("center", "id", "rid")
        made = write_table(map_arrow(asked, _blocks(query_rows, False), BLOCKS).drop("high", "low").withColumn("q", F.monotonically_increasing_id()), "topk-queries")
        names = made.select("q").withColumn("number", (F.row_number().over(Window.orderBy("q")) - 1).cast("bigint"))  # one row per query group
        queries = write_table(made.join(F.broadcast(names), "q").drop("q"), "topk-queries")
        search = _Search(blocks, queries, shard, k)
        place = F.row_number().over(Window.partitionBy("number", "at").orderBy(F.desc("bound"), "block"))
        best = search.to_score(queries, first, False).withColumn("place", place).where(F.col("place") <= first)
        # A group scores all blocks that one of its queries chose.
        chosen = write_table(best.select("number", "block").distinct(), "topk-chosen")
        early = write_table(search.score(queries, chosen), "topk-early")
        ranked = F.row_number().over(Window.partitionBy("number", "at").orderBy(F.desc("score")))
        kth = early.where("vec_id IS NOT NULL").withColumn("place", ranked).where(F.col("place") == k).select("number", "at", "score")
        floored = queries.groupBy("number").cogroup(kth.groupBy("number")).applyInPandas(_with_floors, f"{MATRIX}, number long, floors binary")
        floored = write_table(floored, "topk-floors")
        live = search.to_score(floored, first, True).select("number", "block").distinct().join(chosen, ["number", "block"], "left_anti")
        return keep(write_table(early.unionByName(search.score(floored, live)), "topk-found"))


def top_k(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
    shard: int = SHARD,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Queries: rows whose id is divisible by `every` -> query_id, rank, vec_id, score."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    found = candidates(rows, k, every, block, shard, query_rows).where("vec_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
