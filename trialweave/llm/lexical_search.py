"""Ranked lexical search by pipelined term partitioning.

The terms of the items belong to OWNERS term owners, the rarest (heaviest) terms to the
first. Items travel in bundles. A bundle carries sparse accumulators, one whole number per
item and document reached so far, and visits the owners one after the other: a stage is a
cogroup of the bundles with the postings of one owner, which adds that owner's contributions.
After the last owner the best documents are selected.

A term's list can be as long as the table, so both sides are cut into ranges of up to
RANGE_DOCS documents: the key of a cogroup is (range, bundle), and a task holds one bundle
and one owner's postings of one range, whatever the frequency of a term. Documents meet
nothing but the terms of the items; their postings are made in one narrow pass.

After each stage, the k-th best sum so far of an item is a floor: final scores only grow.
With the largest possible contribution of the owners to come (from each term's largest
count and shortest document), an accumulator that cannot reach the floor is given up. That
is exact: a document given up and met again later has a sum below its score, which is below
the floor. Ties go to the smaller document id, so equal sums are kept.

Items come in blocks of about BLOCK_BYTES of text; their terms, weights and floors are all
that the driver holds and broadcasts. More blocks mean more passes over the documents.

Terms are those of `terms`; a null text has none. Items without terms, and documents that
share no term with weight, have no rows. Rows that repeat an item or a document are rows of
their own; null ids rank last among equals. Empty tables give an empty result. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import map_arrow
from trialweave.llm.terms import codes_of, numbered, terms_of, texts_of
from trialweave.session import ship_package, write_table

OWNERS = 4
RANGE_DOCS = 1_024
#: A range closes earlier at so many postings.
RANGE_POSTINGS = 1 << 18
BUNDLE_ITEMS = 256
BLOCK_BYTES = 8 << 20


@dataclass
class Items:
    """The items of a block: their terms as rows (item, term), and the bundle of each item."""

    vocabulary: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray

    @staticmethod
    def of(texts: list[bytes | None]) -> Items:
        terms = [sorted(set(terms_of(t))) for t in texts]
        vocabulary = numbered(w for own in terms for w in own)
        return Items(
            vocabulary,
            np.array([i for i, own in enumerate(terms) for _ in own], np.int64),
            np.array([vocabulary[w] for own in terms for w in own], np.int64),
        )


# ---- postings ------------------------------------------------------------------------------


class _Range:
    """Documents of one range until it closes."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[int] = []
        self.codes: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, words: list[bytes], vocabulary: dict[bytes, int]) -> None:
        codes = codes_of(words, vocabulary)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.codes.append(np.unique(codes[codes > 0], return_counts=True))
        self.held += len(self.codes[-1][0])

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        """Documents are numbered in order of their ids."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, 0 if self.ids[i] is None else self.ids[i]))
        codes = [self.codes[i] for i in order]
        sizes = np.array([self.sizes[i] for i in order], np.int64)
        term = np.concatenate([c for c, _ in codes]).astype(np.int32)
        count = np.concatenate([n for _, n in codes]).astype(np.int64)
        doc = np.repeat(np.arange(len(codes)), [len(c) for c, _ in codes]).astype(np.int32)
        by_term = np.argsort(term, kind="stable")
        term, count, doc = term[by_term], count[by_term], doc[by_term]
        heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        stats = {
            "term": term[heads],
            "df": np.diff(np.append(heads, len(term))),
            "most": np.maximum.reduceat(count, heads) if len(heads) else count,
            "shortest": np.minimum.reduceat(sizes[doc], heads) if len(heads) else count,
        }
        listed = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in stats.values()], list(stats))
        return pa.record_batch(
            [
                pa.array([number], pa.int64()),
                pa.array([[self.ids[i] for i in order]], pa.list_(id_type)),
                pa.array([int((sizes > 0).sum())], pa.int64()),
                pa.array([int(sizes.sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                *[pa.array([x.tobytes()], pa.binary()) for x in (sizes, term, doc, count)],
            ],
            ["range", "ids", "docs", "words", "stats", "sizes", "terms", "at", "counts"],
        )


def _postings(vocabulary, range_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, kind = _Range(), None
        for batch in batches:
            kind = batch.schema.field("id").type
            for doc_id, text in zip(batch.column("id").to_pylist(), texts_of(batch.column("text")), strict=True):
                held.add(doc_id, terms_of(text), vocabulary.value)
                if len(held.ids) >= range_docs or held.held >= RANGE_POSTINGS:
                    yield held.row(number, kind)
                    held, number = _Range(), number + 1
        if held.ids:
            yield held.row(number, kind)

    return run


POSTINGS = (
    "range long, ids array<{kind}>, docs long, words long, stats array<struct<term:long,df:long,most:long,shortest:long>>,"
    " sizes binary, terms binary, at binary, counts binary"
)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], range_docs: int = RANGE_DOCS) -> DataFrame:
    """`docs`: id, text -> one row per document range, written."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = POSTINGS.format(kind=docs.schema["id"].dataType.simpleString())
    return write_table(map_arrow(docs, _postings(shared, range_docs), schema), "postings")


# ---- weights -------------------------------------------------------------------------------


def damping(size: np.ndarray, docs: int, words: int) -> np.ndarray:
    return 50 + (50 * size * docs) // max(words, 1)


def impact(weight: np.ndarray, count: np.ndarray, size: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What a term adds to a document's score."""
    return weight * ((1_000_000_000 * count) // (1_000 * count + 20 * damping(size, docs, words)))


class Plan:
    """Weights, owners and bounds of a block's terms, by term number; what each stage needs."""

    def __init__(self, items: Items, docs: int, words: int, stats: list[tuple[int, int, int, int]], owners: int):
        size = len(items.vocabulary) + 1
        df, most, shortest = (np.zeros(size, np.int64) for _ in range(3))
        for term, d, m, s in stats:
            df[term], most[term], shortest[term] = d, m, s
        self.docs, self.words, self.owners = docs, words, owners
        self.weight = np.array([math.floor(1_000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
        bound = np.where(df > 0, impact(self.weight, np.maximum(most, 1), shortest, docs, words), 0)
        # The first owners hold few postings of rare terms, each further one twice as many.
        order = np.argsort(df, kind="stable")
        share = np.cumsum(df[order]) / max(1, df.sum())
        cuts = [2.0 ** (k - owners + 1) for k in range(owners - 1)]
        self.owner = np.empty(size, np.int64)
        self.owner[order] = np.searchsorted(cuts, share, "left")
        useful = self.weight[items.term] > 0
        item, term = items.item[useful], items.term[useful]
        self.count = int(items.item.max(initial=-1)) + 1
        # The items of each term: items_of[starts[t] : starts[t + 1]].
        by_term = np.argsort(term, kind="stable")
        self.items_of = item[by_term]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
        #: rest[s, i]: the most that the owners behind s can add to item i.
        own = np.zeros((owners, self.count), np.int64)
        np.add.at(own, (self.owner[term], item), bound[term])
        self.rest = own[::-1].cumsum(axis=0)[::-1] - own


# ---- stages --------------------------------------------------------------------------------


def _owned(plan, stage: int, bundle_items: int, with_ids: bool):
    """The postings of one owner, per range and bundle: item, document, what it adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            for k in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[k].as_py(), kind)  # noqa: B023, E731
                term, at = read("terms", np.int32), read("at", np.int32)
                own = (p.owner[term] == stage) & (p.weight[term] > 0)
                term, at = term[own].astype(np.int64), at[own].astype(np.int64)
                adds = impact(p.weight[term], read("counts", np.int64)[own], read("sizes", np.int64)[at], p.docs, p.words)
                bundles = -(-p.count // bundle_items)
                # Bundles whose items hold none of these terms are still visited by the last owner, which selects.
                for b in range(bundles):
                    if bundles > 1:
                        held = np.zeros(len(p.starts), bool)
                        inside = p.items_of // bundle_items == b
                        held[np.repeat(np.arange(len(p.starts) - 1), np.diff(p.starts))[inside]] = True
                        mine = held[term]
                    else:
                        mine = np.ones(len(term), bool)
                    if with_ids or mine.any():
                        yield pa.record_batch(
                            [
                                batch.column("range").slice(k, 1),
                                pa.array([b], pa.int32()),
                                batch.column("ids").slice(k, 1) if with_ids else pa.nulls(1, batch.schema.field("ids").type),
                                *[pa.array([x[mine].tobytes()], pa.binary()) for x in (term, at, adds)],
                            ],
                            ["range", "bundle", "ids", "terms", "at", "adds"],
                        )

    return run


def spread_adds(p: Plan, terms: np.ndarray, at: np.ndarray, adds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Postings as (item, document, what it adds) for the items low .. high - 1."""
    sizes = p.starts[terms + 1] - p.starts[terms]
    from_posting = np.repeat(np.arange(len(terms)), sizes)
    inside = np.arange(len(from_posting)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    item = p.items_of[p.starts[terms][from_posting] + inside]
    mine = (item >= low) & (item < high)
    return item[mine], at[from_posting][mine], adds[from_posting][mine]


def best_of(item: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best documents of each item; ties to the smaller document number."""
    order = np.lexsort((at, -score, item))
    head = np.concatenate([[True], item[order][1:] != item[order][:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return order[place < k]


def visit(p: Plan, stage: int, floors: np.ndarray, bundle: pa.Table, owned: pa.Table, first: int, count: int) -> tuple[np.ndarray, ...]:
    """The bundle's accumulators after one owner: item, document, score; those below the floor are given up."""
    read = lambda t, c, kind: np.frombuffer(t.column(c)[0].as_py(), kind) if t.num_rows else np.zeros(0, kind)
    item, at, score = read(bundle, "items", np.int32), read(bundle, "at", np.int32), read(bundle, "scores", np.int64)
    more = spread_adds(p, *(read(owned, c, np.int64) for c in ("terms", "at", "adds")), first, first + count)
    width = int(max(at.max(initial=-1), more[1].max(initial=-1))) + 1
    key = np.concatenate([(item.astype(np.int64) - first) * width + at, (more[0] - first) * width + more[1]])
    cells = np.zeros(count * width, np.int64)
    np.add.at(cells, key, np.concatenate([score, more[2]]))
    full = np.flatnonzero(cells)
    item, at, score = full // max(width, 1) + first, full % max(width, 1), cells[full]
    stays = score + p.rest[stage][item] >= floors[item]
    return item[stays], at[stays], score[stays]


def _stage(plan, floors, stage: int, bundle_items: int, k: int, last: bool, id_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = plan.value
        key = left if left.num_rows else right
        number, bundle = key.column("range")[0].as_py(), key.column("bundle")[0].as_py()
        first = bundle * bundle_items
        item, at, score = visit(p, stage, floors.value, left, right, first, min(bundle_items, p.count - first))
        top = best_of(item, at, score, k)
        top = top[score[top] >= floors.value[item[top]]]
        if last:
            ids = right.column("ids").combine_chunks()[0].values
            return pa.table(
                {"q": pa.array(item[top], pa.int64()), "id": ids.take(pa.array(at[top])).cast(id_type), "score": pa.array(score[top], pa.int64())}
            )
        tops = pa.StructArray.from_arrays([pa.array(item[top], pa.int64()), pa.array(score[top], pa.int64())], ["q", "score"])
        return pa.table(
            {
                "range": pa.array([number], pa.int64()),
                "bundle": pa.array([bundle], pa.int32()),
                "items": pa.array([item.astype(np.int32).tobytes()], pa.binary()),
                "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                "scores": pa.array([score.tobytes()], pa.binary()),
                "tops": pa.ListArray.from_arrays(pa.array([0, len(tops)], pa.int32()), tops),
            }
        )

    return run


BUNDLES = "range long, bundle int, items binary, at binary, scores binary, tops array<struct<q:long,score:long>>"


def next_floors(bundles: DataFrame, floors: np.ndarray, k: int) -> np.ndarray:
    """The k-th best sum so far of each item that has k documents."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    tops = bundles.select(F.explode("tops").alias("t")).select("t.q", "t.score")
    ranked = tops.withColumn("place", place).where(F.col("place") <= k).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    out = floors.copy()
    for r in ranked.where(F.col("n") >= k).collect():  # one row per item of the block
        out[r["q"]] = max(out[r["q"]], r["s"])
    return out


def _search_block(docs: DataFrame, items: Items, k: int, owners: int, range_docs: int, bundle_items: int) -> DataFrame:
    """q, id, score: the candidates that the last owner leaves, k per item and range at most."""
    spark = docs.sparkSession
    ship_package(spark)
    table = postings(docs, items.vocabulary, range_docs)
    totals = table.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    stats = (
        table.select(F.explode("stats").alias("s"))
        .groupBy("s.term")
        .agg(F.sum("s.df").alias("df"), F.max("s.most").alias("most"), F.min("s.shortest").alias("shortest"))
        .collect()
    )
    made = Plan(items, totals["docs"] or 0, totals["words"] or 0, [tuple(r) for r in stats], owners)
    plan = spark.sparkContext.broadcast(made)
    kind = docs.schema["id"].dataType.simpleString()
    id_type = table.limit(0).select(F.col("ids")).toArrow().schema.field(0).type.value_type
    floors = np.ones(made.count, np.int64)
    bundles = spark.createDataFrame([], BUNDLES)
    for stage in range(owners):
        last = stage == owners - 1
        owned = map_arrow(
            table.select("range", "ids", "sizes", "terms", "at", "counts"),
            _owned(plan, stage, bundle_items, last),
            f"range long, bundle int, ids array<{kind}>, terms binary, at binary, adds binary",
        )
        found = (
            bundles.groupBy("range", "bundle")
            .cogroup(owned.groupBy("range", "bundle"))
            .applyInArrow(
                _stage(plan, spark.sparkContext.broadcast(floors), stage, bundle_items, k, last, id_type),
                f"q long, id {kind}, score long" if last else BUNDLES,
            )
        )
        if last:
            return found
        bundles = write_table(found, "bundles")
        floors = next_floors(bundles, floors, k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    owners: int = OWNERS,
    range_docs: int = RANGE_DOCS,
    bundle_items: int = BUNDLE_ITEMS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k best documents of each item: item, rank, id, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = write_table(
        items.select(F.col(item_col).alias("item"), F.encode(item_text_col, "utf-8").alias("text"), F.monotonically_increasing_id().alias("n")),
        "items",
    )
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    parts = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).orderBy("n").collect()
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(own)], f"q long, item {asked.schema['item'].dataType.simpleString()}")
        found = _search_block(rows, Items.of([r["text"] for r in own]), k, owners, range_docs, bundle_items)
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
        part = ranked.join(F.broadcast(names), "q").select("item", "rank", "id", "score")
        parts = part if parts is None else parts.unionByName(part)
    return parts.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
