"""Benchmark decontamination by an FM-index per training shard.

The words of the benchmark items are the alphabet. A window is a run of WINDOW words of an
item, or a whole item of fewer words. Each task cuts its documents into shards of about
SHARD_WORDS words. In a shard, words outside of the alphabet end a run, and runs shorter than
the shortest window, which can hold none, are left out; the rest is indexed: suffix order,
a wavelet matrix over the preceding words, and sampled suffix positions. All windows are
searched backwards through its ranks at once, occurrences are located from the samples, and
overlapping ones are merged into removal spans. No row is shuffled.

Items come in blocks of about BLOCK_BYTES of text, each of which is sent to the tasks, so
what is broadcast has a bound (one longer item is a block of its own). More than one block
means more than one pass over the documents, which are written first; the spans of a
document are then merged again over the blocks.

Words are those of `terms`. Null texts have no words; a document without words has no hit,
an item without words no window. An item is its id: rows that repeat an id are one item, a
null id is named by the empty text. Rows that repeat a document's id are rows of their own.
An empty benchmark finds nothing in every document; an empty document table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import map_arrow
from trialweave.llm.fm_index import FmIndex, ranges
from trialweave.llm.terms import codes_of, numbered, terms_of, texts_of
from trialweave.session import write_table

WINDOW = 10
SHARD_WORDS = 1 << 18
BLOCK_BYTES = 8 << 20

SPANS = "array<struct<start:int,end:int>>"


class Phrases:
    """The distinct windows of some items as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        worded = [(i, words) for i, text in items if (words := terms_of(text))]
        self.vocabulary = numbered(w for _, words in worded for w in words)
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in worded:
            codes = [self.vocabulary[w] for w in words]
            for start in range(max(1, len(codes) - window + 1)):
                owners.setdefault(tuple(codes[start : start + window]), set()).add(item)
        self.owners = [sorted(o) for o in owners.values()]
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.patterns = np.zeros((len(owners), window), np.int64)
        for row, pattern in zip(self.patterns, owners, strict=True):
            row[: len(pattern)] = pattern
        self.shortest = int(self.lengths.min(initial=window))


def index_runs(codes: np.ndarray, shortest: int) -> np.ndarray:
    """Places of the words in runs of at least `shortest` numbered words, and of the 0 behind each run."""
    inside = np.concatenate([[False], codes > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    long = ends - starts >= shortest
    return ranges(starts[long], ends[long] + 1)[0]


def search_shard(codes: list[np.ndarray], phrases: Phrases) -> list[tuple[int, list[dict], list[str]]]:
    """Per document: words hit, removal spans, items."""
    offsets = np.cumsum([0] + [len(c) + 1 for c in codes])
    joined = np.concatenate([np.append(c, 0) for c in codes])
    places = index_runs(joined, phrases.shortest)
    out: list[tuple[int, list[dict], list[str]]] = [(0, [], []) for _ in codes]
    if not len(places) or not phrases.owners:
        return out
    index = FmIndex(joined[places], len(phrases.vocabulary))
    low, high = index.search(phrases.patterns, phrases.lengths)
    found = np.flatnonzero(low < high)
    rows, owner = ranges(low[found], high[found])
    at, phrase = index.locate(rows), found[owner]
    edges = np.zeros(len(places) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + phrases.lengths[phrase], -1)
    covered = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    starts, ends = places[turns[::2]], places[turns[1::2] - 1] + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    held: dict[int, tuple[list[dict], set[str]]] = {}
    for doc, start, end in zip(docs.tolist(), (starts - offsets[docs]).tolist(), (ends - offsets[docs]).tolist(), strict=True):
        held.setdefault(doc, ([], set()))[0].append({"start": start, "end": end})
    hit_docs = np.searchsorted(offsets, places[at], "right") - 1
    for doc, p in np.unique(np.stack([hit_docs, phrase], axis=1), axis=0).tolist():
        held[doc][1].update(phrases.owners[p])
    for doc, (spans, items) in held.items():
        out[doc] = (sum(s["end"] - s["start"] for s in spans), spans, sorted(items))
    return out


def _scan(phrases, columns: list[str], shard_words: int):
    def flush(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        found = search_shard([codes for *_, codes in held], phrases.value)
        kept = [pa.array([row[k] for row in held], schema.field(c).type) for k, c in enumerate(columns)]
        return pa.record_batch(
            [
                *kept,
                pa.array([len(codes) for *_, codes in held], pa.int64()),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([s for _, s, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([i for _, _, i in found], pa.list_(pa.string())),
            ],
            [*columns, "n_words", "n_hit", "spans", "items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, schema = 0, None
        for batch in batches:
            schema = batch.schema
            own = [batch.column(c).to_pylist() for c in columns]
            for n, text in enumerate(texts_of(batch.column("text"))):
                codes = codes_of(terms_of(text), phrases.value.vocabulary)
                held.append((*[c[n] for c in own], codes))
                size += len(codes) + 1
                if size >= shard_words:
                    yield flush(held, schema)
                    held, size = [], 0
        if held:
            yield flush(held, schema)

    return run


def merged(spans: Column) -> Column:
    """Sorted spans, overlapping or touching ones joined."""

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))),
        )
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(
            F.concat(acc, F.array(s))
        )

    return F.aggregate(F.sort_array(spans), F.array().cast(SPANS), add)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, spans (word numbers, end exclusive), items (sorted)."""
    spark = docs.sparkSession
    items = write_table(
        benchmark.select(
            F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.encode(item_text_col, "utf-8").alias("text")
        ),
        "phrases",
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if blocks > 1:
        rows = write_table(rows.withColumn("rid", F.monotonically_increasing_id()), "screened")
    columns = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    parts = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        phrases = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in own], window))
        part = map_arrow(rows, _scan(phrases, columns, shard_words), f"{schema}, n_words long, n_hit long, spans {SPANS}, items array<string>")
        parts = part if parts is None else parts.unionByName(part)
    if blocks > 1:
        parts = (
            parts.groupBy("rid")
            .agg(
                F.first("id").alias("id"),
                F.max("n_words").alias("n_words"),
                merged(F.flatten(F.collect_list("spans"))).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            )
            .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"]))
        )
    return parts.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "spans", "items"
    )
