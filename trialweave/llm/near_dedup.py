"""Near duplicates by Order MinHash with verification by banded alignment.

A text is the sequence of its lower-cased words. Its k-mers (two words) are labelled with
their occurrence number; each of SKETCHES hash functions picks the PICKED smallest labelled
k-mers and keeps them in text order. Two texts become candidates if one of their ordered
picks is equal, which is likely for a small edit distance and, unlike a set sketch, not for
the same k-mers in another order. In a text of up to SHORT words too few k-mers survive an
edit for that: it is found by SHORT_SKETCHES picks of SHORT_PICKED k-mers instead. Texts of up
to SHORT_REACH words, which may be linked to a short one, have both.

Texts with the same words are one class and take part once. In each bucket of equal picks
the smallest member is compared with all others. Then the buckets are left that hold several
components: there, each member outside of the bucket's largest component is compared with
all members it is not connected with. Both sides are cut into blocks of bounded size, so a
member is sent once per block of the other side; most buckets have one. A pair that shares
several such buckets is compared in the first of them. So no link between candidates is
lost, and a bucket of thousands of near copies costs a few comparisons each. Pairs are
dropped before the alignment only if lengths or word counts prove that the distance is too
large. A candidate pair is a link if the word edit distance, computed on a band of diagonals
over 32-bit word codes, is at most (1 - similarity) of the longer text (two different words
have equal codes once in 4e9 times). Groups are the connected components of the links; the
row with the smallest id of a group stays.

What moves between tasks are picks and word codes; texts do not. The written codes and picks
go when the groups are known.

A pair that shares no bucket is not found. With k-mer resemblance J that happens with
probability of about (1 - J**PICKED) ** SKETCHES. Replacing words leaves J = t / (2 - t),
where t is s**2 at edit similarity s if the places are random and 2s - 1 if no two are
neighbours, which is the worst case: at s = 0.95 and 0.9 the miss is below 1e-9, at 0.85
3e-6 (worst 2e-5), at the threshold of 0.8 0.1 % (worst 0.5 %). Of two texts of up to SHORT
words at the threshold, the worst case is five words with the middle one replaced: two of
six k-mers are common, a miss of 0.2 %.

Null and empty texts are groups of their own, wordless ones form groups of exact copies; a text of one word has one k-mer, all of it. Null ids rank behind all others. Rows that repeat an id are separate rows.
An empty table gives an empty result. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.llm.common import map_arrow, text_slices
from trialweave.llm.components import components, merge_labels
from trialweave.session import scratch, write_table

K = 2
SKETCHES = 64
PICKED = 3
#: Texts of up to so many words have sketches of their own, and so have those that can be linked to them.
SHORT = 32
SHORT_REACH = 40
SHORT_SKETCHES = 88
SHORT_PICKED = 2
SIMILARITY = 0.8
#: Members of each side that are compared with each other in one task, on average.
BLOCK = 1_024
COUNTERS = 2_048

_WORDS = re.compile(r"\w+")
#: Odd factors, one per hash function.
_FACTORS = np.random.default_rng(20_11).integers(1, 1 << 63, max(SKETCHES, SHORT_SKETCHES), dtype=np.uint64) | np.uint64(1)
_LARGEST = np.uint64((1 << 64) - 1)
_HALF = np.uint64(32)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MAX_CACHE = 400_000


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MAX_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHash()


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def order_sketch(word_hashes: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED, k: int = K) -> np.ndarray:
    """One 64-bit value per hash function: its smallest labelled k-mers, in text order."""
    n = len(word_hashes)
    k = min(k, n)
    kmers = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        kmers = kmers * _ODD + word_hashes[i : i + n - k + 1]
    kmers = _mix(kmers)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(kmers))
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    labelled = _mix(kmers + occurrence * _ODD)
    picked = min(picked, len(kmers))
    out = np.zeros(sketches, np.uint64)
    step = max(1, (1 << 15) // len(kmers))
    for j in range(0, sketches, step):
        factors = _FACTORS[j : min(j + step, sketches), None]
        drawn = labelled[None, :] * factors
        drawn ^= drawn >> _HALF
        each = np.arange(len(drawn))
        places = np.empty((len(drawn), picked), np.int64)
        for p in range(picked):
            places[:, p] = drawn.argmin(axis=1)
            drawn[each, places[:, p]] = _LARGEST
        places.sort(axis=1)
        value = _mix(factors[:, 0] + np.uint64(picked))
        for p in range(picked):
            value = _mix(value * _ODD + kmers[places[:, p]])
        out[j : j + len(drawn)] = value
    return out.astype(np.int64)


def picks_of(word_hashes: np.ndarray) -> np.ndarray:
    """The sketches a text is found by."""
    n = len(word_hashes)
    picks = [order_sketch(word_hashes)] if n > SHORT else []
    if n <= SHORT_REACH:
        picks.insert(0, order_sketch(word_hashes, SHORT_SKETCHES, SHORT_PICKED))
    return np.concatenate(picks)


def codes_of(word_hashes: np.ndarray) -> bytes:
    return (word_hashes >> _HALF).astype(np.uint32).tobytes()


def _sketch(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                sizes, same, picks, codes = [], [], [], []
                for text in part.column(text_col).to_pylist():
                    words = words_of(text)
                    sizes.append(len(words))
                    if not words:
                        # No word holds a zero byte: never the digest of a text with words.
                        same.append(hashlib.sha256(b"\0" + text.encode("utf-8", "replace")).digest()[:16] if text else None)
                        picks.append(None)
                        codes.append(None)
                        continue
                    same.append(hashlib.sha256(" ".join(words).encode("utf-8", "replace")).digest()[:16])
                    hashes = hashes_of(words)
                    picks.append(picks_of(hashes))
                    codes.append(codes_of(hashes))
                kept = [c for c in part.schema.names if c != text_col]
                yield pa.record_batch(
                    [
                        *[part.column(c) for c in kept],
                        pa.array(sizes, pa.int32()),
                        pa.array(same, pa.binary()),
                        pa.array(picks, pa.list_(pa.int64())),
                        pa.array(codes, pa.binary()),
                    ],
                    [*kept, "_words", "_same", "_picks", "_codes"],
                )

    return run


def sketched(rows: DataFrame, text_col: str) -> DataFrame:
    """Written: all columns but the text, and per row the word count, class hash, picks and word codes."""
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in rows.schema if f.name != text_col]
        + [
            T.StructField("_words", T.IntegerType()),
            T.StructField("_same", T.BinaryType()),
            T.StructField("_picks", T.ArrayType(T.LongType())),
            T.StructField("_codes", T.BinaryType()),
        ]
    )
    return write_table(map_arrow(rows, _sketch(text_col), schema), "near-sketch")


def alignment_distance(a: list[int], b: list[int], limit: int) -> int:
    """Word edit distance if it is at most `limit`, else limit + 1.

    Only the diagonals -limit .. limit of the alignment are computed, a whole column of the
    band at a time: bits of two integers say where neighbouring rows differ by +1 and -1.
    The band moves down one row per column. Cells outside count as one edit more than their
    diagonal neighbour, which no path of `limit` edits needs.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > limit:
        return limit + 1
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    while n > head and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[head:n], b[head:m]
    n, m = len(a), len(b)
    if not n:
        return m if m <= limit else limit + 1
    rows: dict[int, int] = {}
    for i, word in enumerate(a):
        rows[word] = rows.get(word, 0) | 1 << i
    full = (1 << 2 * limit + 1) - 1
    middle = 1 << limit
    # Bit k of column j stands for row j - limit + k; rows are counted from 1.
    up, down = full & ~(middle - 1), 0
    value = 0
    for j in range(1, m + 1):
        shift = j - limit - 1
        match = rows.get(b[j - 1], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        if j <= n:
            value += not diagonal & middle
            # The rest of the path makes up for the difference in length at most.
            if value - (m - n) > limit:
                return limit + 1
        else:
            at = n - j + limit
            value += (right_up >> at & 1) - (right_down >> at & 1)
        diagonal = (diagonal & full) >> 1
        up = (right_down | ~(diagonal | right_up)) & full
        down = diagonal & right_up
    return value if value <= limit else limit + 1


def allowed_edits(n_a: int, n_b: int, similarity: float) -> int:
    return int((1 - similarity) * max(n_a, n_b) + 1e-9)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            last: tuple[int, list[int]] | None = None
            for a, ca, cb in zip(*(batch.column(c).to_pylist() for c in ("a", "ca", "cb")), strict=True):
                if last is None or last[0] != a:
                    last = (a, np.frombuffer(ca, np.uint32).tolist())
                one, two = last[1], np.frombuffer(cb, np.uint32).tolist()
                limit = allowed_edits(len(one), len(two), similarity)
                good.append(alignment_distance(one, two, limit) <= limit)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [codes_of(hashes_of(words_of(t))) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("node"), pa.array(codes, pa.binary())], ["node", "codes"])


def word_counters(codes: np.ndarray) -> np.ndarray:
    """How often words occur, in COUNTERS cells; one edit changes two cells by one at most."""
    return np.minimum(np.bincount(codes % COUNTERS, minlength=COUNTERS), 32_767).astype(np.int16)


def link_block(members: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the unconnected members of a block, enough to span its components.

    Members marked `_asked` are compared with those marked `_met`, the ones of the largest
    component first; a pair is left out only if its sides are connected already. Two
    `_minor` members are compared once, from the larger of them. Without these marks, all
    members have them. Of the buckets that both members list in `_open`, the first has to be
    `_bucket`.
    """
    members = members.drop_duplicates("node")
    ids, sizes = members["node"].to_numpy(), members["_words"].to_numpy()
    mark = lambda c: members[c].to_numpy(bool) if c in members else np.ones(len(ids), bool)
    asked, met, minor = mark("_asked"), mark("_met"), mark("_minor")
    codes = [np.frombuffer(x, np.uint32) for x in members["codes"]]
    bags = np.stack([word_counters(x) for x in codes])
    texts: dict[int, list[int]] = {}
    opened = [frozenset(x) for x in members["_open"]] if "_open" in members else None
    here = int(members["_bucket"].iloc[0]) if opened else 0
    parent: dict[int, int] = {}

    def root(label: int) -> int:
        while parent.setdefault(label, label) != label:
            parent[label] = parent[parent[label]]
            label = parent[label]
        return label

    def text(at: int) -> list[int]:
        if at not in texts:
            texts[at] = codes[at].tolist()
        return texts[at]

    labels = members["label"].tolist()
    held = Counter(labels)  # members per component
    links = []
    for x in np.flatnonzero(asked).tolist():
        limit = np.floor((1 - similarity) * np.maximum(sizes, sizes[x]) + 1e-9).astype(np.int64)
        near = met & (np.abs(sizes - sizes[x]) <= limit) & (~minor | (ids < ids[x]))
        near[x] = False
        at = np.flatnonzero(near)
        at = at[np.abs(bags[at] - bags[x]).sum(axis=1, dtype=np.int64) <= 2 * limit[at]]
        for y in sorted(at.tolist(), key=lambda y: -held[root(labels[y])]):
            own, other = root(labels[x]), root(labels[y])
            if own == other or (opened and min(opened[x] & opened[y]) != here):
                continue
            if alignment_distance(text(x), text(y), int(limit[y])) <= limit[y]:
                links.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
                parent[other] = own
                held[own] += held.pop(other)
    return links


def _link_blocks(similarity: float):
    def run(members: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(link_block(members, similarity), columns=["a", "b"]).astype(np.int64)

    return run


def near_links(classes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that span the groups of class representatives, and the components over them.

    `classes`: written, node, _words, _picks. `texts`: node, text.
    """
    return link_classes(classes, map_arrow(texts, _encode, "node long, codes binary"), similarity)


def bucket_members(classes: DataFrame) -> DataFrame:
    """Written: bucket, node, leader, for the buckets that several nodes share."""
    picks = classes.select("node", F.explode(F.array_distinct("_picks")).alias("bucket"))
    shared = picks.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).where("leader <> _last")
    return write_table(picks.join(shared.drop("_last"), "bucket"), "near-members")


def open_cells(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Written: the members of the buckets that hold several components, once per cell of two blocks they meet in."""
    labelled = members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = labelled.groupBy("bucket", "label").agg(F.count("*").alias("_m"))
    opened = (
        held.groupBy("bucket")
        .agg(F.sum("_m").alias("_all"), F.max("_m").alias("_most"), F.max_by("label", F.struct("_m", "label")).alias("_major"))
        .where("_all > _most")
        .select(
            "bucket",
            "_major",
            F.ceil(F.col("_all") / BLOCK).cast("int").alias("_blocks"),
            F.ceil((F.col("_all") - F.col("_most")) / BLOCK).cast("int").alias("_minors"),
        )
    )
    h = F.xxhash64("node")
    rows = (
        labelled.join(opened, "bucket")
        .withColumn("_minor", F.col("label") != F.col("_major"))
        .withColumn("_block", F.pmod(h, F.col("_blocks")).cast("int"))
        .withColumn("_side", F.pmod(h, F.col("_minors")).cast("int"))
    )
    # Everyone meets all blocks of minor members; minor members also go to the other blocks of all.
    pairs = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make)
    met = pairs(F.col("_minors"), lambda i: F.struct(i.alias("_i"), F.col("_block").alias("_j")))
    asked = F.filter(
        pairs(F.col("_blocks"), lambda j: F.struct(F.col("_side").alias("_i"), j.alias("_j"))), lambda c: c["_j"] != F.col("_block")
    )
    cells = F.when(F.col("_minor"), F.concat(met, asked)).otherwise(met)
    return write_table(
        rows.select("bucket", "node", "label", "_minor", "_block", "_side", F.inline(cells)).select(
            "bucket",
            "_i",
            "_j",
            "node",
            "label",
            "_minor",
            (F.col("_minor") & (F.col("_side") == F.col("_i"))).alias("_asked"),
            (F.col("_block") == F.col("_j")).alias("_met"),
        ),
        "near-cells",
    )


def link_classes(classes: DataFrame, codes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """As `near_links`, with the word codes: node, codes."""
    members = bucket_members(classes)
    sizes = classes.select("node", "_words")
    # First the smallest member of a bucket against all others.
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    close = F.abs(F.col("_b") - F.col("_a")) <= F.floor(F.lit(1 - similarity) * F.greatest("_a", "_b") + 1e-9)
    star = pairs.join(sizes.toDF("a", "_a"), "a").join(sizes.toDF("b", "_b"), "b").where(close).select("a", "b")
    both = star.join(codes.toDF("b", "cb"), "b").join(codes.toDF("a", "ca"), "a").select("a", "b", "ca", "cb")
    links = write_table(map_arrow(both, _verify(similarity), "a long, b long"), "near-links")
    labels = components(links)
    # Then whoever is not connected yet.
    cells = open_cells(members, labels)
    if cells.limit(1).count():
        opened = cells.groupBy("node").agg(F.collect_set("bucket").alias("_open"))
        known = opened.join(sizes, "node").join(codes, "node")
        found = (
            cells.join(known, "node")
            .withColumn("_bucket", F.col("bucket"))
            .groupBy("bucket", "_i", "_j")
            .applyInPandas(_link_blocks(similarity), "a long, b long")
        )
        more = write_table(found.distinct(), "near-links")
        links, labels = links.union(more), merge_labels(labels, more)
    return links, labels


def _groups(rows: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame, Column]:
    """`rows`: id, text, _rid. The written sketches; per class: class_id, keep (the row that stays), group_size; the class column."""
    sketches = sketched(rows, text_col)
    with scratch() as keep:
        key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_rid").alias("rid"))
        same = F.coalesce("_same", F.encode(F.concat(F.lit("row "), F.col("_rid")), "utf-8"))
        elected = write_table(
            sketches.groupBy(same.alias("_class")).agg(F.min(key).alias("_first"), F.count("*").alias("_size")), "near-classes"
        )
        worded = sketches.where("_picks IS NOT NULL").withColumnRenamed("_rid", "node")
        representatives = elected.select(F.col("_first.rid").alias("node"))
        classes = write_table(worded.select("node", "_words", "_picks").join(representatives, "node", "left_semi"), "near-representatives")
        _, labels = link_classes(classes, worded.select("node", F.col("_codes").alias("codes")), similarity)
        # class -> component -> the smallest id in it
        placed = (
            elected.withColumn("_rid", F.col("_first.rid"))
            .join(labels.select(F.col("node").alias("_rid"), "label"), "_rid", "left")
            .select("_class", "_first", "_size", F.coalesce("label", "_rid").alias("label"))
        )
        groups = placed.groupBy("label").agg(F.min("_first").alias("_top"), F.sum("_size").alias("group_size"))
        by_class = keep(
            write_table(
                placed.join(groups, "label").select("_class", F.col("_top.id").alias("class_id"), F.col("_top.rid").alias("keep"), "group_size"),
                "near-groups",
            )
        )
    return sketches, by_class, same


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, class_id (id of the row that stays), group_size, kept."""
    rows = docs.select(id_col, text_col).withColumn("_rid", F.monotonically_increasing_id())
    sketches, by_class, same = _groups(rows, id_col, text_col, similarity)
    return (
        sketches.select(id_col, "_rid", same.alias("_class"))
        .join(by_class, "_class")
        .select(id_col, "class_id", "group_size", (F.col("_rid") == F.col("keep")).alias("kept"))
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay, with all their columns."""
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ids, texts = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = write_table(safe.withColumn("_rid", F.monotonically_increasing_id()), "near-rows")
    with scratch() as keep:
        _, by_class, _ = _groups(rows.select(ids, texts, "_rid"), ids, texts, similarity)
        kept = keep(write_table(by_class.select(F.col("keep").alias("_rid")).distinct(), "near-kept"))
    # The rows that stay grow with the table: never broadcast, also while they are few.
    return rows.hint("merge").join(kept, "_rid", "left_semi").select(*safe.columns).toDF(*docs.columns)
