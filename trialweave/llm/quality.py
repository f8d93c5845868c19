"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins. Training boosts the tables in
turns: a round visits the features one after the other and adds a shallow tree on that
feature alone to its table. Then the pairs with the largest interaction gain on what is
left get tables over both features' coarse bins, boosted the same way. A score is the
sigmoid of an intercept and the sum of the table entries that a text's bins point at.

Features are shares and means over the whole text; nothing but the text is read. Labels
come from at most about `max_rows` labelled rows, chosen by hash of the id: their ids are
broadcast at that size and their features reach the driver; all tables are of fixed size.

A null or empty text has zeros for features and is scored as such. Without both labels in
the sample the model is the constant share of label 1 (0.5 without any row). Rows that
repeat an id are scored each; a label that is null is not learned from, and of several labels
of an id the largest counts. Equal texts have equal scores. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.boosting import LAMBDA, best_cut, bin_edges, binned, shape_tree, sigmoid
from trialweave.llm.common import by_slices, map_arrow, share_of

FEATURES = (
    "words", "word_length", "long_words", "distinct_words", "distinct_root", "repeated_next", "sentence_ends",
    "upper", "digit", "space", "comma", "stop", "symbol", "pipe", "bang", "quote", "wide", "lines", "distinct_lines", "line_words",
)
BINS = 64
PAIR_BINS = 12
PAIRS = 8
ROUNDS = 120
RATE = 0.15

_CLASS = np.zeros((256, 11), np.float64)
for _name, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b",;:", b".", b"#$%&*@^~_=+<>/\\{}[]`", b"|", b"!?", b"\"'()", bytes(range(128, 256)), b"\n")
):
    _CLASS[list(_chars), _name] = 1


def features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    upper, digit, space, comma, stop, symbol, pipe, bang, quote, wide, breaks = (
        np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    )
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = len(set(words))
    lines = text.split("\n")
    size = len(raw)
    capitals = sum(map(str.isupper, words))
    return [
        np.log1p(len(words)),
        float(lengths.mean()) if len(words) else 0.0,
        float((lengths > 12).mean()) if len(words) else 0.0,
        distinct / n,
        distinct / n**0.5,
        sum(map(eq, words, words[1:])) / n,
        stop / n,
        capitals / n + upper / size,
        digit / size,
        space / size,
        comma / n,
        sum(map(_ends, words)) / n,
        symbol / n,
        pipe / n,
        bang / n,
        quote / n,
        wide / size,
        np.log1p(breaks),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
    ]


def _ends(word: str) -> bool:
    return word[-1] in ".!?"


@dataclass
class Additive:
    """Lookup tables; `pairs` holds (feature, feature, edges, edges, table)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, values[:, f], side="right")]
        for a, b, ea, eb, table in self.pairs:
            total += table[np.searchsorted(ea, values[:, a], side="right"), np.searchsorted(eb, values[:, b], side="right")]
        return sigmoid(total)


def _sums(at: np.ndarray, size: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.bincount(at, weights=w, minlength=size) for w in (g, h, np.ones(len(g))))


def _grid_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts the first feature once and either part once by the second; gain and table."""
    base = g.sum() ** 2 / (h.sum() + LAMBDA)
    best, table = 0.0, np.zeros_like(g)
    for cut in range(g.shape[0] - 1):
        parts = (slice(0, cut + 1), slice(cut + 1, None))
        gain, values = -base, np.zeros_like(g)
        for part in parts:
            gp, hp, np_ = g[part].sum(0), h[part].sum(0), n[part].sum(0)
            more, _ = best_cut(gp, hp, np_)
            gain += gp.sum() ** 2 / (hp.sum() + LAMBDA) + more
            values[part] = shape_tree(gp, hp, np_, 1)
        if gain > best:
            best, table = gain, values
    return best, table


def train(values: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Additive:
    if not len(y):
        return Additive(0.0)
    p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    model = Additive(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return model
    model.edges = [bin_edges(values[:, f], BINS) for f in range(values.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = binned(values, model.edges)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            if len(table) > 1:
                q = sigmoid(margin)
                step = rate * shape_tree(*_sums(bins[:, f], len(table), q - y, q * (1 - q)), 2)
                table += step
                margin += step[bins[:, f]]
    coarse_edges = [bin_edges(values[:, f], PAIR_BINS) for f in range(values.shape[1])]
    coarse = binned(values, coarse_edges)

    def grid(a: int, b: int) -> tuple[np.ndarray, ...]:
        q = sigmoid(margin)
        shape = (len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)
        at = coarse[:, a].astype(np.int64) * shape[1] + coarse[:, b]
        return tuple(s.reshape(shape) for s in _sums(at, shape[0] * shape[1], q - y, q * (1 - q)))

    usable = [f for f, e in enumerate(coarse_edges) if len(e)]
    gains = sorted(((-_grid_tree(*grid(a, b))[0], a, b) for a, b in combinations(usable, 2)))[:pairs]
    chosen = [(a, b, np.zeros((len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1))) for _, a, b in gains]
    for _ in range(rounds // 4):
        for a, b, table in chosen:
            step = rate * _grid_tree(*grid(a, b))[1]
            table += step
            margin += step[coarse[:, a], coarse[:, b]]
    model.pairs = [(a, b, coarse_edges[a], coarse_edges[b], table) for a, b, table in chosen]
    return model


def _feature_batch(batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column("text").to_pylist()
    return np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.array(list(_feature_batch(batch)), pa.list_(pa.float64()))
        return pa.record_batch([batch.column("label"), values], ["label", "values"])

    yield from by_slices(batches, one)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 10_000,
) -> Additive:
    """`labels` holds the ids that may be learned from."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    total = usable.count()
    sample = (
        usable.where(share_of(F.col(id_col), max_rows / max(total, 1)))
        .groupBy(F.col(id_col).alias("_label_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    # About max_rows ids and labels: bounded by the parameter.
    texts = docs.select(F.col(id_col).alias("_label_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "_label_id").select("text", "label")
    got = map_arrow(rows, _features_of, "label int, values array<double>").collect()
    values = np.array([r["values"] for r in got]).reshape(len(got), len(FEATURES))
    y = np.array([r["label"] for r in got], np.float64)
    # Rows arrive in the order of the tasks; sums of floats shall not depend on it.
    order = np.lexsort([y, *values.T])
    return train(values[order], y[order])


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Additive = broadcast.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column("id"), pa.array(model.score(_feature_batch(batch)))], ["id", "score"])

        yield from by_slices(batches, one)

    return run


def score_documents(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score in [0, 1], predicted (1 from the threshold on)."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = map_arrow(rows, _score(docs.sparkSession.sparkContext.broadcast(model)), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
