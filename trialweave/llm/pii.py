"""Personal data by candidate gradient boosting.

Three steps per text: generators with high recall propose spans, which overlap; boosted
trees score each proposal by its format and its context; a calibrated threshold per kind
selects the redactions. The spans of the fixed base rules (email, ip, card, phone) are
always kept; the model adds proposals of other formats that no base span touches, such as a
phone number without its plus or an address written with (at), whose parts may have any
length. In a list of numbers, however long, every run of whole digit groups with 7 to 19
digits is proposed. Of overlapping added spans the likeliest stays, among equals the longest,
then the first.

There are no labelled spans, so the classifier learns from the base rules on all documents:
base spans and rewritings of them in their own context are positive; their corruptions (a
wrong check digit, parts out of range) and all other proposals are negative. Every fourth
document calibrates (isotonic) and sets the thresholds. Equal feature rows are counted by
grouped sums, and once more when each feature is cut into its bins; the driver learns from the
distinct binned rows with their counts, so it holds each kind of candidate once, however
often the corpus has it. Without enough of both labels only the base spans remain.

Null counts as empty text and has no span. Offsets are code points, ends exclusive. All
patterns run in linear time on any text. Rows that repeat an id are scanned each. Other
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.boosting import BINS, Boosted, binned, boost_counted, calibrated, counted_edges, isotonic
from trialweave.llm.common import by_slices, map_arrow
from trialweave.session import scratch, write_table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
PRECISION = 0.98
LEAST_LABELS = 40
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[ ()./-]{0,2}[0-9])+")
_AT = re.compile(r"[\[(] ?(?:at|AT|At) ?[\])]")
_DOT = re.compile(r" ?[\[(] ?(?:dot|DOT|Dot) ?[\])] ?")
_HIDDEN = re.compile(r" ?([A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?(?:dot|DOT|Dot) ?[\])] ?)[A-Za-z0-9-]+)+)")
_PIECE = re.compile(r"[^ ]+")
_GROUP = re.compile(r"[0-9]+")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from their @: the local part is the run before it, from the last match on."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() > 6:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split(".")):
                    yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        number = digits(m.group())
        if 16 <= len(number) <= 19 and luhn(number):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in kind and text order."""
    return [(kind, s, e) for kind, find in enumerate((emails, addresses, cards, phones)) for s, e in find(text)]


def proposals(text: str) -> set[tuple[int, int, int]]:
    """Overlapping candidates of every kind that their look does not exclude."""
    found: set[tuple[int, int, int]] = set()
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > 0 and not text[start - 1].isspace() and text[start - 1] not in "<>()[]\"',;:@":
            start -= 1
        while end < len(text) and not text[end].isspace() and text[end] not in "<>()[]\"',;:@":
            end += 1
        if start < at and end > at + 1:
            found.add((EMAIL, start, end))
        at = text.find("@", at + 1)
    for m in _AT.finditer(text) if "(" in text or "[" in text else ():
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        stop = start
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        rest = _HIDDEN.match(text, m.end())
        if start < stop and rest:
            found.add((EMAIL, start, rest.end()))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        held = [0, *accumulate(e - s for s, e in groups)]
        for i, (s, _) in enumerate(groups):
            lead = s - 1 if s and text[s - 1] in "+(" else s
            last = bisect_right(held, held[i] + 19, i)
            for j in range(bisect_left(held, held[i] + 7, i), last):
                n, e = held[j] - held[i], groups[j - 1][1]
                if n <= 15:
                    found.add((PHONE, lead, e))
                if n >= 13:
                    found.add((CARD, s, e))
        for s, e in {m.span()} | {p.span() for p in _PIECE.finditer(text, *m.span()) if p.end() - p.start() >= 7}:
            n = sum("0" <= c <= "9" for c in text[s:e])
            lead = s - 1 if s and text[s - 1] in "+(" else s
            if 7 <= n <= 15:
                found.add((PHONE, lead, e))
            if 13 <= n <= 19:
                found.add((CARD, s, e))
            if text.count(".", s, e) >= 3:
                found.add((IP, s, e))
    return found


CUES = (
    ("mail", "contact", "write"),
    ("ip", "host", "server", "address"),
    ("card", "visa", "credit", "iban", "account"),
    ("phone", "tel", "call", "fax", "mobile", "+"),
)
FEATURES = 30


def _kind_of(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0 if c in ".,;:!?" else 5.0


def describe(kind: int, span: str, left: str, right: str) -> list[float]:
    """Format and context of one candidate; `left` and `right` are up to CONTEXT characters around it."""
    number = digits(span)
    groups = re.split(r"[^0-9]+", span.strip("()+ "))
    sizes = [len(g) for g in groups if g]
    parts = span.split(".")
    octets = [p for p in parts if p.isdigit() and len(p) < 10]
    around = left.lower()
    unhidden = _DOT.sub(".", _AT.sub("@", span).replace(" @", "@").replace("@ ", "@"))
    local, _, domain = unhidden.partition("@")
    tld = domain.rpartition(".")[2]
    return [
        *[float(kind == k) for k in range(4)],
        float(len(span)),
        float(len(number)),
        float(sum(c.isalpha() for c in span)),
        float(len(sizes)),
        float(max(sizes, default=0)),
        float(min(sizes, default=0)),
        float(sizes[-1] if sizes else 0),
        float(sizes[0] if sizes else 0),
        float(span.count(".")),
        float(span.count("-")),
        float(span.count(" ")),
        float(span.count("/")),
        float(span.startswith("+") or span.startswith("00")),
        float("(" in span and ")" in span),
        float(luhn(number)) if 12 < len(number) < 20 else -1.0,
        float(max((int(p) for p in octets), default=-1)) if kind == IP else -1.0,
        float(len(octets) == len(parts) == 4),
        float(len(local)) if domain else -1.0,
        float(len(tld)) if "." in domain and tld.isalpha() else -1.0,
        float(domain.count(".")) if domain else -1.0,
        _kind_of(left[-1:]),
        _kind_of(right[:1]),
        *[float(any(cue in around for cue in CUES[k])) for k in (EMAIL, PHONE, CARD)],
        float(any(c in "$€£%" for c in left[-2:] + right[:2])),
    ]


def _bump(span: str) -> str:
    """The last digit changed."""
    for i in range(len(span) - 1, -1, -1):
        if span[i].isdigit():
            return f"{span[:i]}{(int(span[i]) + 1) % 10}{span[i + 1:]}"
    return span


def rewritings(kind: int, span: str) -> list[tuple[str, float]]:
    """Other ways to write a base span (1) and near misses (0)."""
    number = digits(span)
    if kind == EMAIL:
        local, _, domain = span.partition("@")
        return [(f"{local} (at) {domain}", 1.0), (f"{local} [at] {domain.replace('.', ' [dot] ')}", 1.0), (f"{local}@{domain.split('.')[0]}", 0.0)]
    if kind == IP:
        parts = span.split(".")
        return [(".".join([*parts[:3], str(int(parts[3][-6:]) + 300)]), 0.0), (".".join([*parts, "1"]), 0.0)]
    if kind == CARD:
        fours = [number[i : i + 4] for i in range(0, len(number), 4)]
        return [(".".join(fours), 1.0), ("/".join(fours), 1.0), (_bump(".".join(fours)), 0.0), (_bump(number), 0.0), (_bump("/".join(fours)), 0.0)]
    if len(number) < 10:
        return []
    head, mid, tail = number[-10:-7], number[-7:-4], number[-4:]
    return [
        (f"({head}) {mid}-{tail}", 1.0),
        (f"{head}-{mid}-{tail}", 1.0),
        (f"00{number[:-10]} {head} {mid} {tail}", 1.0),
        (number[-10:], 0.0),
        (f"{head}{mid}/{tail}", 0.0),
        (f"{number[-8:-6]}/{number[-6:-4]}/{tail}", 0.0),
    ]


class Covered:
    """Stretches of a text that are taken, merged, so that a look-up is a binary search."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1:]):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s), self.ends.append(e)

    def touches(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start

    def add(self, start: int, end: int) -> None:
        """A span that touches nothing."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start), self.ends.insert(at, end)


def training_rows(text: str) -> list[tuple[list[float], float]]:
    base = base_spans(text)
    rows = []
    around = lambda s, e: (text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT])
    for kind, s, e in base:
        left, right = around(s, e)
        rows.append((describe(kind, text[s:e], left, right), 1.0))
        rows += [(describe(kind, other, left, right), y) for other, y in rewritings(kind, text[s:e])]
    covered = Covered(base)
    for kind, s, e in sorted(proposals(text)):
        if not covered.touches(s, e):
            rows.append((describe(kind, text[s:e], *around(s, e)), 0.0))
    return rows


@dataclass
class Detector:
    trees: Boosted | None
    steps: tuple[np.ndarray, np.ndarray]
    thresholds: list[float]  # per kind; above 1: nothing of it is added


def _train_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        folds, values, labels = [], [], []
        for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            for v, y in training_rows(text or ""):
                folds.append(fold), values.append(v), labels.append(y)
        return pa.record_batch([pa.array(folds, pa.int32()), pa.array(values, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["fold", "values", "y"])

    yield from by_slices(batches, one)


def _binned_rows(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.array(batch.column("values").to_pylist())
                bins = binned(values, edges).astype(np.uint8)
                kinds = pa.array(values[:, : len(KINDS)].argmax(axis=1).astype(np.int32))
                rows = [kinds, pa.array([row.tobytes() for row in bins], pa.binary())]
                yield pa.record_batch([*rows, *(batch.column(c) for c in ("held", "y", "n"))], ["kind", "bins", "held", "y", "n"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """Learn on all texts, every fourth of which, by hash of the id, calibrates."""
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(4)).cast("int")
    rows = map_arrow(docs.select(F.col(text_col).alias("text"), fold.alias("fold")), _train_on, "fold int, values array<double>, y double")
    with scratch():
        counted = write_table(rows.groupBy((F.col("fold") == 0).alias("held"), "values", "y").agg(F.count("*").alias("n")), "pii-rows")
        train = counted.where("NOT held").select(F.posexplode("values").alias("f", "v"), "n")
        seen = train.groupBy("f", "v").agg(F.sum("n").alias("n")).orderBy("f", "v").toPandas()
        edges = [counted_edges(own["v"].to_numpy(), own["n"].to_numpy(), BINS) for own in (seen[seen["f"] == f] for f in range(FEATURES))]
        kinds = map_arrow(counted, _binned_rows(edges), "kind int, bins binary, held boolean, y double, n long")
        got = kinds.groupBy("held", "kind", "bins", "y").agg(F.sum("n").alias("n")).orderBy("held", "kind", "bins", "y").toPandas()
    none = Detector(None, (np.zeros(0), np.zeros(0)), [2.0] * 4)
    if got["n"].sum() < 2 * LEAST_LABELS:
        return none
    y, n, held = got["y"].to_numpy(), got["n"].to_numpy(float), got["held"].to_numpy(bool)
    if min((y * n)[~held].sum(), ((1 - y) * n)[~held].sum()) < LEAST_LABELS or not held.any():
        return none
    bins = np.frombuffer(b"".join(got["bins"]), np.uint8).reshape(len(got), FEATURES)
    trees = boost_counted(bins[~held], y[~held], n[~held], edges)
    margin = trees.margin_of_bins(bins[held])
    kind, y, n = got["kind"].to_numpy()[held], y[held], n[held]
    steps = isotonic(margin, y, n)
    p = calibrated(steps, margin)
    thresholds = []
    for k in range(len(KINDS)):
        thresholds.append(2.0)
        for t in np.unique(p[kind == k])[::-1]:
            chosen = (kind == k) & (p >= t)
            if np.average(y[chosen], weights=n[chosen]) < PRECISION:
                break
            thresholds[-1] = float(t)
    return Detector(trees, steps, thresholds)


def spans_of(texts: list[str | None], detector: Detector) -> list[list[tuple[int, int, int, bool, float]]]:
    """Per text: (kind, start, end, is base, probability), by kind and start."""
    results, pending, values = [], [], []
    for row, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        results.append([(k, s, e, True, 1.0) for k, s, e in base])
        if detector.trees is not None:
            covered = Covered(base)
            for kind, s, e in sorted(proposals(text)):
                if detector.thresholds[kind] <= 1 and not covered.touches(s, e):
                    pending.append((row, kind, s, e))
                    values.append(describe(kind, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]))
    if pending:
        p = calibrated(detector.steps, detector.trees.margin(np.array(values)))
        taken: dict[int, Covered] = {}
        # The likelier one of overlapping proposals wins, then the longer, then the first.
        for at in sorted(range(len(pending)), key=lambda i: (-p[i], pending[i][2] - pending[i][3], pending[i])):
            row, kind, s, e = pending[at]
            if p[at] >= detector.thresholds[kind] and not taken.setdefault(row, Covered()).touches(s, e):
                taken[row].add(s, e)
                results[row].append((kind, s, e, False, float(p[at])))
    return [sorted(r) for r in results]


SPAN = "array<struct<kind:string,start:long,end:long,base:boolean,probability:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))


def _scan(broadcast, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector: Detector = broadcast.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            found = spans_of(texts, detector)
            spans = [[dict(zip(("kind", "start", "end", "base", "probability"), (KINDS[k], *rest), strict=True)) for k, *rest in row] for row in found]
            columns = [batch.column("id"), pa.array(spans, _SPAN)]
            if redact:
                columns.append(pa.array([None if t is None else _redacted(t, row) for t, row in zip(texts, found, strict=True)], pa.string()))
            return pa.record_batch(columns, ["id", "spans", "redacted"][: len(columns)])

        yield from by_slices(batches, one)

    return run


def _redacted(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for kind, s, e, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """id, spans (by kind, then start) and, if asked for, the text with every span replaced by its kind."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, spans {SPAN}" + (", redacted string" if redact else "")
    return map_arrow(rows, _scan(docs.sparkSession.sparkContext.broadcast(detector), redact), schema).withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
