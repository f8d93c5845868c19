"""Secret scans with one combined deterministic automaton.

All rules are compiled into one minimal automaton (see `automaton`). A text's bytes pass
through it once; at each byte the state says which rules have a match that ends there. A
run of such ends belongs to one greedy match: its first end, read backwards through the
rule's reversed automaton, gives the leftmost beginning behind the rule's last match, and
its last end is the match's end. That yields, per rule, the leftmost greedy non-overlapping
matches of the regex.

The first three rules are the base rules. Matches of any length consume their text; those
whose value is too short are dropped afterwards. Only `hex` counts inside the automaton, as
a run of hex digits holds one match or none; other counters would multiply the states. The
other rules add spans of further well-known formats.

Null counts as empty text and has no span. Offsets are code points, ends exclusive. The
scan is linear in the bytes of a text of any length. Rows that repeat an id are scanned
each. Spans of several rules at one place are all returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.automaton import backward, combined
from trialweave.llm.common import by_slices, map_arrow


@dataclass(frozen=True)
class Rule:
    """`least`: characters that the value (from the first byte at which the rule can end) has at least."""

    name: str
    pattern: str
    any_case: bool = False
    least: int = 0


# The base rules and public key formats.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=14),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN ([A-Z]+ ){0,2}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=20),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", least=10),
    Rule("jwt", r"eyJ[A-Za-z0-9_]+\.eyJ[A-Za-z0-9_]+\.[A-Za-z0-9_\-]+", least=6),
)


class Scanner:
    """Linked transition rows of the combined automaton and of each rule's reversed one."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.forward = combined([(r.pattern, r.any_case) for r in rules])
        self.backward = [backward(r.pattern, r.any_case) for r in rules]
        self._rows = None

    def __getstate__(self):
        return {**self.__dict__, "_rows": None}  # linked rows are rebuilt where they are used

    def start(self) -> list:
        if self._rows is None:
            self._rows = (
                self.forward.rows()[self.forward.start],
                [(b.rows()[b.start], b.dead) for b in self.backward],
            )
        return self._rows[0]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end offset, rules that have a match ending there), one pass over the bytes."""
        row = self.start()
        found = []
        for at, byte in enumerate(data, 1):
            row = row[byte]
            if row[256]:
                found.append((at, row[256]))
        return found

    def beginning(self, rule: int, data: bytes, end: int, bound: int) -> int:
        """The leftmost offset from `bound` on where a match of the rule that ends at `end` can begin, or -1."""
        row, dead = self._rows[1][rule]
        best = -1
        for at in range(end - 1, bound - 1, -1):
            row = row[data[at]]
            if row[257] == dead:
                break
            if row[256]:
                best = at
        return best

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by start, then rule."""
        ends = self.ends(data)
        if not ends:
            return []
        result = []
        for k, rule in enumerate(self.rules):
            free, at = 0, 0
            own = [e for e, mask in ends if mask >> k & 1]
            while at < len(own):
                first, start = own[at], self.beginning(k, data, own[at], free)
                stop = at
                while stop + 1 < len(own) and own[stop + 1] == own[stop] + 1:
                    stop += 1
                while start < 0 and at < stop:
                    at += 1
                    first, start = own[at], self.beginning(k, data, own[at], free)
                if start >= 0:
                    free = own[stop]
                    if free - first + 1 >= rule.least:
                        result.append((k, start, free))
                at = stop + 1
        return sorted(result, key=lambda m: (m[1], m[0]))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """The matches in code points."""
        data = text.encode("utf-8", "replace")
        found = self.matches(data)
        if not found or len(data) == len(text):
            return found
        points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        return [(k, int(points[s]), int(points[e])) for k, s, e in found]


SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _scan(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = broadcast.value
        names = [r.name for r in scanner.rules]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [
                [{"kind": names[k], "start": s, "end": e, "base": names[k] in BASE} for k, s, e in scanner.spans(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            return pa.record_batch([batch.column("id"), pa.array(spans, _SPAN)], ["id", "spans"])

        yield from by_slices(batches, one)

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, spans by start, then rule."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    broadcast = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    return map_arrow(rows, _scan(broadcast), f"id {kind}, spans {SPAN}").withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
