"""Language identification of mixed text.

Code points belong to scripts (ranges); a word's scripts narrow the languages that may own
it to those that were seen in them. Each word gets a log-likelihood per candidate from
hashed character trigrams (word edges included), and a Viterbi pass with a switching
penalty labels every word of a text, so that runs of words become spans of one language. A
text's language is the one that holds most of its letters; the score is its share of them.

The model is trigram counts per language, summed in Spark over a bounded sample of the
labelled rows (at most about `max_rows` rows a language, whole texts); more than
MAX_LANGUAGES languages are an error. It is a table of BUCKETS x languages floats, broadcast at that fixed size.

Null and letterless texts are `und` with score 0. Without any labelled row there is no
language to learn and every text is `und`. Ties go to the language that sorts first. Rows
that repeat an id are scored each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import by_slices, map_arrow, share_of

UND = "und"
BUCKETS = 1 << 18
MAX_LANGUAGES = 512
#: Log-likelihood that a change of language must gain.
SWITCH = 12.0
#: A script belongs to a language if it holds this share of the language's letters.
SCRIPT_SHARE = 0.001
SMOOTH = 0.5
CHUNK = 1 << 20

# First code points of script runs and the script that starts there (0: other).
SCRIPTS = {
    0x0000: "other", 0x0041: "latin", 0x02B0: "other", 0x0370: "greek", 0x0400: "cyrillic", 0x0530: "armenian",
    0x0590: "hebrew", 0x0600: "arabic", 0x0700: "other", 0x0900: "devanagari", 0x0980: "bengali", 0x0A00: "gurmukhi",
    0x0A80: "gujarati", 0x0B00: "other", 0x0B80: "tamil", 0x0C00: "telugu", 0x0C80: "kannada", 0x0D00: "malayalam",
    0x0D80: "sinhala", 0x0E00: "thai", 0x0E80: "lao", 0x0F00: "tibetan", 0x1000: "myanmar", 0x10A0: "georgian",
    0x1100: "hangul", 0x1200: "ethiopic", 0x1380: "other", 0x1780: "khmer", 0x1800: "other", 0x1E00: "latin",
    0x1F00: "greek", 0x2000: "other", 0x2E80: "han", 0x3040: "kana", 0x3100: "other", 0x3130: "hangul",
    0x3190: "other", 0x3400: "han", 0xA000: "other", 0xAC00: "hangul", 0xD7B0: "other", 0xF900: "han",
    0xFB00: "latin", 0xFB1D: "hebrew", 0xFB50: "arabic", 0xFE00: "other", 0xFF21: "latin", 0xFF66: "kana",
    0xFFA0: "hangul", 0xFFE0: "other", 0x20000: "han", 0x32000: "other",
}
SCRIPT_NAMES = sorted(set(SCRIPTS.values()))
_STARTS = np.array(list(SCRIPTS), np.int64)
_SCRIPT_AT = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS.values()], np.int8)
_PLANE = 0x33480  # letters behind it are taken as they are
_TABLES: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: is a letter, lower case, script. Built once per Python worker."""
    if not _TABLES:
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(_PLANE)]
        lower = [c.lower() for c in chars]
        _TABLES.append(np.array([c.isalpha() for c in chars]))
        _TABLES.append(np.array([ord(low) if len(low) == 1 else ord(c) for c, low in zip(chars, lower, strict=True)], np.uint32))
        _TABLES.append(_SCRIPT_AT[np.searchsorted(_STARTS, np.arange(_PLANE), side="right") - 1])
    return _TABLES[0], _TABLES[1], _TABLES[2]


@dataclass
class Words:
    """Words of one text slice: edges in code points, and the buckets of all their trigrams."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # where the trigrams of each word start
    bucket: np.ndarray
    scripts: np.ndarray  # bit set of scripts per word


def words_of(text: str) -> Words:
    is_letter, lower, script = _letters()
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    cp = np.minimum(cp, _PLANE - 1)
    letter = is_letter[cp]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    # Letters of all words in a row, each word followed by one closing mark (0).
    at = np.concatenate([[0], np.cumsum(size + 1)])
    seq = np.zeros(at[-1], np.uint64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    chosen = cp[letter]
    seq[inside] = lower[chosen]
    before = np.concatenate([[np.uint64(0)], seq[:-1]])
    before2 = np.concatenate([[np.uint64(0)], before[:-1]])
    before2[before == 0] = 0
    h = seq * np.uint64(0x9E3779B97F4A7C15) + before * np.uint64(0xC2B2AE3D27D4EB4F) + before2 * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(46)).astype(np.int64)
    bits = np.left_shift(np.uint32(1), script[chosen].astype(np.uint32))
    letter_at = np.concatenate([[0], np.cumsum(size)])[:-1]
    scripts = np.bitwise_or.reduceat(bits, letter_at) if len(size) else np.zeros(0, np.uint32)
    return Words(start, end, at[:-1], bucket, scripts)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Runs of a long text that end behind a non-letter where there is one within reach."""
    at = 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        back = cut
        while back > cut - 1000 and text[back - 1].isalpha():
            back -= 1
        cut = back if back > cut - 1000 else cut
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages) log-likelihoods
    allowed: np.ndarray  # (languages,) bit sets of scripts


def _count(languages: list[str]):
    code = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        scripts = np.zeros((len(languages), 32), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                row = code[lang]
                for _, piece in _pieces(text):
                    words = words_of(piece)
                    counts[row] += np.bincount(words.bucket, minlength=BUCKETS)
                    weight = words.end - words.start
                    for bit in range(len(SCRIPT_NAMES)):
                        scripts[row, bit] += int(weight[(words.scripts >> np.uint32(bit)) & np.uint32(1) == 1].sum())
        for i in range(len(languages)):
            at = np.flatnonzero(counts[i])
            bits = np.flatnonzero(scripts[i])
            yield pa.record_batch(
                [
                    pa.array(np.full(len(at) + len(bits), i), pa.int32()),
                    pa.array(np.concatenate([at, -1 - bits]), pa.int64()),
                    pa.array(np.concatenate([counts[i, at], scripts[i, bits]]), pa.int64()),
                ],
                ["lang", "bucket", "n"],
            )

    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 2_500) -> Model:
    """Learn from at most about `max_rows` rows of each language, chosen by hash of the id."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = (
        rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    )
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values; rows of the others would count as wrong languages")
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.uint32))
    picked = F.lit(False)
    for r in found:
        picked = F.when(F.col(lang_col) == r["lang"], share_of(F.col(id_col), max_rows / r["n"])).otherwise(picked)
    sample = rows.where(picked).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    summed = map_arrow(sample, _count(languages), "lang int, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most languages * (BUCKETS + scripts) rows, whatever the corpus.
    got = summed.toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    grams = got[got.bucket >= 0]
    counts[grams.bucket.to_numpy(), grams.lang.to_numpy()] = grams.n.to_numpy()
    marks = got[got.bucket < 0]
    scripts[-1 - marks.bucket.to_numpy(), marks.lang.to_numpy()] = marks.n.to_numpy()
    kinds = max(1, int((counts.sum(axis=1) > 0).sum()))
    table = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * kinds)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    allowed = ((share >= SCRIPT_SHARE).astype(np.uint32) << np.arange(len(SCRIPT_NAMES), dtype=np.uint32)[:, None]).sum(axis=0).astype(np.uint32)
    return Model(languages, table, allowed)


def word_scores(model: Model, words: Words) -> np.ndarray:
    """(words, languages): summed log-likelihoods; languages outside the word's scripts lose them all."""
    if not len(words.start):
        return np.zeros((0, len(model.languages)), np.float32)
    scores = np.add.reduceat(model.table[words.bucket], words.first, axis=0)
    fits = (words.scripts[:, None] & model.allowed[None, :]) != 0
    fits |= ~fits.any(axis=1)[:, None]  # a script nobody was seen in narrows nothing
    return np.where(fits, scores, np.float32(-1e6))


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word of many texts at once; `sizes` words belong to each text.

    All texts step together: step t handles word t of every text that has one, so the loop
    runs over the longest text and each step is one array operation over the texts.
    """
    labels = np.zeros(len(scores), np.int16)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    order = np.argsort(-sizes, kind="stable")
    start, size = first[order], sizes[order]
    longest = int(size[0]) if len(size) else 0
    if not longest:
        return labels
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t words
    stay = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)
    value = scores[start[: live[0]]]
    final = np.zeros(len(start), np.int16)
    for t in range(1, longest):
        n = live[t]
        if n < len(value):
            final[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        at = start[:n] + t
        top = value.argmax(axis=1)
        floor = value[np.arange(n), top] - switch
        keep = value >= floor[:, None]
        stay[at], best[at] = keep, top
        value = np.where(keep, value, floor[:, None]) + scores[at]
    final[: len(value)] = value.argmax(axis=1)
    state = final
    for t in range(longest - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        now = state[:n]
        labels[at] = now
        if t:
            state[:n] = np.where(stay[at, now], now, best[at])
    return labels


def _spans(words: list[Words], offsets: list[int], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.concatenate([w.start + o for w, o in zip(words, offsets, strict=True)])
    end = np.concatenate([w.end + o for w, o in zip(words, offsets, strict=True)])
    cut = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
    last = np.concatenate([cut[1:], [len(labels)]]) - 1
    return start[cut], end[last], labels[cut]


def _label(broadcast, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        yield from by_slices(batches, lambda batch: _label_batch(batch, model, switch))

    return run


SCHEMA = "id {id}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _label_batch(batch: pa.RecordBatch, model: Model, switch: float) -> pa.RecordBatch:
    many = len(model.languages)
    per_text: list[tuple[list[Words], list[int]]] = []
    scores, sizes = [], []
    for text in batch.column("text").to_pylist():
        words, offsets = [], []
        for offset, piece in _pieces(text or "") if many else ():
            found = words_of(piece)
            if len(found.start):
                scores.append(word_scores(model, found))
                found.bucket = found.first = found.bucket[:0]  # no longer needed
                words.append(found)
                offsets.append(offset)
        per_text.append((words, offsets))
        sizes.append(sum(len(w.start) for w in words))
    labels = viterbi(np.concatenate(scores), np.array(sizes), switch) if scores else np.zeros(0, np.int16)
    langs, shares, spans, at = [], [], [], 0
    for (words, offsets), n in zip(per_text, sizes, strict=True):
        if not n:
            langs.append(UND), shares.append(0.0), spans.append([])
            continue
        own = labels[at : at + n]
        at += n
        letters = np.concatenate([w.end - w.start for w in words])
        held = np.bincount(own, weights=letters, minlength=many)
        top = int(held.argmax())
        langs.append(model.languages[top])
        shares.append(float(held[top] / letters.sum()))
        spans.append([{"start": int(s), "end": int(e), "lang": model.languages[k]} for s, e, k in zip(*_spans(words, offsets, own), strict=True)])
    return pa.record_batch(
        [batch.column("id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, _SPAN)],
        ["id", "lang_pred", "score", "spans"],
    )


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """id, lang_pred, score, spans (code points, runs of words of one language)."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(rows, _label(broadcast, switch), SCHEMA.format(id=kind)).withColumnRenamed("id", id_col)


def _judge(broadcast, switch: float, min_score: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        name = f"c{text_at}"

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = pa.record_batch([pa.nulls(batch.num_rows), batch.column(name)], ["id", "text"])
            got = _label_batch(rows, model, switch)
            good = (np.array(got.column("lang_pred").to_pylist()) != UND) & (got.column("score").to_numpy() >= min_score)
            return batch.filter(pa.array(good))

        yield from by_slices(batches, keep, name)

    return run


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.0, switch: float = SWITCH) -> DataFrame:
    """The rows whose language is found, with all their columns; one pass, no join. `min_score` rejects more."""
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    run = _judge(broadcast, switch, min_score, docs.columns.index(text_col))
    return map_arrow(safe, run, safe.schema).toDF(*docs.columns)
