"""Tokens, vocabulary, BIO alignment and span grouping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.markers import MARKERS
from trialweave.functions.tags import bio_spans
from trialweave.functions.text import WHITESPACE, WORD, WS, is_blank, let, running_offsets
from trialweave.operators.ordering import row_index
from trialweave.operators.skew import join_on_hot_key
from trialweave.session import ship_package

# Special tokens, in id order.
CLS, SEP, PAD, UNK = "[CLS]", "[SEP]", "[PAD]", "[UNK]"
SPECIAL_TOKENS = (PAD, UNK, CLS, SEP)

_MARKER = "\\[/?E[12]\\]"
_PIECE = f"{_MARKER}|[{WORD}]+|[{WS}]+|[^{WORD}{WS}]"


def text_pieces(text: Column) -> Column:
    """The text cut into words, single punctuation marks, entity markers and white-space runs."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def token_columns(pieces: Column) -> Column:
    """struct<tokens, offsets> of the pieces that are no white space, between [CLS] and [SEP] at (0, 0); a batch of rows at a time.

    A piece is white space as a whole or not at all, so its first character tells. The
    struct is a column of its own from here on, so that no later plan step makes it again.
    """

    @F.arrow_udf("struct<tokens:array<string>,offsets:array<struct<start:int,end:int>>>")
    def cut(pieces: pa.Array) -> pa.Array:
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.is_in(pc.utf8_slice_codeunits(flat, 0, 1), pa.array(list(WHITESPACE), flat.type))
        kept = ~blank.to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        before, upto = np.concatenate([[0], ends])[bounds[:-1]], np.concatenate([[0], np.cumsum(kept)])
        counts = upto[bounds[1:]] - upto[bounds[:-1]]
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(row)) + 2 * row + 1
        out = np.zeros((2, len(row) + 2 * len(counts)), np.int32)
        out[:, place] = np.stack([starts[kept], ends[kept]]) - before[row]
        lists = np.concatenate([[0], np.cumsum(counts + 2)])
        chosen = np.full(out.shape[1], len(flat))  # [CLS], or [SEP] in the last place of a row
        chosen[lists[1:] - 1] = len(flat) + 1
        chosen[place] = np.flatnonzero(kept)
        tokens = pa.concat_arrays([flat, pa.array([CLS, SEP], flat.type)]).take(pa.array(chosen))
        spans = pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["start", "end"])
        lists = pa.array(lists, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(lists, tokens), pa.ListArray.from_arrays(lists, spans)], ["tokens", "offsets"])

    return cut(pieces)


def located_tokens(pieces: Column) -> Column:
    """array<struct<token, start, end, at>> of the pieces that are no white space; `at` is the piece's index."""
    starts = running_offsets(F.transform(pieces, lambda p: F.length(p)))
    located = F.transform(
        F.arrays_zip(pieces.alias("token"), starts.alias("start")),
        lambda z, i: F.struct(
            z["token"].alias("token"),
            z["start"].alias("start"),
            (z["start"] + F.length(z["token"])).alias("end"),
            i.alias("at"),
        ),
    )
    return F.filter(located, lambda z: ~is_blank(z["token"]))


def word_tokens(text: Column) -> Column:
    """array<struct<token, start, end, at>>: words, single punctuation marks and entity markers."""
    return let(text_pieces(text), lambda pieces: located_tokens(pieces))


def tokenize_offsets(
    df: DataFrame, text: str = "text", max_len: int | None = None, pad: bool = True, truncate: bool = False
) -> DataFrame:
    """G1: add `tokens`, `offsets` and `attention_mask`; [CLS] and [SEP] surround the tokens.

    With `max_len` a long text gives several rows, one per consecutive window (column
    `window`), so that no token is lost; `truncate` keeps the first window only. Specials
    and pads have the offsets (0, 0).
    """
    made = lambda name: F.when(F.col(text).isNotNull(), F.col(f"_t.{name}"))
    whole = (
        df.withColumn("_t", token_columns(text_pieces(F.col(text))))
        .withColumn("tokens", made("tokens"))
        .withColumn("offsets", made("offsets"))
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("offsets")))
        .drop("_t")
    )
    others = [c for c in whole.columns if c not in ("tokens", "offsets", "attention_mask")]
    whole = whole.select(*others, "tokens", "offsets", "attention_mask")
    if max_len is None:
        return whole
    windows = token_windows(whole, max_len, pad=pad)
    return windows.where("window = 0").drop("window") if truncate else windows


def token_windows(
    df: DataFrame, max_len: int, arrays: Sequence[str] = ("tokens", "offsets", "attention_mask"), pad: bool = True
) -> DataFrame:
    """Cut token arrays of equal length into windows of at most `max_len`; adds `window`, from 0.

    Each window repeats the first and the last element, the special tokens. Pads get the
    token [PAD], mask 0 and else what the first element has.
    """
    room = max_len - 2
    body = F.size("tokens") - 2
    last = F.greatest(F.ceil(body / room).cast("int"), F.lit(1)) - 1
    held = F.least(F.lit(room), body - F.col("window") * room)

    def cut(name: str) -> Column:
        first, final = F.slice(name, 1, 1), F.slice(name, -1, 1)
        parts = [first, F.slice(name, F.col("window") * room + 2, held), final]
        if pad:
            filler = {"tokens": F.array(F.lit(PAD)), "attention_mask": F.array(F.lit(0))}.get(name, first)
            parts.append(F.flatten(F.array_repeat(filler, room - held)))
        return F.concat(*parts)

    others = [c for c in df.columns if c not in arrays]
    numbered = df.withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    return numbered.select(*others, "window", *[cut(c).alias(c) for c in arrays])


def token_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return (
        df.select(F.explode(tokens).alias("token"))
        .where(~F.col("token").isin(*SPECIAL_TOKENS, *MARKERS))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def build_vocab(df: DataFrame, tokens: str = "tokens", min_count: int = 1) -> DataFrame:
    """(token, id). Specials and the four markers come first, then count desc, token."""
    reserved = [*SPECIAL_TOKENS, *MARKERS]
    counts = token_counts(df, tokens).where(F.col("n") >= min_count)
    ranked = row_index(counts, F.desc("n"), F.asc("token"), out="r").select(
        "token", (F.col("r") + len(reserved)).alias("id")
    )
    fixed = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(reserved)], "token string, id bigint")
    return fixed.unionByName(ranked)


def encode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    key: Sequence[str],
    tokens: str = "tokens",
    fraction: float = 0.01,
    **join_options: int,
) -> DataFrame:
    """Add `input_ids`; tokens outside the vocabulary become [UNK].

    The vocabulary grows with the corpus: it is broadcast while it is counted to fit. Beyond
    that frequent tokens are hot keys, found on a sample of the rows.
    """
    unknown = SPECIAL_TOKENS.index(UNK)

    def place(rows: DataFrame) -> DataFrame:
        return rows.select(*key, F.posexplode(tokens).alias("pos", "token"))

    sample = place(df.sample(fraction, seed=1))
    ids = (
        join_on_hot_key(place(df), vocab, ["token"], [*key, "pos"], "left", sample, fraction, **join_options)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("ids"))
    )
    return df.join(ids, list(key), "left").withColumn(
        "input_ids", F.coalesce(F.col("ids.id"), F.array().cast("array<bigint>"))
    ).drop("ids")


def _line_tags(starts: list, ends: list, entities: list[tuple]) -> list[str]:
    """One BIO tag per non-special token, by one sweep over tokens and entities (start, end, type) in offset order.

    A token comes behind the entities that begin before its end. The stack holds the
    entities that may still cover a token: later ones on top, ends falling towards it, as an
    entity that ends no later than one behind it can never win again.
    """
    tokens = sorted(((s, e) for s, e in zip(starts, ends, strict=True) if s or e), key=lambda t: t[1])
    waiting, stack, last, before, tags = sorted(entities, key=lambda e: e[0]), [], None, 0, []
    at = 0
    for start, end in tokens:
        while at < len(waiting) and waiting[at][0] < end:
            last = waiting[at]
            while stack and stack[-1][1] <= last[1]:
                stack.pop()
            stack.append(last)
            at += 1
        while stack and stack[-1][1] < end:
            stack.pop()
        if last and last[0] > start:
            tags.append("B-" + last[2])
        elif stack:
            tags.append(("I-" if before > stack[-1][0] else "B-") + stack[-1][2])
        else:
            tags.append("O")
        before = end
    return tags


def _swept_tags(offsets: Column, entities: Column) -> Column:
    """The tags of `_line_tags` for rows with entities, a batch of rows at a time; the others have an empty array."""

    @F.arrow_udf("array<string>")
    def sweep(starts: pa.Array, ends: pa.Array, e_starts: pa.Array, e_ends: pa.Array, types: pa.Array) -> pa.Array:
        token_at, entity_at = starts.offsets.to_pylist(), e_starts.offsets.to_pylist()
        starts, ends = (c.values.to_numpy(zero_copy_only=False).tolist() for c in (starts, ends))
        # The columns of the entities have the same rows, so they share their offsets.
        named = list(zip(*(c.values.to_pylist() for c in (e_starts, e_ends, types)), strict=True))
        tags, bounds = [], [0]
        for i in range(len(token_at) - 1):
            first, behind = entity_at[i : i + 2]
            if first < behind:
                t = slice(*token_at[i : i + 2])
                tags += _line_tags(starts[t], ends[t], named[first:behind])
            bounds.append(len(tags))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tags, pa.string()))

    some = lambda c: F.when(F.size(entities) > 0, c)
    return sweep(*[some(c) for c in (offsets["start"], offsets["end"], entities["start"], entities["end"], entities["type"])])


def align_bio(df: DataFrame, mask_special: bool = False) -> DataFrame:
    """Add `tags`, one BIO tag per token offset, from the `entities` array in start order.

    A later entity overwrites an earlier one. A token inside the entity is `B-` if it is
    the entity's first, else `I-`; a token that straddles the entity start is `B-`; one
    that straddles the end is left as it was. Specials and pads are `O`, or null with
    `mask_special` (the ignore label); they stand at the beginning and behind all tokens.

    Tokens are in text order and disjoint, so the entity has begun exactly when the token
    before ends behind the entity start.
    """
    ship_package(df.sparkSession)
    special = F.lit(None).cast("string") if mask_special else F.lit("O")
    is_special = lambda o: (o["start"] == 0) & (o["end"] == 0)
    offsets = F.col("offsets")
    lead = F.when(is_special(offsets[0]), 1).otherwise(0)
    spread = lambda tags: F.transform(
        offsets, lambda o, i: F.when(is_special(o), special).otherwise(F.coalesce(F.get(tags, i - lead), F.lit("O")))
    )
    plain = spread(F.array().cast("array<string>")) if mask_special else F.array_repeat(F.lit("O"), F.size(offsets))
    swept = df.withColumn("_swept", _swept_tags(offsets, F.col("entities")))
    tags = F.when(F.coalesce(F.size("entities"), F.lit(0)) == 0, plain).otherwise(spread(F.col("_swept")))
    return swept.withColumn("tags", tags).drop("_swept")


def spans_of(df: DataFrame, tags: str = "tags", mode: str = "strict") -> DataFrame:
    """One row per BIO span, with the columns of `df` other than the tags."""
    others = [c for c in df.columns if c != tags]
    return df.select(*others, F.posexplode(bio_spans(F.col(tags), mode)).alias("span_no", "z")).select(
        *others, "span_no", "z.type", "z.start", "z.end"
    )


def group_tokens(tags: Column, scores: Column, offsets: Column, text: Column) -> Column:
    """Token predictions -> array<struct<entity_group, word, start, end, confidence_score>>.

    Neighbouring tokens of one type form a mention, `B-` begins a new one, `O` drops out, and
    so do special tokens, whose offsets are (0, 0). The score is the mean over the tokens;
    the word is the text between first and last.
    """
    real = F.zip_with(tags, offsets, lambda t, o: F.when((o["start"] == 0) & (o["end"] == 0), "O").otherwise(t))

    def grouped(spans: Column, sc: Column, offs: Column) -> Column:
        return F.transform(
            spans,
            lambda z: let(
                F.struct(
                    offs[z["start"]]["start"].alias("s"),
                    offs[z["end"]]["end"].alias("e"),
                    F.slice(sc, z["start"] + 1, z["end"] - z["start"] + 1).alias("part"),
                ),
                lambda m: F.struct(
                    z["type"].alias("entity_group"),
                    F.substr(text, m["s"] + 1, m["e"] - m["s"]).alias("word"),
                    m["s"].alias("start"),
                    m["e"].alias("end"),
                    (F.aggregate(m["part"], F.lit(0.0), lambda a, x: a + x) / F.size(m["part"])).alias(
                        "confidence_score"
                    ),
                ),
            ),
        )

    return let(
        bio_spans(real, "lenient"), lambda spans: let(scores, lambda sc: let(offsets, lambda o: grouped(spans, sc, o)))
    )
