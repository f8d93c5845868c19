import random
import time

import pytest
from pyspark.sql import functions as F

from trialweave.functions.tags import argmax, base_label, bio_spans, drop_ignored, softmax_confidence
from trialweave.operators import tokens

ENT = "array<struct<id:string,type:string,start:bigint,end:bigint,text:string>>"


def test_tokens_cover_the_text(spark):
    text = "Café-bar, 38.5°C  \U0001f600 a_b [E1]x[/E1]"
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(tokens.word_tokens(F.col("t")))).collect()
    assert [r.token for r in got] == ["Café", "-", "bar", ",", "38", ".", "5", "°", "C", "\U0001f600", "a_b", "[E1]", "x", "[/E1]"]
    assert all(text[r.start : r.end] == r.token for r in got)


def test_truncation_padding_and_mask(spark):
    df = spark.createDataFrame([(" a b c d e f",), ("a",), ("",)], "text string")
    got = tokens.tokenize_offsets(df, max_len=5, truncate=True).collect()
    assert [r.tokens for r in got] == [
        ["[CLS]", "a", "b", "c", "[SEP]"],
        ["[CLS]", "a", "[SEP]", "[PAD]", "[PAD]"],
        ["[CLS]", "[SEP]", "[PAD]", "[PAD]", "[PAD]"],
    ]
    assert got[0].offsets[1:4] == [(1, 2), (3, 4), (5, 6)] and got[1].offsets[2] == (0, 0)
    assert [sum(r.attention_mask) for r in got] == [5, 3, 2]
    assert [len(r.tokens) for r in tokens.tokenize_offsets(df, max_len=None).collect()] == [8, 3, 2]


def test_windows_lose_no_token(spark):
    df = spark.createDataFrame([(0, " ".join("abcdefgh")), (1, "a b c"), (2, "")], "k int, text string")
    got = tokens.tokenize_offsets(df, max_len=5).orderBy("k", "window").collect()
    assert [(r.k, r.window, r.tokens) for r in got] == [
        (0, 0, ["[CLS]", "a", "b", "c", "[SEP]"]),
        (0, 1, ["[CLS]", "d", "e", "f", "[SEP]"]),
        (0, 2, ["[CLS]", "g", "h", "[SEP]", "[PAD]"]),
        (1, 0, ["[CLS]", "a", "b", "c", "[SEP]"]),
        (2, 0, ["[CLS]", "[SEP]", "[PAD]", "[PAD]", "[PAD]"]),
    ]
    assert got[2].offsets == [(0, 0), (12, 13), (14, 15), (0, 0), (0, 0)] and got[2].attention_mask == [1, 1, 1, 1, 0]
    plain = tokens.tokenize_offsets(df, max_len=5, pad=False).where("k = 0 AND window = 2").first()
    assert plain.tokens == ["[CLS]", "g", "h", "[SEP]"]
    # Tags are set before the cut, so an entity goes on in the next window.
    whole = tokens.tokenize_offsets(df.where("k = 0")).withColumn("entities", F.array(F.struct(F.lit("T").alias("id"), F.lit("A").alias("type"), F.lit(2).alias("start"), F.lit(9).alias("end"), F.lit("").alias("text"))))
    cut = tokens.token_windows(tokens.align_bio(whole), 5, ("tokens", "offsets", "attention_mask", "tags")).orderBy("window").collect()
    assert [r.tags for r in cut] == [["O", "O", "B-A", "I-A", "O"], ["O", "I-A", "I-A", "O", "O"], ["O"] * 5]


def aligned(spark, text, entities, **options):
    df = spark.createDataFrame([(text, [("T", t, s, e, "") for t, s, e in entities])], f"text string, entities {ENT}")
    return tokens.align_bio(tokens.tokenize_offsets(df), **options).first().tags


def test_align_bio(spark):
    text = "severe heart failure now"
    assert aligned(spark, text, [("A", 0, 20)]) == ["O", "B-A", "I-A", "I-A", "O", "O"]
    # a later entity overwrites, and begins anew
    assert aligned(spark, text, [("A", 0, 20), ("B", 7, 20)]) == ["O", "B-A", "B-B", "I-B", "O", "O"]
    # straddling the start is B, straddling the end changes nothing
    assert aligned(spark, text, [("A", 3, 12)]) == ["O", "B-A", "I-A", "O", "O", "O"]
    assert aligned(spark, text, [("A", 7, 10)]) == ["O", "O", "O", "O", "O", "O"]
    assert aligned(spark, text, [("A", 9, 9)]) == ["O", "O", "B-A", "O", "O", "O"]
    assert aligned(spark, text, [], mask_special=True) == [None, "O", "O", "O", "O", None]


def spans(spark, tags, mode):
    df = spark.createDataFrame([(tags,)], "t array<string>")
    return [tuple(z) for z in df.select(bio_spans(F.col("t"), mode).alias("z")).first().z]


CASES = [
    ([], [], []),
    (["O", "O"], [], []),
    (["B-a", "I-a", "O", "B-a"], [("a", 0, 1), ("a", 3, 3)], [("a", 0, 1), ("a", 3, 3)]),
    (["I-a", "I-a", "O"], [], [("a", 0, 1)]),
    (["B-a", "I-b", "I-a"], [("a", 0, 0)], [("a", 0, 0), ("b", 1, 1), ("a", 2, 2)]),
    (["B-a", "B-a", "I-a"], [("a", 0, 0), ("a", 1, 2)], [("a", 0, 0), ("a", 1, 2)]),
    (["B-Non-query-able", "I-Non-query-able"], [("Non-query-able", 0, 1)], [("Non-query-able", 0, 1)]),
]


@pytest.mark.parametrize("tags, strict, lenient", CASES)
def test_bio_spans(spark, tags, strict, lenient):
    assert spans(spark, tags, "strict") == strict
    assert spans(spark, tags, "lenient") == lenient


def test_group_tokens(spark):
    df = spark.createDataFrame(
        [("high blood pressure x", ["O", "B-a", "I-a", "I-b", "B-b", "I-b"], [0.9, 0.5, 1.0, 0.25, 1.0, 0.0], [(0, 0), (0, 4), (5, 10), (11, 19), (20, 21), (0, 0)])],
        "text string, tags array<string>, scores array<double>, offsets array<struct<start:int,end:int>>",
    )
    got = df.select(F.inline(tokens.group_tokens(F.col("tags"), F.col("scores"), F.col("offsets"), F.col("text")))).collect()
    assert [tuple(r) for r in got] == [("a", "high blood", 0, 10, 0.75), ("b", "pressure", 11, 19, 0.25), ("b", "x", 20, 21, 1.0)]


def test_vocab_and_ids(spark, rows):
    df = spark.createDataFrame([(1, ["[CLS]", "b", "a", "[SEP]"]), (2, ["b", "c", "[E1]"]), (3, [])], "k int, tokens array<string>")
    vocab = tokens.build_vocab(df)
    assert rows(vocab, "id")[:2] == [("[PAD]", 0), ("[UNK]", 1)]
    assert rows(vocab.where("id >= 8"), "id") == [("b", 8), ("a", 9), ("c", 10)]
    small = tokens.build_vocab(df, min_count=2)
    for options in ({}, {"max_broadcast": 0, "block_rows": 1, "fraction": 1.0}):
        got = {r.k: r.input_ids for r in tokens.encode_tokens(df, small, ["k"], **options).collect()}
        assert got == {1: [2, 8, 1, 3], 2: [8, 1, 4], 3: []}


def test_scores(spark):
    df = spark.createDataFrame([([0.5, 2.0, 2.0], ["B-a-b", "O"], [-100, 3])], "s array<double>, t array<string>, m array<int>")
    r = df.select(argmax(F.col("s")).alias("a"), softmax_confidence(F.col("s")).alias("c"),
                  F.transform("t", base_label).alias("b"), drop_ignored(F.col("m"), F.col("t")).alias("d")).first()
    assert (r.a, r.c, r.b) == (1, 0.4498, ["a-b", "O"])
    assert [tuple(x) for x in r.d] == [(3, "O")]


def swept_by_hand(offsets, entities):
    """Every token against every entity, the last one that applies wins."""
    out, before = [], 0
    for s, e in offsets:
        tag = "O"
        for kind, x, y in entities:
            if s >= x and e <= y:
                tag = ("I-" if before > x else "B-") + kind
            elif s < x < e:
                tag = "B-" + kind
        out.append(tag)
        before = e
    return out


SWEPT = "k int, offsets array<struct<start:int,end:int>>, entities array<struct<id:string,type:string,start:bigint,end:bigint,text:string>>"


def test_sweep_equals_all_tokens_against_all_entities(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(300):
        offsets, at = [], 0
        for _ in range(rng.randint(0, 14)):
            at += rng.randint(0, 2)
            offsets.append((at, at + rng.randint(1, 4)))
            at = offsets[-1][1]
        spans = sorted(((rng.randint(0, at + 1), rng.choice("ABC")) for _ in range(rng.randint(0, 6))), key=lambda x: x[0])
        entities = [(kind, s, s + rng.randint(-1, 12)) for s, kind in spans]
        rows.append((k, [(0, 0), *offsets, (0, 0), (0, 0)], [("T", kind, s, e, "") for kind, s, e in entities]))
        want[k] = ["O", *swept_by_hand(offsets, entities), "O", "O"]
    for masked in (False, True):
        got = {r.k: r.tags for r in tokens.align_bio(spark.createDataFrame(rows, SWEPT), masked).collect()}
        assert got == {k: [None, *w[1:-2], None, None] if masked else w for k, w in want.items()}


def test_sweep_of_a_long_line(spark):
    offsets = [(0, 0), *((3 * i, 3 * i + 2) for i in range(1, 20_000)), (0, 0)]
    entities = [("T", "A", 12 * i, 12 * i + 6, "") for i in range(5_000)]
    df = spark.createDataFrame([(0, offsets, entities)], SWEPT)
    began = time.time()
    tags = tokens.align_bio(df).first().tags
    assert time.time() - began < 60
    assert tags[1:-1] == swept_by_hand(offsets[1:-1], [("A", s, e) for _, _, s, e, _ in entities[:5_000]])


def test_long_lines_are_tagged_outside_of_lambdas(spark):
    """tokens and tags of a line are made in batches, so a line of many tokens costs no more per token."""
    text = "ab cd " * 4_000
    entities = [(6 * i, 6 * i + 5, "X") for i in range(0, 4_000, 2)]
    df = spark.createDataFrame([(text, entities), (None, entities), ("ab", []), ("ab", None)], "text string, entities array<struct<start:bigint,end:bigint,type:string>>")
    plan = tokens.align_bio(tokens.tokenize_offsets(df))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") >= 2
    got = [r.tags for r in plan.select("tags").collect()]
    assert got[0] == ["O", *(["B-X", "I-X", "O", "O"] * 2_000), "O"]
    assert got[2] == got[3] == ["O", "O", "O"]


def test_prefixes_of_tags(spark):
    names = ["B-X", "I-a-b", "O", "B-", "XB-c", "", None, "I-I-y"]
    df = spark.createDataFrame([(n,) for n in names], "tag string")
    got = [r[0] for r in df.select(base_label(F.col("tag"))).collect()]
    assert got == ["X", "a-b", "O", "", "XB-c", "", None, "I-y"]


def test_tokens_and_offsets_are_cut_in_one_batch_step(spark):
    """No lambda runs over the pieces; null, empty and blank texts and characters beyond the first plane are right."""
    texts = [(0, None), (1, ""), (2, "  \n"), (3, "a \U0001f600b [E1]c, d́"), (4, "x")]
    df = tokens.tokenize_offsets(spark.createDataFrame(texts, "k int, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "btrim" not in plan and "transform(" not in plan
    got = {r.k: (r.tokens, r.offsets and [tuple(o) for o in r.offsets], r.attention_mask) for r in df.collect()}
    assert got[0][:2] == (None, None)
    assert got[1][0] == got[2][0] == ["[CLS]", "[SEP]"] and got[2][1] == [(0, 0), (0, 0)]
    words, spans_ = got[3][0][1:-1], got[3][1][1:-1]
    assert words == ["a", "\U0001f600", "b", "[E1]", "c", ",", "d́"]
    assert [texts[3][1][s:e] for s, e in spans_] == words
    assert got[4] == (["[CLS]", "x", "[SEP]"], [(0, 0), (0, 1), (0, 0)], [1, 1, 1])
