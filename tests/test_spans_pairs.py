import itertools

import pytest
from pyspark.sql import functions as F

from trialweave.functions.markers import inject_markers
from trialweave.operators import pairs, spans
from trialweave.operators.criteria import non_blank

TEXT = "fever 38 high\n\n  \nno \U0001f600 drug here\nlast"
MENTION = "file string, ann_line int, frag_no int, id string, type string, start bigint, end bigint, text string"


@pytest.fixture
def lines(spark):
    return spans.line_offsets(spark.createDataFrame([("D", TEXT)], "file string, text string"))


@pytest.fixture
def mentions(spark):
    data = [
        ("D", 0, 0, "T1", "Condition", 0, 5, "fever"),
        ("D", 1, 0, "T2", "Value", 6, 8, "38"),
        ("D", 2, 0, "T3", "Qualifier", 5, 13, " 38 high"),
        ("D", 3, 0, "T4", "Drug", 23, 27, "drug"),
        ("D", 4, 0, "T5", "Value", 9, 20, "crosses lines"),
        ("D", 5, 0, "T6", "Value", 13, 13, ""),
        ("D", 6, 0, "T7", "Value", 14, 3, "backwards"),
        ("E", 0, 0, "T1", "Drug", 0, 4, "other file"),
    ]
    return spark.createDataFrame(data, MENTION)


def test_offsets(lines, rows):
    assert rows(lines.select("line_no", "off", "text"), "line_no") == [
        (0, 0, "fever 38 high"),
        (1, 14, ""),
        (2, 15, "  "),
        (3, 18, "no \U0001f600 drug here"),
        (4, 33, "last"),
    ]
    assert [r[0] for r in rows(non_blank(lines).select("line_no"), "line_no")] == [0, 3, 4]


def test_assign_to_lines(lines, mentions, rows):
    got = rows(spans.assign_to_lines(lines, mentions).select("id", "line_no", "start", "end"), "id", "line_no")
    # A backwards span lies "inside" every line between its end and its start.
    assert got == [
        ("T1", 0, 0, 5),
        ("T2", 0, 6, 8),
        ("T3", 0, 5, 13),
        ("T4", 3, 5, 9),
        ("T6", 0, 13, 13),
        ("T7", 0, 14, 3),
        ("T7", 1, 0, -11),
    ]


@pytest.mark.parametrize("block_rows", [None, 3, 1_000_000])
def test_assign_to_lines_across_buckets_against_brute_force(spark, block_rows):
    """Lines over several offset buckets, reversed and huge spans, one hot file."""
    import random

    rng = random.Random(5)
    text = "\n".join("x" * rng.choice([0, 3, 900, 5000, 12000]) for _ in range(40))
    spans_ = [(rng.randrange(len(text)), rng.randrange(len(text))) for _ in range(60)]
    spans_ += [(s, s + rng.randrange(40)) for s, _ in spans_] + [(10**15, 0), (0, 10**15)]
    lines = spans.line_offsets(spark.createDataFrame([("D", text)], "file string, text string"))
    mentions = spark.createDataFrame([("D", i, 0, f"T{i}", "X", s, e, "") for i, (s, e) in enumerate(spans_)], MENTION)
    got = {(r.id, r.line_no) for r in spans.assign_to_lines(lines, mentions, block_rows=block_rows).collect()}
    want, off = set(), 0
    for no, line in enumerate(text.split("\n")):
        want |= {(f"T{i}", no) for i, (s, e) in enumerate(spans_) if off <= s and e <= off + len(line)}
        off += len(line) + 1
    assert got == want
    assert spans.assign_to_lines(lines, mentions, block_rows=block_rows).count() == len(want)


def test_nest_entities(lines, mentions):
    in_lines = spans.assign_to_lines(lines, mentions.where("id <> 'T7'"))
    got = {r.line_no: [e.id for e in r.entities] for r in spans.nest_entities(non_blank(lines), in_lines).collect()}
    assert got == {0: ["T1", "T3", "T2", "T6"], 3: ["T4"], 4: []}


def test_pair_documents(spark, rows):
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "file string, text string")
    anns = spark.createDataFrame([("a", "t"), ("c", "u")], "file string, ann_text string")
    assert rows(spans.pair_documents(texts, anns)) == [("a", "x", "t")]
    assert rows(spans.unpaired_documents(texts, anns)) == [("b", "y")]


def line_mentions(spark, sizes):
    data = [(f"F{k}", 0, f"T{i}", "X", 2 * i, 2 * i + 1) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(data, "file string, line_no int, id string, type string, start int, end int")


@pytest.mark.parametrize("block_rows", [None, 1, 4, 512])
def test_candidate_pairs_are_complete_with_hot_lines(spark, block_rows):
    sizes = [1, 2, 3, 50]
    got = pairs.candidate_pairs(line_mentions(spark, sizes), block_rows=block_rows).select("file", "e1_id", "e2_id").collect()
    want = {(f"F{k}", f"T{i}", f"T{j}") for k, n in enumerate(sizes) for i, j in itertools.permutations(range(n), 2)}
    assert len(got) == len(want) == sum(n * (n - 1) for n in sizes) and {tuple(r) for r in got} == want


def test_labels_last_line_wins(spark):
    mentions = line_mentions(spark, [3]).unionByName(
        spark.createDataFrame([("F0", 1, "T9", "X", 0, 1)], "file string, line_no int, id string, type string, start int, end int")
    )
    data = [
        ("F0", 0, 0, "AND", "T0", "T1"),
        ("F0", 1, 2, "OR", "T0", "T1"),
        ("F0", 1, 3, "Has_value", "T0", "T1"),
        ("F0", 9, 0, "multi", "T0", "T1"),
        ("F0", 2, 0, "NO_RELATION", "T1", "T0"),
        ("F0", 3, 0, "AND", "T1", "T2"),
        ("F0", 4, 0, "NO_RELATION", "T1", "T2"),
        ("F0", 3, 0, "NO_RELATION", "T2", "T1"),
        ("F0", 4, 0, "OR", "T2", "T1"),
        ("F0", 2, 0, "AND", "T0", "T9"),
        ("F0", 2, 0, "AND", "T2", "T77"),
        ("F1", 2, 0, "AND", "T2", "T0"),
    ]
    relations = spark.createDataFrame(data, "file string, ann_line int, perm_no int, rel_type string, arg1 string, arg2 string")
    got = {(r.e1_id, r.e2_id): r.label for r in pairs.label_pairs(mentions, relations).collect()}
    assert len(got) == 6
    assert got[("T0", "T1")] == "Has_value"
    assert got[("T2", "T1")] == "OR"
    assert all(v == "NO_RELATION" for k, v in got.items() if k not in (("T0", "T1"), ("T2", "T1")))


def test_line_texts_stand_once_per_tile_and_not_in_each_pair(spark):
    """Two lines of one number with texts of their own: a pair has the text of its first mention's line."""
    from trialweave.session import tables_written

    mentions = line_mentions(spark, [1, 40, 3]).withColumn("line_key", F.expr("IF(file = 'F2' AND id = 'T2', 8L, 7L)"))
    lines = spark.createDataFrame(
        [(f"F{k}", 0, key, f"{k} {key} " + "x" * 1000) for k in range(3) for key in (7, 8)], "file string, line_no int, line_key bigint, line_text string"
    )
    relations = spark.createDataFrame(
        [("F1", 0, 0, "AND", "T39", "T0")], "file string, ann_line int, perm_no int, rel_type string, arg1 string, arg2 string"
    )
    labelled = pairs.label_pairs(mentions, relations, block_rows=16, lines=lines, write=True)
    got = {(r.file, r.e1_id, r.e2_id): (r.line_text.split(" ")[1], r.label) for r in labelled.collect()}
    assert len(got) == labelled.count() == 40 * 39 + 6
    assert {k: v for k, v in got.items() if v != ("7", "NO_RELATION")} == {
        ("F1", "T39", "T0"): ("7", "AND"), ("F2", "T2", "T0"): ("8", "NO_RELATION"), ("F2", "T2", "T1"): ("8", "NO_RELATION")
    }
    # 40 mentions in tiles of 16 firsts, and one tile per text of F2.
    assert spark.read.parquet(tables_written()[-1]).count() == 3 + 2
    assert "Exchange" not in labelled._jdf.queryExecution().executedPlan().toString()


def test_labels_of_mentions_that_lie_in_two_lines(spark):
    """Backwards spans can be in several lines; each line's pair gets the label."""
    data = [("F", n, t, "X", 0, 1) for n in (0, 1) for t in ("T1", "T2")]
    mentions = spark.createDataFrame(data, "file string, line_no int, id string, type string, start int, end int")
    relations = spark.createDataFrame(
        [("F", 0, 0, "AND", "T1", "T2")], "file string, ann_line int, perm_no int, rel_type string, arg1 string, arg2 string"
    )
    got = sorted((r.line_no, r.e1_id, r.label) for r in pairs.label_pairs(mentions, relations).collect())
    assert got == [(n, t, "AND" if t == "T1" else "NO_RELATION") for n in (0, 1) for t in ("T1", "T2")]


def test_overlaps(spark):
    data = [(0, 5, 5, 8, "touch"), (0, 5, 4, 8, "over"), (0, 9, 2, 3, "nested"), (2, 2, 0, 5, "empty")]
    df = spark.createDataFrame(data, "e1_start int, e1_end int, e2_start int, e2_end int, n string")
    # A zero-length span shares no character with another.
    assert {r.n for r in pairs.drop_overlaps(df).collect()} == {"touch", "empty"}


def marked(spark, text, *positions, **options):
    df = spark.createDataFrame([(text, *positions)], "t string, a int, b int, c int, d int")
    return df.select(inject_markers(F.col("t"), F.col("a"), F.col("b"), F.col("c"), F.col("d"), **options)).first()[0]


def test_markers(spark):
    assert marked(spark, "one two", 0, 3, 4, 7) == "[E1]one[/E1] [E2]two[/E2]"
    assert marked(spark, "one two", 4, 7, 0, 3) == "[E2]one[/E2] [E1]two[/E1]"
    assert marked(spark, "foobar", 0, 3, 3, 6) == "[E1]foo[E2][/E1]bar[/E2]"
    assert marked(spark, "foobar", 0, 3, 3, 6, balanced=True) == "[E1]foo[/E1][E2]bar[/E2]"
    assert marked(spark, "a\U0001f600b", 1, 2, 2, 3) == "a[E1]\U0001f600[E2][/E1]b[/E2]"
    assert marked(spark, "abc", 0, 1, 2, 9) == "[E1]a[/E1]b[E2]c[/E2]"
    assert marked(spark, "abc", 0, 1, 2, 9, bounds="skip") == "[E1]a[/E1]b[E2]c"
    with pytest.raises(ValueError):
        marked(spark, "abc", 0, 1, 2, 3, bounds="other")


@pytest.mark.parametrize("bounds", ["clamp", "skip"])
def test_markers_cut_at_once_are_those_inserted_one_by_one(spark, bounds):
    text, names = "a\U0001f600c", ("[E1]", "[/E1]", "[E2]", "[/E2]")
    data = [p for p in itertools.product(range(5), repeat=4)]
    df = spark.createDataFrame([(text, *p) for p in data], "t string, a int, b int, c int, d int")
    got = df.select("a", "b", "c", "d", inject_markers(F.col("t"), F.col("a"), F.col("b"), F.col("c"), F.col("d"), bounds=bounds).alias("m"))
    for *at, marked_text in got.collect():
        want = text
        for place, _, name in sorted((-p, k, names[k]) for k, p in enumerate(at)):
            want = want if bounds == "skip" and -place > len(want) else want[: -place] + name + want[-place :]
        assert marked_text == want


def test_removing_markers_restores_the_text(spark):
    text = "abcdefgh"
    for s1, e1, s2, e2 in [(0, 8, 2, 4), (3, 3, 3, 3), (1, 5, 4, 8)]:
        out = marked(spark, text, s1, e1, s2, e2)
        for m in ("[E1]", "[/E1]", "[E2]", "[/E2]"):
            out = out.replace(m, "")
        assert out == text


def test_tiles_of_the_pair_matrix_hold_all_pairs(spark):
    from pyspark.sql import functions as F

    from trialweave.operators import models
    from trialweave.operators.pairs import nested_pairs
    from trialweave.operators.spans import nest_relations

    entity = lambda n: [("T", f"w{i}", 3 * i, 3 * i + 2, 1.0) for i in range(n)]
    text = lambda n: " ".join(f"{i % 100:02}" for i in range(n))
    schema = "sentence_id int, text string, entities array<struct<entity_group:string,word:string,start:int,end:int,confidence_score:double>>"
    df = spark.createDataFrame([(k, text(n), entity(n)) for k, n in enumerate([0, 1, 2, 5, 16, 17, 40])], schema)
    shown = lambda d: sorted((r.sentence_id, r.i, r.j, r.e1.word, r.e2.word) for r in d.collect())
    assert shown(nested_pairs(df)) == shown(nested_pairs(df, tile=5)) == shown(nested_pairs(df, tile=16))
    large = nested_pairs(df.where("sentence_id = 6"), tile=5)
    assert large.select(F.spark_partition_id()).distinct().count() > 1
    scorer = lambda: lambda texts: [[0.0, float(len(t) % 3), 0.5] for t in texts]
    labels = ("NO_RELATION", "AND", "OR")
    flat = nest_relations(df, models.score_relations(df, scorer, labels))
    rows = lambda d: sorted((r.sentence_id, str(r.relations)) for r in d.collect())
    assert rows(models.with_relations(df, scorer, labels)) == rows(flat)


def test_texts_are_joined_to_written_tiles_and_never_written_without_need(spark):
    """The tiles hold mentions and labels only; texts come in behind them, and both ways give the same pairs."""
    mentions = line_mentions(spark, [1, 40, 3]).withColumn("line_key", F.expr("IF(file = 'F2' AND id = 'T2', 8L, 7L)"))
    lines = spark.createDataFrame(
        [(f"F{k}", 0, key, f"{k} {key}") for k in range(3) for key in (7, 8)], "file string, line_no int, line_key bigint, line_text string"
    )
    relations = spark.createDataFrame(
        [("F1", 0, 0, "AND", "T39", "T0")], "file string, ann_line int, perm_no int, rel_type string, arg1 string, arg2 string"
    )
    tiles = pairs.pair_tiles(mentions, keyed=True, gold=pairs.gold_in_lines(mentions, relations))
    bare, texted = pairs.labelled_tiles(tiles), pairs.labelled_tiles(pairs.with_line_texts(tiles, lines))
    assert "line_text" not in bare.columns
    seen = lambda df: sorted(map(tuple, df.select("file", "e1_id", "e2_id", "label").collect()))
    assert seen(bare) == seen(texted) == seen(pairs.label_pairs(mentions, relations, lines=lines))
    assert ("F1", "T39", "T0", "AND") in seen(bare)


def test_split_pairs_read_no_text(spark, tmp_path):
    from trialweave.plans import inputs

    docs = [(1, "Alpha 12 Betaaaaaaaaa Gamma 7. Delta Epsilon 5 Omega", "en"), (2, "Rho 4 Sigma Tau 5", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    bare, texted = inputs.split_pairs(spark, str(tmp_path)), inputs.split_text_pairs(spark, str(tmp_path))
    assert "line_text" not in bare.columns and "line_text" in texted.columns
    key = ["file", "e1_id", "e2_id", "label", "split"]
    assert sorted(map(tuple, bare.select(key).collect())) == sorted(map(tuple, texted.select(key).collect())) != []
    # The mentions' own text is not written for pairs either; the lexicon has it.
    assert "text" not in inputs.line_mentions(spark, str(tmp_path)).columns
    assert "text" in inputs.mention_texts(spark, str(tmp_path)).columns


def test_a_sentence_of_200_mentions_is_dealt_to_many_tasks(spark):
    """Its pairs cost as many passes over the text, so they must not come from one task; tiles bring their own mentions only."""
    from trialweave.operators.pairs import TILE, nested_pairs

    mentions = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.struct(k.alias("word"), (k % 3).alias("kind")))
    df = spark.range(1).select(F.col("id").alias("sentence_id"), F.lit("text").alias("text"), mentions.alias("entities"))
    found = nested_pairs(df, tile=TILE)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 1
    assert {(r.i, r.j) for r in rows} == {(i, j) for i in range(200) for j in range(200) if i != j} and len(rows) == 200 * 199
    assert all(r.e1.word == r.i and r.e2.word == r.j for r in rows)
