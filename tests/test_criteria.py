import pytest
from pyspark.sql import functions as F

from trialweave.functions.text import running_offsets, strip, universal_newlines
from trialweave.operators import criteria

BLOCK = "\n".join(
    [
        "* before any header",
        "  INCLUSION   criteria: adults only",
        "* first item",
        "\t- second item  ",
        "-no space",
        "1. numbered",
        "*   ",
        "wrapped prose",
        "",
        "    * nested é \U0001f600",
        "The exclusion criteria: not at line start",
        "exclusion\tCriteria",
        "- out",
        "Inclusion criteriaX",
        "* back in",
    ]
)


@pytest.fixture
def studies(spark):
    data = [(1, "N1", BLOCK), (2, "N2", None), (3, "N1", "Exclusion criteria\r\n* a\r\n* \"quoted\""), (4, "N4", "no header\n* x")]
    return spark.createDataFrame(data, "study_row bigint, StudyNCTid string, EligibilityCriteria string")


def test_explode_criteria(studies, rows):
    got = rows(criteria.explode_criteria(studies), "study_row", "item_no")
    assert got == [
        (1, 0, "N1", "inclusion", "first item"),
        (1, 1, "N1", "inclusion", "second item"),
        (1, 2, "N1", "inclusion", "nested é \U0001f600"),
        (1, 3, "N1", "exclusion", "out"),
        (1, 4, "N1", "inclusion", "back in"),
        (3, 0, "N1", "exclusion", "a"),
        (3, 1, "N1", "exclusion", '"quoted"'),
    ]


def test_steps_compose_to_the_same_items(studies, rows):
    by_steps = criteria.extract_bullets(criteria.tag_sections(studies)).select("study_row", "criteria_type", "text")
    at_once = criteria.explode_criteria(studies).select("study_row", "criteria_type", "text")
    assert sorted(rows(by_steps)) == sorted(rows(at_once))


def test_split_lines_strips_and_drops_blank(studies, rows):
    got = rows(criteria.split_lines(studies).where("study_row = 1").select("line_no", "line"), "line_no")
    assert [n for n, _ in got] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14]
    assert got[3] == (3, "- second item")
    assert criteria.split_lines(studies).where("study_row = 2").count() == 0


def test_tag_sections_state(studies, rows):
    got = rows(criteria.tag_sections(studies).where("study_row = 1").select("line_no", "is_header", "criteria_type"), "line_no")
    assert got[0] == (0, False, None)
    assert got[1] == (1, True, "inclusion")
    assert (10, False, "inclusion") in got
    assert (11, True, "exclusion") in got
    assert got[-2:] == [(13, True, "inclusion"), (14, False, "inclusion")]


def test_explode_criteria_is_narrow(studies):
    plan = criteria.explode_criteria(studies)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("partitions", [1, 7])
def test_sentence_id_is_consecutive(spark, partitions):
    df = spark.range(0, 1000, 1, partitions).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("x"))
    got = criteria.with_sentence_id(df, "k").select("k", "sentence_id").collect()
    assert all(r.k == r.sentence_id for r in got) and len(got) == 1000


def test_defaults_and_null_text(spark, rows):
    df = spark.createDataFrame([("a",), (None,)], "text string")
    got = rows(criteria.normalize_text(criteria.with_default_columns(df)), "text")
    assert got == [("", "unknown", "unknown"), ("a", "unknown", "unknown")]


def test_head(spark):
    df = spark.range(20).select(F.col("id").alias("sentence_id"))
    assert [r[0] for r in criteria.head_sentences(df, 3).collect()] == [0, 1, 2]
    assert criteria.head_sentences(df, 0).count() == criteria.head_sentences(df, None).count() == 20


def test_running_offsets_across_blocks(spark):
    for n in (0, 1, 31, 32, 33, 64, 65, 200):
        values = [(i * 7) % 5 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        got = df.select(running_offsets(F.col("v")).alias("o")).first()["o"]
        assert got == [sum(values[:i]) for i in range(n)]


def test_strip_and_newlines(spark):
    df = spark.createDataFrame([(" \x1c a b\x85　", "a\r\nb\rc\nd")], "x string, y string")
    assert tuple(df.select(strip(F.col("x")), universal_newlines(F.col("y"))).first()) == ("a b", "a\nb\nc\nd")
