import pytest
from pyspark.sql import functions as F

from trialweave.operators import annotations as ann
from trialweave.sources.corpus import annotation_lines

ANN = "\n".join(
    [
        "T1\tCondition 0 5\tfever",
        "",
        "  T2\tValue 10 12;20 25;30 31\tab cdefg h  ",
        "T3\tParsing_Error 40 45\twrong",
        "T4\tDrug 50 55",
        "T5\tDrug\tno numbers",
        "T1\tDrug 7 9\tlater line",
        "R1\tHas_value Arg1:T1 Arg2:T2\t",
        "R2\tAND Arg2:T3 Arg1:T1",
        "R3\tAND Arg1:T1",
        "R4\tmulti Arg1:T2 Arg2:T9:x",
        "R5",
        "*\tOR T1 T2 T3",
        "*\tNOT T1",
        "*\tOR T4 T5",
        "#1\tnote",
        "T6\tNon-query-able 9 4\tbackwards",
    ]
)


@pytest.fixture
def lines(spark):
    return annotation_lines(spark.createDataFrame([("D_inc", ANN)], "file string, ann_text string"))


def test_lines_keep_order_and_skip_blank(lines, rows):
    got = rows(lines.select("ann_line", "line"), "ann_line")
    assert len(got) == 16 and got[1] == (2, "T2\tValue 10 12;20 25;30 31\tab cdefg h")


def test_fragments(lines, rows):
    got = rows(ann.parse_mentions_fragments(lines).select("id", "type", "frag_no", "start", "end", "text"), "ann_line", "frag_no")
    assert got == [
        ("T1", "Condition", 0, 0, 5, "fever"),
        ("T2", "Value", 0, 10, 12, "ab cdefg h"),
        ("T2", "Value", 1, 20, 25, "ab cdefg h"),
        ("T2", "Value", 2, 30, 31, "ab cdefg h"),
        ("T1", "Drug", 0, 7, 9, "later line"),
        ("T6", "Non-query-able", 0, 9, 4, "backwards"),
    ]
    assert ann.parse_mentions_fragments(lines, None).where("type = 'Parsing_Error'").count() == 1


def test_envelope(lines, rows):
    got = rows(ann.parse_mentions_envelope(lines).select("id", "type", "start", "end", "text"), "id")
    assert got == [
        ("T1", "Drug", 7, 9, "later line"),
        ("T2", "Value", 10, 31, "ab cdefg h"),
        ("T3", "Parsing_Error", 40, 45, "wrong"),
        ("T6", "Non-query-able", 4, 9, "backwards"),
    ]


def test_relations(lines, rows):
    assert rows(ann.parse_relations(lines).select("rel_type", "arg1", "arg2"), "ann_line") == [
        ("Has_value", "T1", "T2"),
        ("AND", "T1", "T3"),
        ("multi", "T2", "T9"),
    ]
    assert rows(ann.expand_nary_relations(lines).select("perm_no", "rel_type", "arg1", "arg2"), "ann_line", "perm_no") == [
        (0, "OR", "T1", "T2"),
        (1, "OR", "T1", "T3"),
        (2, "OR", "T2", "T1"),
        (3, "OR", "T2", "T3"),
        (4, "OR", "T3", "T1"),
        (5, "OR", "T3", "T2"),
        (0, "OR", "T4", "T5"),
        (1, "OR", "T5", "T4"),
    ]
    both = ann.all_relations(lines)
    assert both.count() == 11
    assert ann.filter_relation_types(both).count() == 10
    assert rows(ann.rejected_relations(both)) == [("multi", 1)]
    assert sorted(rows(ann.distinct_types(both, "rel_type"))) == [("AND",), ("Has_value",), ("OR",), ("multi",)]


def test_five_arguments_give_twenty_ordered_pairs(spark):
    df = annotation_lines(spark.createDataFrame([("f", "*\tOR A B C D E")], "file string, ann_text string"))
    got = ann.expand_nary_relations(df).select("arg1", "arg2", "perm_no").collect()
    assert len({(a, b) for a, b, _ in got}) == 20 and sorted(p for *_, p in got) == list(range(20))


def test_criteria_type(spark, rows):
    df = spark.createDataFrame([("a_exc",), ("a_inc",), ("a_inc_exc",), ("a",)], "f string")
    got = dict(rows(df.select("f", ann.criteria_type_of(F.col("f")))))
    assert got == {"a_exc": "exclusion", "a_inc": "inclusion", "a_inc_exc": "exclusion", "a": "unknown"}
