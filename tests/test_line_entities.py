"""Lines and their mentions made in the row of a document, against the joins that give the same."""

import random

import pytest
from pyspark.sql import functions as F

from trialweave.operators import annotations, spans
from trialweave.operators.criteria import non_blank
from trialweave.plans import datasets
from trialweave.sources.corpus import annotation_lines

DOCUMENT = "file string, text string, ann_text string"
ODD = [
    "T1\tDrug 0 4\tfour",
    "  T2\tValue 5 9;12 14\ttwo parts 　",
    "T3\tDrug 14 3\tbackwards",
    "T4\tDrug 2 99999999999999999999\tno bigint",
    "T5\tDrug 0000000000000000000000002 6\tzeros",
    "T6\tdrug 0 4\tother case",
    "T7\tUnknown 0 4\tnot accepted",
    "T8\tDrug\tno offsets",
    "T9\tDrug 0 4",
    "T10\tDrug 1 2\r\tend of line",
    "T11\tDrug 1 2 3 4\ttwo lines in one",
    "T12\tDrug 1 2\tother space",
    "T13\t 1 2\tno type",
    "R1\tAND Arg1:T1 Arg2:T2\t",
    "",
    "Tx\tDrug 9223372036854775807 3\tlargest",
    "T1\tDrug 0 4\tfour\tmore",
    "T14\tDrug 0 4\t\U0001f600 é",
]


def by_joins(documents, accepted):
    lines = spans.line_offsets(documents.select("file", "text"))
    fragments = annotations.parse_mentions_fragments(annotation_lines(documents.select("file", "ann_text")), accepted)
    return spans.nest_entities(non_blank(lines), spans.assign_to_lines(lines, fragments))


def shown(df):
    return sorted(map(str, df.select("file", "line_no", "text", "off", "entities").collect()))


def corpus(rng, n):
    for i in range(n):
        text = "\n".join("".join(rng.choice("ab 　\U0001f600é") for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(rng.randint(1, 6)))
        found = [rng.choice(ODD) for _ in range(rng.randint(0, 8))]
        for k in range(rng.randint(0, 8)):
            s = rng.randint(0, len(text) + 3)
            found.append(f"T{k}\t{rng.choice(['Drug', 'Value', 'Other'])} {s} {s + rng.randint(-9, 9)}\tx")
        yield f"F{i}", text, "\n".join(found)


@pytest.mark.parametrize("accepted", [None, ("Drug",)])
def test_in_the_row_equals_the_joins(spark, accepted):
    data = [*corpus(random.Random(4), 60), ("odd", "some text of\n\nfour lines\n ", "\n".join(ODD))]
    data += [("no text", None, ODD[0]), ("no mentions", "a\nb", None), ("empty", "", "")]
    documents = spark.createDataFrame(data, DOCUMENT)
    got = datasets.line_entities(documents, accepted)
    assert shown(got) == shown(by_joins(documents, accepted))
    assert got.where(F.size("entities") > 0).count() > 40


def test_repeated_and_missing_file_names_equal_the_joins(spark):
    data = [*corpus(random.Random(6), 20), *corpus(random.Random(7), 5), *corpus(random.Random(7), 2)]
    data += [(None, "one two", ODD[0]), (None, "one two", ODD[0]), ("F1", None, ODD[0]), ("F2", "more", None)]
    documents = spark.createDataFrame(data, DOCUMENT)
    assert shown(datasets.line_entities(documents)) == shown(by_joins(documents, annotations.ENTITY_TYPES))


def test_nothing_is_shuffled(spark):
    documents = spark.createDataFrame(list(corpus(random.Random(8), 40)), DOCUMENT)
    lines = datasets.line_entities(documents)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
