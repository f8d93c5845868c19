"""Entity lists that are JSON as they stand, and the one written copy of the numbered sentences."""

import pytest
from pyspark.sql import functions as F

from trialweave.plans import inputs
from trialweave.session import tables_written
from trialweave.sources.studies import parse_entities

ITEM = '{"entity_group":"Drug","word":%s,"start":0,"end":4,"confidence_score":1.0}'
CELLS = {
    "[" + ITEM % '"aspirin"' + "]": ["aspirin"],
    "[" + ITEM % '"None of \\"it\\", it\'s True"' + "]": ['None of "it", it\'s True'],
    "[" + ITEM % '"it\'s"' + "]": ["it's"],
    "[" + ITEM % "'aspirin'" + "]": ["aspirin"],
    "[" + ITEM % "None" + "]": [None],
    "[" + ITEM % '"caf\\xe9"' + "]": ["café"],
    "[]": [],
    " ": None,
    None: None,
}


def test_cells_with_and_without_python_words(spark):
    rows = spark.createDataFrame(list(enumerate(CELLS)), "i int, cell string")
    got = rows.select("i", parse_entities(F.col("cell"))["word"].alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == list(CELLS.values())
    with pytest.raises(Exception, match="not a list|MALFORMED|parse"):
        spark.createDataFrame([("[{",)], "cell string").select(parse_entities(F.col("cell"))).collect()


def test_a_cell_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([("[]",)], "cell string").write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c")).select(parse_entities(F.col("cell")).alias("e"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_numbered_sentences_are_written_once(spark, tmp_path):
    documents = [(1, "Aspirin is good. Take Aspirin and Ibuprofen. End.", "en"), (2, "Nothing here. Or There.", "fr")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    inputs.line_entities(spark, str(tmp_path))
    before = len(tables_written())
    got = inputs.entity_sentences(spark, str(tmp_path))
    assert len(tables_written()) == before + 1
    assert [r.sentence_id for r in got.orderBy("file", "line_no").collect()] == list(range(got.count()))
