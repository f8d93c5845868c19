"""Every SQL twin at the smallest scale, plan shapes, and the file stream."""

import os
import sys

import duckdb
import pytest
from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from check_sql import TABLES, normal  # noqa: E402

from trialweave.plans.oracles import ORACLES  # noqa: E402
from trialweave.plans.queries import QUERIES  # noqa: E402
from trialweave.sources import datasets  # noqa: E402
from trialweave.streaming.criteria_stream import stream_criteria  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_every_query_but_the_learned_chain_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"train_chain_tagger"} and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan
    got, want = normal(df.toPandas()), normal(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


@pytest.mark.parametrize("name", ["criteria_counts", "explode_criteria", "tag_sections", "split_lines"])
def test_registry_scan_reads_two_columns(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize(
    "name, columns",
    [("build_vocab", "tokens"), ("bio_spans_strict", "file:string,line_no:int,pred_tags"), ("label_presence", "file:string,line_no:int,labels")],
)
def test_written_tables_are_scanned_by_column(spark, name, columns):
    from trialweave.operators import tokens
    from trialweave.plans import inputs

    df = tokens.token_counts(inputs.tagged_lines(spark, SMALL)) if name == "build_vocab" else QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert f"ReadSchema: struct<{columns}" in plan


def test_no_token_is_lost(spark):
    from pyspark.sql import functions as F

    from trialweave.plans import inputs

    lines = inputs.lines(spark, SMALL)
    words = lines.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"), F.lit(0))))).first()[0]
    rows = QUERIES["tokenize_offsets"](spark, SMALL)
    assert rows.agg(F.sum(F.col("n_real") - 2)).first()[0] == words


def test_file_stream_gives_the_batch_items(spark, tmp_path):
    from trialweave.plans import bridge

    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    datasets.write_csv(bridge.studies(spark, SMALL).drop("study_row"), src)
    for _ in range(2):  # the second run finds nothing new
        assert stream_criteria(spark, src, out, state).awaitTermination(120)
    got = spark.read.parquet(out).select("studyNCTid", "item_no", "criteria_type", "text")
    want = QUERIES["explode_criteria"](spark, SMALL).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
