"""The registered queries and the pipeline over the smallest tables, against SQL, brute force and held-out rows."""

import hashlib
import os
import sys

import duckdb
import pytest
from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
sys.path.insert(0, os.path.dirname(__file__))

from check_sql import normal  # noqa: E402
from test_near_dedup import brute_groups  # noqa: E402
from test_pii import brute as pii_brute  # noqa: E402
from test_secret_scan import base as secret_base  # noqa: E402

import corpus_pipeline  # noqa: E402
from trialweave.llm import langid  # noqa: E402
from trialweave.llm.common import crc_mod  # noqa: E402
from trialweave.llm.queries import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got, want = normal(QUERIES[name](spark, SMALL).toPandas()), normal(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def shown(kinds, spans):
    return ",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in spans)


@pytest.mark.parametrize(
    "name, kinds, brute",
    [("op1_pii", ("email", "ip", "card", "phone"), pii_brute), ("op5_secrets", ("assign", "access", "hex"), secret_base)],
)
def test_base_spans_of_all_documents(spark, con, name, kinds, brute):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES[name](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(shown(kinds, want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(w[0] == i for w in want) for i in range(len(kinds))]
        assert set(filter(None, shown(kinds, want).split(","))) <= set(r.spans.split(","))


def test_near_groups_are_those_of_all_pairs(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: r for r in QUERIES["op7_near_dedup"](spark, SMALL).collect()}
    want = brute_groups(rows)
    # Every link that is found is one of all pairs; few pairs share no bucket.
    assert all(want[i] == want[r.class_id] for i, r in got.items())
    assert len({r.class_id for r in got.values()}) <= len(set(want.values())) + 2
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_mix_takes_the_targets(spark, con):
    rows = QUERIES["op6_mixing"](spark, SMALL).collect()
    words = dict(con.execute(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) FROM documents").fetchall())
    assert {r.doc_id: r.size for r in rows} == words
    taken = {}
    for r in rows:
        taken[r.target, r.source_size] = taken.get((r.target, r.source_size), 0) + r.taken
    for (want, _), got in taken.items():
        assert abs(got - want) <= 0.04 * want  # ten documents a source, whole copies
    assert abs(sum(taken.values()) - sum(words.values())) <= 0.01 * sum(words.values())


def test_packing_holds_every_document_once(spark, con):
    rows = QUERIES["op4_packing"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(x[0] for x in con.execute("SELECT doc_id FROM documents").fetchall())
    assert all(r.n_tokens <= r.padded for r in rows)


def test_held_out_quality_and_language(spark, con):
    quality = {r.doc_id: r for r in QUERIES["op8_quality"](spark, SMALL).collect()}
    labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    held = [i for i in labels if quality[i].held_out]
    assert sum(quality[i].predicted == labels[i] for i in held) >= 0.9 * len(held)
    language = {r.doc_id: r for r in QUERIES["op9_language"](spark, SMALL).collect()}
    langs = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [i for i in langs if language[i].held_out]
    assert sum(language[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)


def test_stages_return_the_columns_of_documents_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34", "en", "x", 5)], docs.schema)
    language, exact, near, mixing, packing = (f for _, f in corpus_pipeline.STAGES)
    found = language(spark, docs.union(odd), SMALL)
    und = {r.doc_id for r in langid.identify(docs.union(odd), model).collect() if r.lang_pred == langid.UND}
    assert und >= {-1, -2}
    assert {r.doc_id for r in found.select("doc_id").collect()} == {r.doc_id for r in docs.union(odd).select("doc_id").collect()} - und
    assert found.columns == docs.columns
    # Exact copies: the largest id of equal texts stays.
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, i), i)
    once = exact(spark, docs, SMALL)
    assert sorted(r.doc_id for r in once.select("doc_id").collect()) == sorted(best.values()) and once.columns == docs.columns
    kept = near(spark, once, SMALL)
    groups = brute_groups([(i, t) for t, i in best.items()])
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and {groups[i] for i in ids} == set(groups.values()) and len(ids) <= len(set(groups.values())) + 2
    mixed = mixing(spark, kept, SMALL)
    assert mixed.columns == docs.columns
    assert packing(spark, mixed, SMALL).count() == mixed.count()


def test_pipeline_runs_all_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
