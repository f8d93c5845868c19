import hashlib
import random

import pytest

from trialweave.llm.exact_dedup import drop_exact_copies, exact_groups


def brute(rows):
    best, size = {}, {}
    for i, (doc, text) in enumerate(rows):
        text = text or ""
        size[text] = size.get(text, 0) + 1
        key = (doc is not None, doc or 0, i)
        best[text] = max(best.get(text, (False, 0, -1)), key)
    return sorted(
        (doc, best[t or ""][1] if best[t or ""][0] else None, size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for doc, t in rows
    )


@pytest.mark.parametrize("salt_rows,window", [(1_000, 1 << 20), (3, 1)])
def test_groups_equal_brute_force(spark, salt_rows, window):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "a", "b", "ab", "hot", "hot", "hot", "é" * 2000, str(i)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_groups(docs, salt_rows=salt_rows, window_bytes=window).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_texts_decide_when_digests_collide(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcdefgh") * rng.randint(1, 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_groups(docs, digest=lambda text: str(len(text) % 2), salt_rows=4, window_bytes=1).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [b[:3] for b in brute(rows)]


def test_repeated_rows_and_null_ids_keep_one_row(spark):
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (2, None), (3, "")]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(((r.doc_id, r.group_size) for r in got if r.kept), key=str)
    assert kept == [(1, 3), (3, 2), (None, 1)]
    assert len(got) == len(rows)


def test_stage_keeps_whole_rows_whatever_the_columns(spark):
    schema = "doc_id long, text string, _rid string, _digest int, c0 string"
    docs = spark.createDataFrame([(1, "x", "a", 1, "p"), (2, "x", "b", 2, "q"), (3, "z", None, None, None)], schema)
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(2, "x", "b", 2, "q"), (3, "z", None, None, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(docs).count() == 0
    assert drop_exact_copies(docs).count() == 0
