import random

import pytest

from trialweave.llm.mixing import mix_documents, repeat_documents


def water_level(totals, weights=(1, 2, 3)):
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = sum(totals.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * totals[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
            open_.discard(s)
    return target


def corpus(rng, sources, n):
    rows = []
    for i in range(n):
        source = rng.choice(sources)
        size = min(900, int(rng.paretovariate(0.9) * 4))
        rows.append((i, " ".join(["w"] * size) if rng.random() > 0.05 else None, source))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words_taken(spark, seed):
    rng = random.Random(seed)
    rows = corpus(rng, ["hot"] * 40 + ["tiny", None, "b", "b", "c", "c", "c", "é", "z"], 1_500)
    rows += [(5_000, "only one", "single"), (5_001, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix_documents(docs).collect()
    source = {i: s for i, _, s in rows}
    totals = {}
    for i, t, s in rows:
        totals[s] = totals.get(s, 0) + len((t or "").split())
    want = water_level(totals)
    taken, least = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == totals[s]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        if r.size:
            least[s] = min(least.get(s, r.size), r.size)
    assert len(got) == len(rows)
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(1.0, least.get(s, 0)), (s, t, want[s])
    again = mix_documents(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)


def test_rates_are_tilted(spark):
    """Below a target of one copy each, a long text is less likely to be taken than a short one."""
    rows = [(i, " ".join(["w"] * (5 if i % 2 else 100)), "a" if i < 400 else "b" if i < 410 else "c") for i in range(800)]
    got = mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 400").collect()
    mean = lambda size: sum(r.copies for r in got if r.size == size) / sum(r.size == size for r in got)
    assert mean(100) < 1 and mean(100) < mean(5) < 1.05


def test_stage_repeats_rows(spark):
    rows = corpus(random.Random(3), ["a", "b", "c"], 120)
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, _copies string")
    mixed = repeat_documents(docs)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mix_documents(docs).collect() if r.copies}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix_documents(spark.createDataFrame([], schema)).count() == 0
    got = mix_documents(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
