import random

import numpy as np

from trialweave.llm import quality


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n", "a", "é" * 10, "word " * 50_000):
        values = quality.features(text)
        assert len(values) == len(quality.FEATURES) and np.isfinite(values).all()


def test_tables_learn_single_features_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3_000, 4))
    y = ((x[:, 0] > 0.7) | ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5))).astype(float)
    model = quality.train(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert any({a, b} == {1, 2} for a, b, *_ in model.pairs)
    alone = quality.Additive(model.base, model.edges, model.tables)
    assert ((alone.score(x) > 0.5) == y).mean() < 0.9


def corpus(n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(5, 80))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_rerun(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    train = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int")
    model = quality.fit(d, train)
    got = {r.doc_id: r for r in quality.score_documents(d, model).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    again = quality.fit(d.repartition(2), train)
    assert again.base == model.base and all((a == b).all() for a, b in zip(again.tables, model.tables, strict=True))


def test_no_or_one_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (1, "")], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    ones = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.9 for r in quality.score_documents(docs, ones).collect())
    empty = docs.limit(0)
    assert quality.score_documents(empty, none).count() == 0


def test_scores_equal_table_lookups_row_by_row():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 5)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.2).astype(float)
    model = quality.train(x, y, rounds=40)
    place = lambda edges, v: sum(e <= v for e in edges)
    for row, got in zip(x[:100], model.score(x[:100]), strict=True):
        total = model.base + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[place(ea, row[a]), place(eb, row[b])] for a, b, ea, eb, t in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_best_pair_tree_equals_all_cuts():
    """The gain of a pair is that of the best of all trees: one cut of the first feature, one of the second in each part."""
    rng = np.random.default_rng(6)
    lam = quality.LAMBDA
    value = lambda g, h: g**2 / (h + lam)
    for _ in range(20):
        g, h, n = rng.normal(size=(4, 5)), rng.uniform(0.5, 2, size=(4, 5)), np.full((4, 5), 200.0)
        best = 0.0
        for cut in range(3):
            gain = -value(g.sum(), h.sum())
            for part in (slice(0, cut + 1), slice(cut + 1, None)):
                gp, hp = g[part].sum(0), h[part].sum(0)
                whole = value(gp.sum(), hp.sum())
                gain += max([whole, *(value(gp[:c].sum(), hp[:c].sum()) + value(gp[c:].sum(), hp[c:].sum()) for c in range(1, 5))])
            best = max(best, gain)
        assert abs(quality._grid_tree(g, h, n)[0] - best) < 1e-9


def test_clashing_columns_are_not_read(spark):
    docs, labels = corpus(120)
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    wide = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, label int, _label_id long, id string")
    table = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, text string")
    one, two = quality.fit(plain, spark.createDataFrame(labels, "doc_id long, quality int")), quality.fit(wide, table)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(quality.score_documents(plain, one)) == rows(quality.score_documents(wide, two))
