import math
import random
import re

import numpy as np
import pytest

from trialweave.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    worded = [(i, terms(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in worded), sum(len(w) for _, w in worded)
    df = {}
    for _, w in worded:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for doc, w in worded:
            m = 100 - 50 + (50 * len(w) * n_docs) // max(1, n_words)
            s = 0
            for t in set(terms(text)):
                if tf := w.count(t):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def corpus(seed, n=300):
    rng = random.Random(seed)
    draw = lambda size: " ".join(f"{rng.choice('WwÑ')}{min(int(rng.expovariate(0.05)), 150)}" for _ in range(size))
    docs = [(i, draw(rng.randint(0, 60))) for i in range(n)]
    docs += [(900 + i, docs[5][1]) for i in range(60)] + [(-1, None), (-2, ""), (-3, "?!"), (None, docs[6][1]), (7, docs[8][1]), (7, docs[8][1])]
    items = [(i, draw(rng.randint(1, 25))) for i in range(25)] + [(40, None), (41, " , "), (42, "nowhere"), (3, docs[5][1]), (None, docs[5][1])]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS).repartition(2)


@pytest.mark.parametrize(
    "options", [{}, {"range_docs": 7, "bundle_items": 4}, {"owners": 1}, {"owners": 6, "range_docs": 50}, {"block_bytes": 300}]
)
def test_equals_brute_force(spark, options):
    docs, items = corpus(3)
    got = sorted(map(tuple, ls.search(*frames(spark, docs, items), **options).collect()), key=str)
    assert got == brute(docs, items)


def test_fewer_results(spark):
    docs, items = corpus(4)
    got = sorted(map(tuple, ls.search(*frames(spark, docs, items), k=3, range_docs=20).collect()), key=str)
    assert got == brute(docs, items, 3)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = corpus(5, 40)
    d, i = frames(spark, docs, items)
    assert ls.search(spark.createDataFrame([], DOCS), i).count() == 0
    assert ls.search(d, spark.createDataFrame([], ITEMS)).count() == 0
    assert ls.search(d, spark.createDataFrame([(1, None)], ITEMS)).count() == 0
    wide = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS + ", id long, range string")
    named = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS + ", item long, score long")
    assert sorted(map(tuple, ls.search(wide, named).collect()), key=str) == brute(docs, items)


def test_floors_give_up_accumulators():
    texts = [b"rare common", b"common"]
    items = ls.Items.of(texts)
    stats = [(items.vocabulary[b"rare"], 60, 3, 2), (items.vocabulary[b"common"], 900, 1, 5)]
    plan = ls.Plan(items, 1_000, 50_000, stats, 2)
    assert plan.owner[items.vocabulary[b"rare"]] == 0 and plan.owner[items.vocabulary[b"common"]] == 1
    assert plan.rest[1].tolist() == [0, 0] and plan.rest[0][0] == plan.rest[0][1] > 0
    import pyarrow as pa

    owned = pa.table({c: [np.array(v, np.int64).tobytes()] for c, v in {"terms": [items.vocabulary[b"rare"]] * 2, "at": [4, 9], "adds": [5, 10**9]}.items()})
    item, at, score = ls.visit(plan, 0, np.array([10**8, 1]), pa.table({}), owned, 0, 2)
    assert (item.tolist(), at.tolist(), score.tolist()) == ([0], [9], [10**9])
