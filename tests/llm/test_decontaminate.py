import random
import re

import numpy as np
import pytest

from trialweave.llm import decontaminate as dc
from trialweave.llm import fm_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[s : s + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for s in range(len(w)):
            for n in range(1, min(window, len(w) - s) + 1):
                if tuple(w[s : s + n]) in grams:
                    hit.update(range(s, s + n))
                    found |= grams[tuple(w[s : s + n])]
        spans = [(s, next(e for e in range(s, len(w) + 1) if e not in hit)) for s in sorted(hit) if s - 1 not in hit]
        out.append((doc, len(w), len(hit), len(found), spans, sorted(found)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, [tuple(s) for s in r.spans], r["items"]) for r in df.collect()), key=str)


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def corpus(seed, short):
    rng = random.Random(seed)
    draw = lambda n, top: " ".join(rng.choice(["W", "w", "ñ"]) + str(rng.randint(0, top)) for _ in range(n))
    items = [(i, draw(rng.randint(12, 40), 30)) for i in range(30)] + [(99, None), (98, "  .,"), (5, draw(15, 3)), (None, draw(12, 4))]
    if short:
        items += [(100, "w1"), (101, "W2 w3"), (102, draw(9, 2))]
    docs = []
    for i in range(150):
        parts = [draw(rng.randint(0, 30), 60) for _ in range(3)]
        chosen = (rng.choice(items)[1] or "").split()
        cut = rng.randint(0, 12)
        parts.insert(1, "-- ".join(chosen[cut:]) if rng.random() < 0.6 else "")
        docs.append((i, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "..."), (3, docs[3][1]), (None, docs[4][1]), (600, " ".join([docs[7][1]] * 200))]
    docs += [(700 + i, docs[9][1]) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("short", [False, True])
def test_equals_brute_force(spark, short):
    docs, items = corpus(7, short)
    frames = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert sum(r[2] > 0 for r in want) > 30
    assert got(dc.decontaminate(*frames, shard_words=500)) == want
    assert got(dc.decontaminate(*frames, block_bytes=700)) == want


def test_empty_tables_and_clashing_columns(spark):
    docs, items = corpus(8, True)
    none = spark.createDataFrame([], ITEMS)
    frame = spark.createDataFrame(docs, DOCS)
    assert all(r.n_hit == 0 and r["items"] == [] for r in dc.decontaminate(frame, none).collect())
    assert dc.decontaminate(spark.createDataFrame([], DOCS), none).count() == 0
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], DOCS + ", rid long, id string, n_words long")
    table = spark.createDataFrame([(*r, 1) for r in items], ITEMS + ", item long")
    assert got(dc.decontaminate(wide, table)) == brute(docs, items)


def test_suffix_order_and_places():
    rng = np.random.default_rng(2)
    for top, size in ((1, 60), (3, 400), (50, 3_000)):
        symbols = rng.integers(0, top + 1, size)
        symbols[-1] = 0
        index = fm_index.FmIndex(symbols, top)
        stops = np.cumsum(symbols == 0)
        keys = [tuple((0, int(stops[j]), 0) if symbols[j] == 0 else (1, 0, int(symbols[j])) for j in range(i, size)) for i in range(size)]
        assert fm_index.suffix_order(symbols).tolist() == sorted(range(size), key=keys.__getitem__)
        patterns = rng.integers(1, top + 1, (200, 5))
        lengths = rng.integers(1, 6, 200)
        low, high = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, low, high, strict=True):
            want = [i for i in range(size - n + 1) if (symbols[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
