import random

import numpy as np
import pandas as pd
import pytest

from trialweave.llm import near_dedup as nd
from trialweave.llm.components import components, merge_labels


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_equals_edit_distance():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randint(1, 5) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randint(1, 5) for _ in range(rng.randint(0, 2))]
        limit = rng.randint(0, 12)
        assert nd.alignment_distance(a, b, limit) == min(levenshtein(a, b), limit + 1)


def test_long_distances():
    rng = random.Random(5)
    a = [rng.randint(1, 9) for _ in range(500)]
    b = [w if rng.random() > 0.18 else rng.randint(1, 9) for w in a]
    for limit in (40, 70, 100, 300):
        assert nd.alignment_distance(a, b, limit) == min(levenshtein(a, b), limit + 1)
        assert nd.alignment_distance(a, b[7:] + [1] * 3, limit) == min(levenshtein(a, b[7:] + [1] * 3), limit + 1)


def test_sketch_is_sensitive_to_order():
    words = [f"w{i}" for i in range(200)]
    moved = words[100:] + words[:100]
    a, b, same = (nd.order_sketch(nd.hashes_of(w)) for w in (words, moved, list(words)))
    assert (a == same).all()
    assert 0 < (a == b).sum() < nd.SKETCHES


def corpus(rng, families=12, copies=6):
    rows = []
    for _ in range(families):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(40, 120))]
        for _ in range(copies):
            words = [w if rng.random() > 0.015 else f"e{rng.randint(0, 10_000)}" for w in base]
            rows.append(" ".join(words))
    rows += [" ".join(f"u{rng.randint(0, 5_000)}" for _ in range(60)) for _ in range(40)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def brute_groups(rows):
    words = {i: nd.words_of(t) for i, t in rows}
    parent = {i: i for i in words}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in words if words[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            limit = nd.allowed_edits(len(words[a]), len(words[b]), nd.SIMILARITY)
            if abs(len(words[a]) - len(words[b])) <= limit and levenshtein(words[a], words[b]) <= limit:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in words}


def test_groups_equal_all_pairs(spark):
    rows = corpus(random.Random(6))
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, ""), (1003, None), (1004, "one two"), (1005, "One, two!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in nd.near_groups(docs).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("block", [1, 2, 1_024])
def test_links_between_members_that_the_leader_is_not_linked_to(spark, monkeypatch, block):
    """All texts share one bucket; only pairs that exclude the smallest id are similar."""
    monkeypatch.setattr(nd, "BLOCK", block)
    common = [f"s{i}" for i in range(30)]
    first = common + [f"a{i}" for i in range(30)]
    second = common + [f"b{i}" for i in range(30)]
    rows = [(0, " ".join(first))] + [(i, " ".join(second[: -i - 1] + [f"z{i}"])) for i in range(1, 6)]
    classes = spark.createDataFrame([(i, len(t.split()), [7] * 3) for i, t in rows], "node long, _words int, _picks array<long>")
    links, labels = nd.near_links(classes, spark.createDataFrame(rows, "node long, text string"))
    assert {r.node: r.label for r in labels.collect()} == {i: 1 for i in range(1, 6)}
    assert all(r.a > 0 for r in links.collect())


def test_block_links_span_all_components():
    rng = random.Random(8)
    rows = corpus(rng, 6, 8)
    words = {i: nd.words_of(t) for i, t in rows}
    codes = {i: nd.hashes_of(w) for i, w in words.items()}
    members = pd.DataFrame(
        [
            (i, i, len(w), i % 3, (codes[i] >> np.uint64(32)).astype(np.uint32).tobytes(), 0, [1, 2])
            for i, w in words.items()
        ],
        columns=["node", "label", "_words", "_block", "codes", "_j", "_picks"],
    )
    parent = {i: i for i in words}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in nd.link_block(members, nd.SIMILARITY):
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {i: root(i) for i in words} == brute_groups(rows)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)}


def test_merged_labels_are_those_of_all_links(spark):
    rng = random.Random(9)
    pairs = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(50)]
    df = lambda some: spark.createDataFrame(some, "a long, b long")
    want = {r.node: r.label for r in components(df(pairs)).collect()}
    got = merge_labels(components(df(pairs[:30])), df(pairs[30:]))
    assert {r.node: r.label for r in got.collect()} == want
    assert merge_labels(components(df([])), df(pairs)).count() == len(want)


def edited(rng, words, share, evenly):
    """A copy with floor(share * words) words replaced."""
    edits = int(share * len(words) + 1e-9)
    places = [(2 * i + 1) * len(words) // (2 * edits) for i in range(edits)] if evenly else rng.sample(range(len(words)), edits)
    out = list(words)
    for at in places:
        out[at] = f"x{rng.randint(0, 10**9)}"
    return out


@pytest.mark.parametrize("size", [5, 6, 10, 20, 40, 120, 400])
@pytest.mark.parametrize("share", [0.08, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("evenly", [False, True])
def test_scattered_edits_up_to_the_threshold_are_candidates(size, share, evenly):
    rng = random.Random(f"{size} {share}")
    found = 0
    for _ in range(200):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(size)]
        a, b = (nd.picks_of(nd.hashes_of(w)) for w in (words, edited(rng, words, share, evenly)))
        found += bool((a == b).any())
    assert found >= 196


def test_links_at_the_threshold(spark):
    rng = random.Random(12)
    rows = []
    for i, size in enumerate([5, 7, 12, 25, 33, 60, 150, 300] * 5):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(size)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, 0.2, i % 2)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_groups(docs).collect()}
    assert got == brute_groups(rows)


def test_wordless_copies_form_groups(spark):
    rows = [(1, "----"), (2, "----"), (3, "☃ ☃"), (4, "☃ ☃"), (5, "---"), (6, ""), (7, ""), (8, None), (9, None), (10, "a word")]
    got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {1: (1, 2, True), 2: (1, 2, False), 3: (3, 2, True), 4: (3, 2, False)} | {i: (i, 1, True) for i in range(5, 11)}
    assert {r.doc_id: (r.class_id, r.group_size, r.kept) for r in got} == want


def test_stage_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text, "x"), (2, text + " end", "y"), (9, "other words", None)], "doc_id long, text string, _rid string")
    assert sorted(map(tuple, nd.drop_near_copies(docs).select("doc_id", "_rid").collect())) == [(2, "y"), (9, None)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_groups(empty).count() == 0


def test_components_of_random_links(spark):
    rng = random.Random(21)
    for nodes, count in ((40, 15), (40, 40), (200, 150), (12, 60)):
        links = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)]
        parent = {x: x for pair in links for x in pair if pair[0] != pair[1]}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            if a != b:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: root(x) for x in parent}
