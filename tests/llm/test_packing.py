import random
from itertools import combinations

import numpy as np
import pytest

from trialweave.llm import packing
from trialweave.llm.packing import GRID, optimal_boundaries, pack, pack_documents, round_up


def padding(lengths, counts, tokens, bounds):
    total = 0
    for length, n, t in zip(lengths, counts, tokens, strict=True):
        total += n * min(b for b in bounds if b >= length) - t
    return total


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 9))))
        counts = np.array([rng.randint(1, 20) for _ in lengths])
        tokens = lengths * counts
        k = rng.randint(1, 5)
        best = min(
            padding(lengths, counts, tokens, [*some, lengths[-1]])
            for n in range(min(k, len(lengths)))
            for some in combinations(lengths[:-1].tolist(), n)
        )
        bounds = optimal_boundaries(lengths, counts, tokens, k)
        assert len(bounds) <= k and bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1]
        assert padding(lengths, counts, tokens, bounds) == best


def test_grid_covers_every_length(spark):
    values = [0, 1, 2_047, 2_048, 2_049, 4_096, 4_097, 123_457, 10**9 + 7]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "n long").select(round_up(F.col("n"))).collect()]
    assert all(v <= g <= v * (1 + 1 / 64) for v, g in zip(values, got, strict=True))
    assert got[:4] == values[:4] and GRID < 10_000


@pytest.mark.parametrize("slice_rows", [10, 100_000])
def test_batches_fill_the_budget(spark, slice_rows):
    rng = random.Random(2)
    rows = [(i % 300, int(rng.paretovariate(1.2) * 10)) for i in range(1_000)] + [(None, 0), (7, 500_000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=5, budget=2_000, slice_rows=slice_rows).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((d or -1, n) for d, n in rows)
    batches = {}
    for r in got:
        assert r.padded >= r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), own in batches.items():
        per = max(1, 2_000 // max(1, own[0].padded))
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= per
        if len(own) < per:
            assert batch == max(b for k, b in batches if k == bucket)


def test_documents_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b  c"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in pack_documents(docs).collect()) == [(1, 3), (2, 0), (3, 0)]
    assert pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [16_384, 5])
def test_long_buckets_pad_to_their_longest_row(spark, monkeypatch, limit):
    """With all lengths exact the bounds are the best ones; on the grid `padded` still is the longest length."""
    monkeypatch.setattr(packing, "LENGTHS", limit)
    lengths = [3, 9, 5_001, 5_003, 20_001, 70_003, 100_001]
    rows = pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), buckets=3).collect()
    longest = {}
    for r in rows:
        longest[r.bucket] = max(longest.get(r.bucket, 0), r.n_tokens)
    assert all(r.padded == longest[r.bucket] for r in rows)
    if limit > len(lengths):
        best = min(
            sum(min(b for b in (*cut, 100_001) if b >= n) for n in lengths) for cut in combinations(lengths[:-1], 2)
        )
        assert sum(r.padded for r in rows) == best


def test_clashing_columns(spark):
    rows = [(i, "w " * (i % 7), i, "x", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket long, _slice string, padded int")
    shown = lambda d: sorted(map(tuple, packing.pack_documents(d, buckets=3, budget=20).collect()))
    assert shown(df) == shown(df.select("doc_id", "text"))
    named = packing.pack_documents(df, id_col="bucket", buckets=3, budget=20)
    assert named.columns == ["bucket_id", "n_tokens", "bucket", "padded", "batch", "slot"] and named.count() == 60


def test_boundaries_are_exact_beyond_any_number_of_lengths(spark, monkeypatch):
    """the number of distinct lengths does not change the bounds; only the caller asks for the grid."""
    lengths = [3, 9, 5_001, 5_003, 20_001, 70_003, 100_001]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    few = packing.boundaries(df, 3)
    monkeypatch.setattr(packing, "LENGTHS", 2)
    assert packing.boundaries(df, 3) == few and set(few) <= set(lengths)
    assert packing.boundaries(df, 3, grid=True)[-1] > lengths[-1]
