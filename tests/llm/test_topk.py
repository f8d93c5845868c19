import math
import random

import pytest

from pyspark.sql import functions as F

from trialweave.llm import topk
from trialweave.llm.topk import top_k


def brute(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(good):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(good) if m != n)[:k]  # noqa: B905
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("values", ["float", "coarse"])
def test_equals_brute_force(spark, values):
    rng = random.Random(5)
    draw = (lambda: rng.uniform(-1, 1)) if values == "float" else (lambda: rng.choice([-0.5, 0.0, 0.25]))
    rows = [(i, [draw() for _ in range(6)]) for i in range(1_000)]
    rows += [(2_000, None), (2_001, []), (2_002, [None, 1.0]), (2_003, [float("nan")] * 6), (2_004, [float("inf")] * 6), (None, [1.0] * 6), (2_100, [0.5, 0.5]), (300, rows[300][1]), (301, rows[301][1])]
    rows = [(i, None if v is None else [None if x is None else __import__("numpy").float32(x).item() for x in v]) for i, v in rows]
    got = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), block=16, shard=4, query_rows=4)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [3e5, 1.0]), (1, [3e5, -1.0]), (2, [3e5, 2.0])]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    assert top_k(spark.createDataFrame([(100, [1.0])], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def grouped_vectors(rng, groups=40, size=50, dims=12):
    centers = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    rows = [(g, [c + rng.uniform(-0.03, 0.03) for c in centers[g]]) for g in range(groups) for _ in range(size)]
    rng.shuffle(rows)
    return [(i, v) for i, (_, v) in enumerate(rows)]


def test_most_blocks_of_grouped_vectors_are_not_scored(spark):
    rows = grouped_vectors(random.Random(8))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    assert sorted(map(tuple, top_k(df, block=16, shard=8, query_rows=5).collect())) == brute(rows)
    found = topk.candidates(df.toDF("id", "vector"), 10, 100, 16, 8, 5, centers=64)
    queries = len([i for i, _ in rows if i % 100 == 0])
    scored = found.agg(F.sum("blocks")).first()[0]
    assert scored < 0.5 * queries * len(rows) / 16


def test_excluded_blocks_are_not_sent(spark):
    """A block whose bounds stay below the floors of a group is in no pair to score."""
    vectors = [(i, [1.0, 0.0] if i < 32 else [-1.0, 0.1]) for i in range(64)]
    rows = spark.createDataFrame([(i, v, i, int(i >= 32)) for i, v in vectors], "id long, vector array<double>, rid long, center int").coalesce(1)
    blocks = topk.write_table(topk.map_arrow(rows, topk._blocks(8, True), topk.BLOCKS).withColumn("block", F.monotonically_increasing_id()))
    queries = topk.map_arrow(rows.where("id = 0"), topk._blocks(4, False), topk.BLOCKS).withColumn("number", F.lit(0).cast("bigint"))
    floored = queries.withColumn("floors", F.lit(bytearray(__import__("numpy").full(1, 500_000.0).tobytes())))
    search = topk._Search(blocks, topk.write_table(queries), 2, 10)
    assert blocks.count() == 8 and search.to_score(floored, 2, True).count() == 4 and 0 < search.to_score(queries, 2, False).count() <= 2 * search.shards


def test_clashing_columns_are_not_read(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], 0, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rid int, center string")
    assert sorted(map(tuple, top_k(df).collect())) == brute([r[:2] for r in rows])
