import math
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL

from trialweave.llm import whitening
from trialweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def f32(v):
    return None if v is None else [None if x is None else np.float32(x).item() for x in v]


def brute(rows):
    """n, exact deviations and the covariance matrix in fractions."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for _, v in good), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (d - len(v)) for _, v in good]
    n = len(x)
    s = [sum(col) for col in zip(*x, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    cov = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)]
    return [i for i, _ in good], x, n, s, dev, np.array(cov)


def compare(got, rows):
    ids, x, n, s, dev, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(ids) * min(8, len(values))
    y = (np.array(x, object) * n - np.array(s, object)).astype(float) / n
    for k in range(min(8, len(values))):
        white = y @ vectors[:, k] / math.sqrt(values[k])
        mine = [by[i, d][k + 1][0] for i, d in zip(ids, dev, strict=True)]
        assert all(r.n == n and math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9) for r in mine)
        assert all(abs(r.identity_error) < 1e-9 for r in mine)
        sign = np.sign(sum(r.whitened * w for r, w in zip(mine, white, strict=True)))
        assert np.allclose([r.whitened * sign for r in mine], white, atol=1e-8)


def test_equals_exact_fractions(spark):
    rng = random.Random(3)
    rows = [(i, f32([rng.gauss(0, 1 + k) for k in range(11)])) for i in range(400)]
    rows += [(9_000, None), (9_001, [None] * 11), (9_002, [float("nan")] * 11), (9_003, [float("inf")] * 11), (9_004, []), (9_005, [1.0]), (3, rows[3][1]), (None, rows[5][1])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    compare(got, rows)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e9, 9e12) for _ in range(3)]) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    compare(got, rows)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(huge).collect()) == 6


def test_polarisation_equals_cross_sums():
    rng = np.random.default_rng(5)
    for top in (1 << 40, 1 << 49):
        y = rng.integers(-top, top, (1_000, 5))
        i, j = np.triu_indices(5)
        for got, a, b in zip(whitening.polarised(y), i, j, strict=True):
            z = y[:, a].astype(object) + (0 if a == b else y[:, b].astype(object))
            assert got == sum(int(v) ** 2 for v in z)


@pytest.mark.parametrize("rows, found", [([], 0), ([(1, None)], 0), ([(1, [])], 0), ([(1, [2.0, 3.0])], 2), ([(1, [2.0]), (2, [2.0])], 2)])
def test_no_variance(spark, rows, found):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == found and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)


def test_a_component_without_variance_has_no_value(spark):
    rows = [(i, [float(i), 1.0]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True}
    assert all(r.identity_error < 1e-9 for r in got)


def test_clashing_columns_are_not_read(spark):
    rows = [(i, [float(i), float(i * i % 7)], i, "a") for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, id string")
    plain = sorted(map(tuple, whitening.whiten(df.select("vec_id", "embedding")).collect()))
    assert sorted(map(tuple, whitening.whiten(df).collect())) == plain


def test_query_over_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    df = QUERIES["op13_whitening"](spark, SMALL)
    assert dict(df.dtypes)["deviation"] == "bigint"
    compare(df.collect(), rows)
