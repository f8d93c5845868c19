import random

import pytest
from pyspark.sql import functions as F

from trialweave.functions.text import hash_u
from trialweave.operators import labels, pairs, sampling, stats
from trialweave.operators.metrics import classification_report, confusion_matrix, span_metrics, token_metrics, weighted_metrics

SIZES = {"NO_RELATION": 1500, "AND": 300, "OR": 19, "once": 1, "five": 5}


@pytest.fixture(scope="module")
def labelled(spark):
    data = [(f"{label}{i}", label) for label, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(data, "k string, label string")


def test_hash_is_the_published_value(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert df.select(hash_u("x")).first()[0] == 214005177


@pytest.mark.parametrize("digits, bound", [(1, 100_000), (3, 100_000), (1, 10), (1, 1), (2, 0)])
def test_split_is_exact_and_equals_a_global_ranking(labelled, digits, bound):
    """With a small bound the bucket of a cut is refined by further digits until it is small."""
    import hashlib

    got = {r.k: r.split for r in sampling.stratified_split(labelled, "label", ["k"], 42, digits, bound).collect()}
    assert len(got) == sum(SIZES.values())
    for label, n in SIZES.items():
        keys = sorted((hashlib.md5(f"{label}{i}|42".encode()).hexdigest(), f"{label}{i}") for i in range(n))
        test = (n + 5) // 10
        held = test + (2 * (n - test) + 9) // 18
        for rank, (_, k) in enumerate(keys, 1):
            assert got[k] == ("test" if rank <= test else "validation" if rank <= held else "train")


def test_split_does_not_depend_on_partitions_or_on_the_small_table_bound(labelled, monkeypatch):
    one = set(sampling.stratified_split(labelled.coalesce(1), "label", ["k"]).collect())
    many = set(sampling.stratified_split(labelled.repartition(13), "label", ["k"]).collect())
    plain = sampling.join_small
    monkeypatch.setattr(sampling, "join_small", lambda *a, **k: plain(*a, **{**k, "max_rows": 0}))
    joined = set(sampling.stratified_split(labelled, "label", ["k"]).select("k", "label", "split").collect())
    assert {(r.k, r.split) for r in one} == {(r.k, r.split) for r in many} == {(r.k, r.split) for r in joined}


def test_downsample(labelled):
    every = sampling.downsample(labelled, None, ["k"])
    assert every.count() == sampling.downsample(labelled, 1.0, ["k"]).count() == sum(SIZES.values())
    thin = sampling.downsample(labelled, 0.2, ["k"])
    counts = {r.label: r["count"] for r in thin.groupBy("label").count().collect()}
    assert counts["AND"] == 300 and 220 < counts["NO_RELATION"] < 380
    assert set(thin.collect()) == set(sampling.downsample(labelled.repartition(5), 0.2, ["k"]).collect())
    assert sampling.downsample(labelled, 0.0, ["k"]).count() == sum(SIZES.values()) - SIZES["NO_RELATION"]
    split = sampling.stratified_split(labelled, "label", ["k"])
    kept = sampling.downsample(split, 0.0, ["k"], split="train").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in kept}["test"] == split.where("split = 'test'").count()


@pytest.mark.parametrize("bound", [10_000, 0])
def test_multilabel_split_uses_the_rarest_label(spark, monkeypatch, bound):
    monkeypatch.setattr(sampling, "MAX_SMALL_ROWS", bound)
    data = [(i, [0, 1, 1] + ([2] if i % 5 == 0 else []) + ([3] if i % 50 == 0 else [])) for i in range(500)] + [(999, [0, 0])]
    df = spark.createDataFrame(data, "k int, labels array<int>")
    out = sampling.multilabel_split(df, ["k"])
    got = {r.k: r.stratum for r in out.collect()}
    assert all(got[i] == (3 if i % 50 == 0 else 2 if i % 5 == 0 else 1) for i in range(500)) and got[999] == 0
    share = {
        r.label: r.p
        for r in out.select(F.explode(F.array_distinct("labels")).alias("label"), (F.col("split") == "test").cast("int").alias("t"))
        .groupBy("label").agg(F.avg("t").alias("p")).where("label > 0").collect()
    }
    assert all(abs(p - 0.1) <= 0.02 for p in share.values() if p)


def off_balance(rows):
    """Largest distance of a label's rows in a split from its share, beyond one row, in percent of the label."""
    totals, found = {}, {}
    for ids, split in rows:
        for i in set(ids) - {0}:
            totals[i] = totals.get(i, 0) + 1
            found[i, split] = found.get((i, split), 0) + 1
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    return max(max(0, abs(found.get((i, s), 0) - p * n) - 1) / n * 100 for i, n in totals.items() for s, p in shares.items())


def skewed_labels(n=4_000):
    """Labels that come along with rarer ones most of the time."""
    rng = random.Random(3)
    rows = []
    for k in range(n):
        ids = {1 + min(int(rng.expovariate(0.35)), 14) for _ in range(rng.randint(0, 4))}
        if 9 in ids or 12 in ids:
            ids |= {5, 20}
        rows.append((k, sorted(ids) + [0]))
    return rows


def test_iterative_split_balances_every_label(spark):
    data = skewed_labels()
    df = spark.createDataFrame(data, "k int, labels array<int>")
    split = lambda f: [(r.labels, r.split) for r in f(df, ["k"]).collect()]
    assert off_balance(split(sampling.iterative_split)) <= 1
    assert off_balance(split(sampling.multilabel_split)) > 1
    one, many = (set(sampling.iterative_split(d, ["k"]).select("k", "split").collect()) for d in (df.coalesce(1), df.repartition(9)))
    assert one == many and len(one) == len(data)
    counts = sampling.label_balance(sampling.iterative_split(df, ["k"])).collect()
    assert all(r.total == r.n_train + r.n_validation + r.n_test for r in counts)


def test_iterative_split_of_few_and_no_rows(spark):
    schema = "k int, labels array<int>"
    assert sampling.iterative_split(spark.createDataFrame([], schema), ["k"]).count() == 0
    rows = [(1, [1, 2]), (2, None), (3, []), (4, [0]), (5, [2]), (6, [None, 2])]
    got = sampling.iterative_split(spark.createDataFrame(rows, schema), ["k"]).collect()
    assert sorted(r.k for r in got) == [1, 2, 3, 4, 5, 6] and all(r.split for r in got)
    assert "_set" not in got[0].asDict()


def test_label_maps_and_encoding(spark, rows, labelled):
    types = spark.createDataFrame([("Value",), ("Drug",), ("Value",), ("Non-query-able",)], "type string")
    assert rows(labels.ner_label_map(types), "id") == [
        (0, "O"), (1, "B-Drug"), (2, "I-Drug"), (3, "B-Non-query-able"), (4, "I-Non-query-able"), (5, "B-Value"), (6, "I-Value"),
    ]
    m = labels.re_label_map(labels.drop_rare_labels(labelled, ("AND", "OR", "once", "five")))
    assert rows(m, "id") == [(0, "NO_RELATION"), (1, "AND"), (2, "OR"), (3, "five")]
    df = spark.createDataFrame([("AND",), ("zzz",)], "label string")
    assert sorted(rows(labels.encode_labels(df, m, unknown=-1))) == [("AND", 1), ("zzz", -1)]
    ids = spark.createDataFrame([(2,), (9,)], "label_id int")
    assert sorted(rows(labels.decode_labels(ids, m, unknown="ID_{id}"))) == [(2, "OR"), (9, "ID_9")]
    tags = spark.createDataFrame([(["B-Drug", "O", None, "B-x"],)], "tags array<string>")
    encoded = labels.encode_tags(tags, labels.ner_label_map(types))
    assert encoded.first().labels == [1, 0, -100, 0]
    assert labels.decode_tags(encoded, labels.ner_label_map(types), out="names").first().names == ["B-Drug", "O", "O", "O"]


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "label string")
    got = {r.label: r.weight for r in labels.class_weights(df).collect()}
    raw = {"a": (10 / (2 * 8)) ** 0.5, "b": (10 / (2 * 2)) ** 0.5}
    mean = sum(raw.values()) / 2
    assert all(abs(got[k] - raw[k] / mean) < 1e-12 for k in raw)


def test_presence(spark, rows):
    df = spark.createDataFrame([(1, [0, 2, 2, 5]), (2, [0])], "k int, labels array<int>")
    assert rows(labels.label_presence(df, ["k"]), "label_id") == [(1, 2), (1, 5)]
    assert rows(df.select("k", labels.presence_vector(F.col("labels"), [2, 5])), "k") == [(1, [1, 1]), (2, [0, 0])]


def test_pair_statistics(spark):
    mentions = spark.createDataFrame(
        [("f", 0, "T1"), ("f", 0, "T2"), ("f", 0, "T3"), ("f", 1, "T4")], "file string, line_no int, id string"
    )
    relations = spark.createDataFrame(
        [("f", 0, 0, "AND", "T1", "T2"), ("f", 1, 0, "AND", "T1", "T4"), ("f", 2, 0, "odd", "T2", "T1"), ("f", 3, 0, "NO_RELATION", "T3", "T1")],
        "file string, ann_line int, perm_no int, rel_type string, arg1 string, arg2 string",
    )
    r = stats.pair_statistics(mentions, relations).first()
    assert (r.total_pairs, r.positives, r.negatives_kept, r.negatives_dropped) == (6, 1, 5, 0)
    assert (r.rejected, r.rejected_types, r.neg_pos_ratio) == (1, ["odd"], 5.0)
    labelled = pairs.label_pairs(mentions.select("*", *[F.lit(0).alias(c) for c in ("type", "start", "end")]), relations)
    assert labelled.where("label <> 'NO_RELATION'").count() == 1


def test_distributions(spark, rows):
    df = spark.createDataFrame([("train", "NO_RELATION")] * 6 + [("train", "AND")] * 3 + [("train", "OR")] + [("test", "NO_RELATION")], "split string, label string")
    assert rows(stats.label_distribution(df, "label").where("split = 'train'").select("label", "percent")) == [
        ("AND", 30.0), ("NO_RELATION", 60.0), ("OR", 10.0),
    ]
    assert rows(stats.re_statistics(df)) == [
        ("test", None, 0, None, 1, 0, 1, None),
        ("train", "AND", 3, 75.0, 10, 4, 6, 1.5),
        ("train", "OR", 1, 25.0, 10, 4, 6, 1.5),
    ]


def test_ner_statistics(spark, rows):
    df = spark.createDataFrame(
        [("train", ["B-a", "I-a", "O", "B-a"]), ("train", ["I-b", "B-b"]), ("train", ["O"]), ("test", [])], "split string, tags array<string>"
    )
    assert rows(stats.ner_statistics(df)) == [
        ("test", None, 0, None, 1),
        ("train", None, 3, None, 3),
        ("train", "a", 2, 1.5, None),
        ("train", "b", 1, 1.0, None),
    ]


# ---- metrics -------------------------------------------------------------------------------

PAIRS = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")] * 2


def test_weighted_metrics(spark):
    df = spark.createDataFrame(PAIRS, "truth string, pred string")
    r = weighted_metrics(df).first()
    pa, ra, pb, rb = 1.0, 0.75, 2 / 3, 0.5
    fa, fb = 2 * pa * ra / (pa + ra), 2 * pb * rb / (pb + rb)
    assert r.accuracy == 0.625
    assert abs(r.precision - (pa + pb) / 2) < 1e-12 and abs(r.recall - (ra + rb) / 2) < 1e-12 and abs(r.f1 - (fa + fb) / 2) < 1e-12


def test_report_and_matrix_hold_every_mapped_label(spark, rows):
    df = spark.createDataFrame(PAIRS, "truth string, pred string")
    label_map = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "never")], "id int, label string")
    report = {r.name: r for r in classification_report(df, label_map).collect()}
    assert list(report) == ["a", "b", "c", "never", "accuracy", "macro avg", "weighted avg"]
    assert report["never"].support == 0 and report["c"].precision == 0.0 and report["accuracy"].f1 == 0.625
    assert abs(report["macro avg"].recall - 1.25 / 4) < 1e-12 and report["weighted avg"].support == 8
    cells = rows(confusion_matrix(df, label_map).select("truth", "pred", "n", "share"))
    assert len(cells) == 16 and cells[:2] == [("a", "a", 3, 0.75), ("a", "b", 1, 0.25)]
    assert all(c[2:] == (0, 0.0) for c in cells if c[0] in ("c", "never"))


def test_token_and_span_metrics(spark):
    df = spark.createDataFrame(
        [
            (["B-a", "I-a", "O", "B-b"], ["B-a", "I-a", "O", "I-b"]),
            (["O", "B-a"], ["B-b", "B-a"]),
            ([None, "O", "B-a"], ["B-a", "O", "O"]),
            (["O"], ["O"]),
        ],
        "t array<string>, p array<string>",
    )
    tok = {r.label: r for r in token_metrics(df, "t", "p").collect()}
    assert set(tok) == {"overall", "a", "b", "O"} and abs(tok["overall"].accuracy - 7 / 9) < 1e-12
    assert tok["a"].precision == 1.0 and tok["a"].recall == 0.75 and tok["b"].precision == 0.5
    span = {r.label: r for r in span_metrics(df, "t", "p").collect()}
    # truth: a(0,1) b(3) a(1) a(1); prediction: a(0,1) b(3, stray I) b(0) a(1)
    assert (span["a"].precision, span["a"].recall) == (1.0, 2 / 3)
    assert (span["b"].precision, span["b"].recall) == (0.5, 1.0)
    assert (span["overall"].precision, span["overall"].recall, span["overall"].support) == (0.75, 0.75, 4)
    assert abs(span["overall"].accuracy - 6 / 9) < 1e-12
    strict = {r.label: r for r in span_metrics(df, "t", "p", "strict").collect()}
    assert strict["b"].recall == 0.0


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "t array<string>, p array<string>")
    assert [r.label for r in span_metrics(df, "t", "p").collect()] == []
    assert weighted_metrics(spark.createDataFrame([], "truth string, pred string")).first().f1 == 0.0


def test_present_labels_are_made_distinct_before_they_are_filtered(spark):
    df = spark.createDataFrame([(1, [3, -100, 0, 3, None, 2]), (2, []), (3, None)], "k int, labels array<int>")
    seen = df.select("k", sampling._present("labels").alias("p"))
    assert "filter(array_distinct(labels" in seen._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, seen.collect())) == [(1, [3, 2]), (2, []), (3, None)]
