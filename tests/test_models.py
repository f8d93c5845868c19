import pytest
from pyspark.sql import functions as F

from trialweave.operators import models
from trialweave.plans import datasets
from trialweave.plans.extraction import run_extraction

LABELS = ("NO_RELATION", "AND")


def factories():
    """Defined inside a function, so that they travel by value: this test module is not on the workers."""

    def make_tagger():
        def tag(texts):
            return [
                [
                    {"entity_group": "Drug", "word": w, "start": t.index(w), "end": t.index(w) + len(w), "score": 1}
                    for w in t.split()
                    if w.isupper()
                ]
                for t in texts
            ]

        return tag

    def make_scorer():
        return lambda texts: [[0.0, 1.0 if t.index("[E1]") < t.index("[E2]") else -1.0] for t in texts]

    return make_tagger, make_scorer


make_tagger, make_scorer = factories()


@pytest.fixture
def sentences(spark):
    return spark.createDataFrame([(0, "N1", "AB with CD"), (1, "N2", "nothing"), (2, "N3", None)], "sentence_id bigint, studyNCTid string, text string")


def test_extraction_modes(sentences):
    tagged = run_extraction(sentences, "ner", make_tagger)
    got = {r.sentence_id: r for r in tagged.collect()}
    assert [e.word for e in got[0].entities] == ["AB", "CD"] and got[1].entities == [] and got[2].text == ""
    assert got[0].nct_id == "N1" and got[0].criteria_type == "unknown" and got[0].entities[0].confidence_score == 1.0
    full = {r.sentence_id: r for r in run_extraction(sentences, "ner+re", make_tagger, make_scorer, LABELS).collect()}
    assert [tuple(x) for x in full[0].relations] == [("AB", "Drug", "CD", "Drug", "AND", 0.7311, "[E1]AB[/E1] with [E2]CD[/E2]")]
    assert full[1].relations == [] and len(full) == 3
    again = run_extraction(tagged.withColumnRenamed("nct_id", "studyNCTid"), "re", make_scorer=make_scorer, labels=LABELS)
    assert sorted(r.sentence_id for r in again.collect() if r.relations) == [0]
    assert run_extraction(sentences, "ner", make_tagger, limit=1).count() == 1
    with pytest.raises(ValueError):
        run_extraction(sentences, "all")


def test_python_runs_once_and_only_on_the_text(sentences):
    from pyspark.sql import SparkSession

    calls = SparkSession.getActiveSession().sparkContext.accumulator(0)

    def counted():
        tag = make_tagger()

        def run(texts):
            calls.add(len(texts))
            return tag(texts)

        return run

    full = run_extraction(sentences, "ner+re", counted, make_scorer, LABELS)
    assert full.count() == 3 and calls.value == 3
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [tag" not in plan
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("ArrowEvalPython [score") == 1


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 0, "block_rows": 2, "fraction": 1.0}])
def test_lexicon_tagger_against_brute_force(spark, options):
    mentions = spark.createDataFrame(
        [("Heart failure", "Condition"), ("heart", "Organ"), ("Heart", "Organ"), ("heart", "Drug"), ("failure of", "X"), ("38.5", "Value"), ("tie", "B"), ("tie", "A")],
        "text string, type string",
    )
    lexicon = models.build_lexicon(mentions)
    table = {r.surface: r.type for r in lexicon.collect()}
    assert table["heart"] == "Organ" and table["tie"] == "A"
    texts = ["HEART failure of heart, tie", "failure of heart failure", "38.5 or 38 . 5", "", "Heart Heart heart failure"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: [tuple(e)[:4] for e in r.entities] for r in models.lexicon_tagger(df, lexicon, ["k"], **options).collect()}
    assert got == {
        0: [("Condition", "HEART failure", 0, 13), ("Organ", "heart", 17, 22), ("A", "tie", 24, 27)],
        1: [("X", "failure of", 0, 10), ("Condition", "heart failure", 11, 24)],
        2: [("Value", "38.5", 0, 4)],
        3: [],
        4: [("Organ", "Heart", 0, 5), ("Organ", "Heart", 6, 11), ("Condition", "heart failure", 12, 25)],
    }


TEXT = "aspirin needs high dose\nfever and cough with aspirin\n"


def ann(i):
    return "\n".join(
        [
            "T1\tDrug 0 7\taspirin",
            "T2\tValue 14 23\thigh dose",
            "T3\tCondition 24 29\tfever",
            "T4\tCondition 34 39\tcough",
            "T5\tDrug 45 52\taspirin",
            "R1\tHas_value Arg1:T1 Arg2:T2",
            "*\tAND T3 T4",
        ]
    )


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(f"D{i}_inc", TEXT, ann(i)) for i in range(60)], "file string, text string, ann_text string")


LEARNERS = [("counts", {}), ("logistic", {"num_features": 1 << 8, "max_iter": 30})]


@pytest.mark.parametrize("learner, params", LEARNERS)
def test_tagger_training_learns_the_rule(documents, learner, params):
    data, label_map = datasets.tagger_dataset(documents)
    key = datasets.LINE_KEY
    assert data.count() == 120
    model = models.train_tagger(data.where("split = 'train'"), key, learner, **params)
    report = {(r.level, r.label): r for r in models.evaluate_tagger(model, data.where("split = 'test'"), label_map, key).collect()}
    assert report[("span", "overall")].f1 > 0.95 and report[("token", "overall")].accuracy > 0.95
    assert ("span", "Drug") in report


def test_relation_training_learns_the_rule(spark, documents):
    data, label_map = datasets.relation_dataset(documents, train_rate=0.8)
    assert {r.label for r in label_map.collect()} == {"NO_RELATION", "AND", "Has_value"}
    # Line 1 gives 2 pairs, line 2 gives 6, in every document.
    assert data.where("split <> 'train'").count() == sum(
        t + (2 * (n - t) + 9) // 18 for n in (60, 120, 300) for t in [(n + 5) // 10]
    )
    train = data.where("split = 'train'")
    best, trials = models.tune(
        train, data.where("split = 'validation'"), label_map, [{"num_features": 1 << 8, "max_iter": m, "reg_param": 1e-4} for m in (1, 30)]
    )
    f1 = [r.f1 for r in trials.orderBy("trial").collect()]
    assert f1[1] >= f1[0]
    overall, report, matrix = models.evaluate_relations(best, data.where("split = 'test'"), label_map)
    assert overall.first().f1 > 0.9 and report.count() == 6 and matrix.count() == 9
    for learner, params in LEARNERS:
        plain = models.train_relation_model(train, label_map, learner, **params)
        assert models.predict_relations(plain, train, label_map).where("pred = label").count() > 0.9 * train.count()
    best, trials = models.tune_relations(train, data.where("split = 'validation'"), label_map, (1.0, 1e6))
    f1 = [r.f1 for r in trials.orderBy("trial").collect()]
    assert best.alpha == 1.0 and f1[0] > f1[1]


def test_count_model_is_naive_bayes(spark):
    from math import log

    from trialweave.operators.count_models import fit_counts, label_choices, predict_counts

    train = spark.createDataFrame([(["a", "a", "b"], "x", 2.0), (["b"], "y", 1.0), (["c", "b"], "y", 1.0)], "feats array<string>, label string, w double")
    model = fit_counts(train, weight="w", alpha=0.5)
    assert model.vocabulary == 3
    test = spark.createDataFrame([(1, ["a", "zz"]), (2, ["b", "c"]), (3, [])], "k int, feats array<string>")

    def score(label, feats, alpha):
        n, total, counts = {"x": (2, 6, {"a": 4, "b": 2}), "y": (2, 3, {"b": 2, "c": 1})}[label]
        return log(n / 4) + sum(log((counts.get(f, 0) + alpha) / (total + 3 * alpha)) for f in feats)

    for options in ({}, {"max_broadcast": 0, "block_rows": 1, "fraction": 1.0}):
        got = {r.k: r for r in label_choices(model, test, ["k"], (0.5, 4.0), **options).collect()}
        for k, feats in ((1, ["a", "zz"]), (2, ["b", "c"]), (3, [])):
            for i, alpha in enumerate((0.5, 4.0)):
                want = min("xy", key=lambda label: (-round(score(label, feats, alpha), 6), label))
                assert got[k].choices[i].label == want
    assert {r.k: r.pred for r in predict_counts(model, test, ["k"]).collect()}[3] == "x"


def test_features_are_made_once(spark):
    """Neither the count of the features nor a filter of empty lists works them out again."""
    from trialweave.operators.count_models import fit_counts, label_choices

    train = spark.createDataFrame([(["a b", "b c"], "x"), (["b d"], "y")], "feats array<string>, label string")
    model = fit_counts(train)
    texts = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "b")], "k int, marked string")
    chosen = label_choices(model, texts.select("k", models.marked_bigrams().alias("feats")), ["k"])
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # their number and their gains
    assert sorted(r.k for r in chosen.collect()) == [1, 2, 3, 4]
    pairs = spark.createDataFrame(
        [("f", "b a c", 0, 1, 2, 3, "x", "1", "2"), ("f", "d c", 0, 1, 2, 3, "y", "1", "3")],
        "file string, text string, e1_start int, e1_end int, e2_start int, e2_end int, label string, e1_id string, e2_id string",
    )
    label_map = spark.createDataFrame([(0, "x"), (1, "y")], "id int, label string")
    found = models.predict_relations(models.train_relation_model(pairs, label_map), pairs, label_map)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == [*["file", "e1_id", "e2_id"], *[c for c in pairs.columns if c not in ("file", "e1_id", "e2_id")], "pred"]
    assert {(r.e2_id, r.text, r.pred) for r in found.collect()} == {("2", "b a c", "x"), ("3", "d c", "y")}
