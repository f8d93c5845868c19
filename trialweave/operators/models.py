"""Model application and training (H1-H8).

User models enter as factories: the factory travels to the executors and is called once
per task, the model it returns works on whole batches. Only the text column crosses to
Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.markers import inject_markers
from trialweave.functions.tags import argmax, softmax_confidence
from trialweave.functions.text import let
from trialweave.operators.annotations import NO_RELATION
from trialweave.operators.chain import ChainModel, fit_chain, predict_chain
from trialweave.operators.count_models import CountModel, fit_counts, label_choices, predict_counts
from trialweave.operators.labels import class_weights, encode_labels
from trialweave.operators.metrics import classification_report, confusion_matrix, span_metrics, token_metrics, weighted_metrics
from trialweave.operators.pairs import TILE, nested_pairs, overlaps
from trialweave.operators.skew import join_on_hot_key, join_small
from trialweave.operators.spans import nest_found
from trialweave.operators.tokens import located_tokens, text_pieces, word_tokens
from trialweave.session import write_table
from trialweave.sources.studies import ENTITIES

# A batch of texts to one list of mention dicts, or of label scores, per text.
Tagger = Callable[[Sequence[str]], Sequence[Sequence[dict]]]
Scorer = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def tag_entities(sentences: DataFrame, make_tagger: Callable[[], Tagger], text: str = "text") -> DataFrame:
    """H1: add `entities` as given by a batch tagger (texts -> lists of mention dicts)."""

    @F.pandas_udf(ENTITIES)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = make_tagger()
        for batch in batches:
            yield pd.Series(
                [
                    [
                        {
                            "entity_group": m["entity_group"],
                            "word": m["word"],
                            "start": int(m["start"]),
                            "end": int(m["end"]),
                            "confidence_score": float(m.get("confidence_score", m.get("score"))),
                        }
                        for m in mentions
                    ]
                    for mentions in tagger(batch.tolist())
                ]
            )

    return sentences.withColumn("entities", tag.asNondeterministic()(F.col(text)))


def build_lexicon(mentions: DataFrame, surface: str = "text", kind: str = "type") -> DataFrame:
    """H2: (surface, type, n_tokens) from gold mentions; the majority type, ties by name."""
    low = F.lower(F.col(surface))
    counts = (
        mentions.groupBy(low.alias("surface"), F.col(kind).alias("type")).agg(F.count("*").alias("n")).where("surface <> ''")
    )
    best = counts.groupBy("surface").agg(F.min(F.struct((-F.col("n")).alias("neg"), "type"))["type"].alias("type"))
    return best.withColumn("n_tokens", F.size(word_tokens(F.col("surface")))).where("n_tokens > 0")


def folded(c: Column) -> Column:
    """Lower case, with one form of sigma, so that a token folds alike alone and inside a text."""
    return F.translate(F.lower(c), "ς", "σ")


def lexicon_tagger(
    sentences: DataFrame,
    lexicon: DataFrame,
    key: Sequence[str],
    text: str = "text",
    fraction: float = 0.01,
    **join_options: int,
) -> DataFrame:
    """H2: add `entities` by dictionary lookup, leftmost and longest first, without overlaps.

    Tokens are joined with the first tokens of the entries and the entry lengths that begin
    with them; only those n-grams are made, and joined with the lexicon by surface. Both
    tables are broadcast while they are counted to fit; beyond that frequent tokens and
    n-grams are hot keys, found on a sample of the sentences. The greedy choice runs inside
    a sentence.
    """
    lexicon = write_table(lexicon, "lexicon")
    first = folded(word_tokens(F.col("surface"))[0]["token"])
    heads = (
        lexicon.select(first.alias("first"), "n_tokens").groupBy("first").agg(F.sort_array(F.collect_set("n_tokens")).alias("lengths"))
    )

    def tokens_of(rows: DataFrame) -> DataFrame:
        folds = F.transform(word_tokens(F.col(text)), lambda t: folded(t["token"]))
        return rows.select(*key, F.posexplode(folds).alias("pos", "first"))

    some = sentences.sample(fraction, seed=1)
    starts = (
        join_on_hot_key(tokens_of(sentences), heads, ["first"], [*key, "pos"], "inner", tokens_of(some), fraction, **join_options)
        .groupBy(*key)
        .agg(F.collect_list(F.struct("pos", "lengths")).alias("_starts"))
    )

    def grams_of(rows: DataFrame) -> DataFrame:
        def gram(pieces: Column, t: Column, pos: Column, n: Column) -> Column:
            return let(
                F.struct(t[pos].alias("a"), t[pos + n - 1].alias("b")),
                lambda ends: F.struct(
                    ends["a"]["start"].alias("start"),
                    ends["b"]["end"].alias("end"),
                    F.array_join(F.slice(pieces, ends["a"]["at"] + 1, ends["b"]["at"] - ends["a"]["at"] + 1), "").alias("word"),
                ),
            )

        def grams(pieces: Column, t: Column) -> Column:
            return F.flatten(
                F.transform(
                    "_starts",
                    lambda s: F.transform(
                        F.filter(s["lengths"], lambda n: s["pos"] + n <= F.size(t)), lambda n: gram(pieces, t, s["pos"], n)
                    ),
                )
            )

        spans = let(text_pieces(F.col(text)), lambda p: let(located_tokens(p), lambda t: grams(p, t)))
        exploded = rows.select(*key, text).join(starts, list(key)).select(*key, F.explode(spans).alias("z"))
        return exploded.select(*key, "z.start", "z.end", "z.word", F.lower("z.word").alias("surface"))

    hits = join_on_hot_key(
        grams_of(sentences),
        lexicon.select("surface", "type"),
        ["surface"],
        [*key, "start", "end"],
        "inner",
        grams_of(some),
        fraction,
        **join_options,
    )

    empty = F.array().cast(ENTITIES)

    def pick(acc: Column, m: Column) -> Column:
        entity = F.struct(
            m["type"].alias("entity_group"), m["word"].alias("word"), m["start"].alias("start"),
            (-m["neg_end"]).alias("end"), F.lit(1.0).alias("confidence_score"),
        )
        return F.when(
            m["start"] >= acc["last"],
            F.struct(entity["end"].alias("last"), F.concat(acc["found"], F.array(entity)).alias("found")),
        ).otherwise(acc)

    ordered = F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("neg_end"), "word", "type")))
    chosen = hits.groupBy(*key).agg(ordered.alias("m")).select(
        *key,
        F.aggregate("m", F.struct(F.lit(0).alias("last"), empty.alias("found")), pick)["found"].alias("entities"),
    )
    return sentences.join(chosen, list(key), "left").withColumn("entities", F.coalesce("entities", empty))


def score_pairs(sentences: DataFrame, make_scorer: Callable[[], Scorer], key: str = "sentence_id") -> DataFrame:
    """The scored candidate pairs of H3: (key, i, j, e1, e2, marked_context, scores)."""
    pairs = nested_pairs(sentences.select(key, "text", "entities"), tile=TILE).where(
        ~overlaps(F.col("e1.start"), F.col("e1.end"), F.col("e2.start"), F.col("e2.end"))
    )
    marked = inject_markers(
        F.col("text"), F.col("e1.start"), F.col("e1.end"), F.col("e2.start"), F.col("e2.end"), bounds="skip"
    )

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for batch in batches:
            yield pd.Series([[float(v) for v in row] for row in scorer(batch.tolist())])

    return pairs.select(key, "i", "j", "e1", "e2", marked.alias("marked_context")).withColumn(
        "scores", score.asNondeterministic()(F.col("marked_context"))
    )


def found_relations(sentences: DataFrame, make_scorer: Callable[[], Scorer], labels: Sequence[str], key: str = "sentence_id") -> DataFrame:
    """The predicted relations of H3 as pair numbers: key, i, j, relation, confidence_score. No text is kept."""
    names = F.array(*[F.lit(x) for x in labels])
    scored = score_pairs(sentences, make_scorer, key).select(key, "i", "j", "scores")
    named = scored.withColumn("relation", names[argmax(F.col("scores"))]).where(F.col("relation") != NO_RELATION)
    return named.select(key, "i", "j", "relation", softmax_confidence(F.col("scores")).alias("confidence_score"))


def score_relations(
    sentences: DataFrame, make_scorer: Callable[[], Scorer], labels: Sequence[str], key: str = "sentence_id"
) -> DataFrame:
    """H3: one row per predicted relation (key, i, j and the T14 fields); NO_RELATION is left out.

    `labels[k]` names score k. Overlapping pairs are dropped before they are scored.
    """
    names = F.array(*[F.lit(x) for x in labels])
    return (
        score_pairs(sentences, make_scorer, key)
        .withColumn("relation", names[argmax(F.col("scores"))])
        .where(F.col("relation") != NO_RELATION)
        .select(
            key,
            "i",
            "j",
            F.col("e1.word").alias("arg1"),
            F.col("e1.entity_group").alias("arg1_type"),
            F.col("e2.word").alias("arg2"),
            F.col("e2.entity_group").alias("arg2_type"),
            "relation",
            softmax_confidence(F.col("scores")).alias("confidence_score"),
            "marked_context",
        )
    )


# ---- training ------------------------------------------------------------------------------


def token_rows(samples: DataFrame, key: Sequence[str], labels: str | None = "labels") -> DataFrame:
    """One row per real token with its window features (word, neighbours, shape, affixes).

    The window lies inside the sentence's array, so no row needs its neighbours' rows.
    """
    parts = [F.col("tokens").alias("token"), F.col("attention_mask").alias("mask")]
    if labels:
        parts.append(F.col(labels).alias("label"))
    rows = samples.select(*key, "tokens", F.posexplode(F.arrays_zip(*parts)).alias("pos", "z")).where(
        "z.mask = 1 AND pos > 0"
    )
    word = F.lower("z.token")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("z.token", "\\p{Lu}", "X"), "\\p{Ll}", "x"), "[0-9]", "d")
    near = lambda d: F.lower(F.coalesce(F.get("tokens", F.col("pos") + d), F.lit("")))
    feature = lambda name, c: F.concat(F.lit(name + "="), c)
    features = F.array(
        feature("w", word),
        feature("p", near(-1)),
        feature("n", near(1)),
        feature("s", F.substring(shape, 1, 8)),
        feature("a", F.substring(word, 1, 3)),
        feature("z", F.right(word, F.lit(3))),
    )
    out = [*key, "pos", features.alias("feats")]
    if labels:
        out.append(F.col("z.label").alias("label"))
    return rows.select(*out)


LEARNERS = ("counts", "logistic", "chain")


def train_tagger(
    train: DataFrame, key: Sequence[str], learner: str = "counts", **params: float
) -> CountModel | PipelineModel | ChainModel:
    """H5: token classifier over window features.

    `chain` learns a linear-chain model over whole sentences (params of `fit_chain`).
    `counts` learns naive Bayes over the tag names in `tags` (params: alpha); `logistic` a
    multinomial regression over the BIO ids in `labels` (params: num_features, max_iter,
    reg_param).
    """
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner!r}")
    if learner == "counts":
        return fit_counts(write_table(token_rows(train, key, "tags").select("feats", "label"), "token-rows"), **params)
    if learner == "chain":
        rows = token_rows(train, key, "tags").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "feats", F.coalesce("label", F.lit("O")).alias("label")))).alias("z"))
        rows = write_table(rows.select(F.col("z.feats").alias("feats"), F.col("z.label").alias("tags")), "token-rows")
        tags = {r["tag"] for r in rows.select(F.explode("tags").alias("tag")).distinct().collect()}
        return fit_chain(rows, {"O", *tags, *("B-" + t[2:] for t in tags if t.startswith("I-"))}, **params)
    rows = token_rows(train, key).withColumn("label", F.col("label").cast("double"))
    options = {"num_features": 1 << 12, "max_iter": 20, "reg_param": 1e-4} | params
    return Pipeline(
        stages=[
            HashingTF(inputCol="feats", outputCol="features", numFeatures=options["num_features"]),
            LogisticRegression(maxIter=options["max_iter"], regParam=options["reg_param"], family="multinomial"),
        ]
    ).fit(write_table(rows.select("feats", "label"), "token-rows"))


def predict_tags(
    model: CountModel | PipelineModel | ChainModel, samples: DataFrame, label_map: DataFrame | None, key: Sequence[str]
) -> DataFrame:
    """Add `pred_tags` (array of tag names, O on specials and pads) and `scores` (winning probability)."""
    from pyspark.ml.functions import vector_to_array

    rows = token_rows(samples, key, labels=None)
    if isinstance(model, ChainModel):
        return predict_chain(model, samples, rows, key)
    if isinstance(model, CountModel):
        scored = predict_counts(model, rows, [*key, "pos"])
    else:
        named = label_map.select(F.col("id").alias("_id"), F.col("label").alias("pred"))
        scored = join_small(
            model.transform(rows).select(
                *key, "pos", F.col("prediction").cast("int").alias("_id"), F.array_max(vector_to_array("probability")).alias("score")
            ),
            named,
            ["_id"],
            "left",
        )
    by_sentence = scored.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.struct("pred", "score")))).alias("_p")
    )
    at = lambda i: F.try_element_at("_p", i)
    return (
        samples.join(by_sentence, list(key), "left")
        .withColumn("pred_tags", F.transform("tokens", lambda _, i: F.coalesce(at(i)["pred"], F.lit("O"))))
        .withColumn("scores", F.transform("tokens", lambda _, i: F.coalesce(at(i)["score"], F.lit(1.0))))
        .drop("_p")
    )


def tune_tagger(
    train: DataFrame, validation: DataFrame, key: Sequence[str], alphas: Sequence[float]
) -> tuple[CountModel, DataFrame]:
    """H7 for taggers: the smoothing with the best weighted token F1 on the validation split.

    Counts do not depend on the smoothing, so all trials share one model and one pass.
    Returns the best model and the trials (trial, params, f1).
    """
    model = train_tagger(train, key)
    rows = write_table(token_rows(validation, key, "tags"), "token-rows")
    return _tuned(model, rows.withColumnRenamed("label", "truth"), [*key, "pos"], alphas)


def _tuned(model: CountModel, rows: DataFrame, key: Sequence[str], alphas: Sequence[float]) -> tuple[CountModel, DataFrame]:
    """`rows` has the key, feats and truth. Label-sized counts per trial reach the driver."""
    # Written, or the join's and the explosion's own steps would work the choices out again.
    choices = write_table(label_choices(model, rows, key, alphas), "choices")
    chosen = choices.join(rows.select(*key, "truth"), list(key))
    counts = write_table(
        chosen.select("truth", F.posexplode("choices").alias("trial", "z"))
        .groupBy("trial", "truth", F.col("z.label").alias("pred"))
        .agg(F.count("*").alias("n")),
        "trials",
    )
    f1 = [weighted_metrics(counts.where(F.col("trial") == i)).first()["f1"] for i in range(len(alphas))]
    trials = [(i, f"alpha={a}", float(score)) for i, (a, score) in enumerate(zip(alphas, f1, strict=True))]
    best = replace(model, alpha=alphas[max(range(len(f1)), key=lambda i: f1[i])])
    return best, rows.sparkSession.createDataFrame(trials, "trial int, params string, f1 double")


def with_class_weight(train: DataFrame, column: str = "label") -> DataFrame:
    """D12 weights attached to the rows."""
    weights = class_weights(train, column).select(F.col("label").alias(column), "weight")
    return join_small(train, weights, [column])


def relation_features(samples: DataFrame) -> DataFrame:
    """Pair samples with `marked`, the text with entity markers."""
    return samples.withColumn(
        "marked",
        inject_markers(F.col("text"), F.col("e1_start"), F.col("e1_end"), F.col("e2_start"), F.col("e2_end")),
    )


def relation_stages(num_features: int = 1 << 12, max_iter: int = 20, reg_param: float = 1e-4) -> Pipeline:
    """Marked text -> words and markers -> word pairs -> hashed counts -> weighted classifier."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="marked", outputCol="words", gaps=False, pattern="\\[/?e[12]\\]|[\\p{L}\\p{N}]+"),
            NGram(inputCol="words", outputCol="grams", n=2),
            HashingTF(inputCol="grams", outputCol="features", numFeatures=num_features),
            LogisticRegression(
                labelCol="label_id", weightCol="weight", maxIter=max_iter, regParam=reg_param, family="multinomial"
            ),
        ]
    )


def marked_bigrams(marked: str = "marked") -> Column:
    """Pairs of neighbouring words and markers of the lower-cased text."""
    words = F.regexp_extract_all(F.lower(marked), F.lit("\\[/?e[12]\\]|[\\p{L}\\p{N}]+"), F.lit(0))
    pairs = lambda w: F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat_ws(" ", w[i], x))
    return let(words, pairs)


def train_relation_model(
    train: DataFrame, label_map: DataFrame, learner: str = "counts", **params: float
) -> CountModel | PipelineModel:
    """H6: relation classifier on marked text, rows weighted by class (D12); learners as in `train_tagger`."""
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner!r}")
    if learner == "counts":
        # Written before they are weighed: the weights come from the labels of the written rows, not from a pass of their own.
        prepared = write_table(relation_features(train).select(marked_bigrams().alias("feats"), "label"), "relation-rows")
        return fit_counts(with_class_weight(prepared), weight="weight", **params)
    encoded = encode_labels(with_class_weight(relation_features(train)), label_map)
    prepared = write_table(encoded.select("marked", F.col("label_id").cast("double").alias("label_id"), "weight"), "relation-rows")
    return relation_stages(**params).fit(prepared)


def predict_relations(
    model: CountModel | PipelineModel, samples: DataFrame, label_map: DataFrame, key: Sequence[str] = ("file", "e1_id", "e2_id")
) -> DataFrame:
    """Add `pred`, the predicted label name."""
    if isinstance(model, CountModel):
        # Written once: samples, feature counts and features are read on their own, and samples may take work to make.
        rows = relation_features(samples).select(*samples.columns, marked_bigrams().alias("_feats"))
        rows = write_table(rows, "relation-rows")
        predicted = predict_counts(model, rows.select(*key, "_feats"), key, features="_feats").drop("score")
        return rows.drop("_feats").join(predicted, list(key))
    rows = model.transform(relation_features(samples)).withColumn("pred_id", F.col("prediction").cast("int"))
    names = label_map.select(F.col("id").alias("pred_id"), F.col("label").alias("pred"))
    return join_small(rows, names, ["pred_id"], "left").drop(
        "marked", "words", "grams", "features", "rawPrediction", "probability", "prediction", "pred_id"
    )


def tune_relations(
    train: DataFrame,
    validation: DataFrame,
    label_map: DataFrame,
    alphas: Sequence[float],
    key: Sequence[str] = ("file", "e1_id", "e2_id"),
) -> tuple[CountModel, DataFrame]:
    """H7 for relation models over counts: the smoothing with the best weighted F1, as in `tune_tagger`."""
    model = train_relation_model(train, label_map)
    rows = relation_features(validation).select(*key, marked_bigrams().alias("feats"), F.col("label").alias("truth"))
    return _tuned(model, write_table(rows, "relation-rows"), key, alphas)


def tune(
    train: DataFrame, validation: DataFrame, label_map: DataFrame, grid: Sequence[dict[str, float]]
) -> tuple[PipelineModel, DataFrame]:
    """H7 for logistic relation models: fit every setting, keep the best weighted F1 on the validation split.

    Returns the best model and the trials (trial, params, f1). Both inputs are prepared and
    written once; the trials are as many as the grid has settings.
    """

    def prepared(df: DataFrame) -> DataFrame:
        rows = encode_labels(relation_features(df), label_map).withColumn("label_id", F.col("label_id").cast("double"))
        return rows.select("marked", "label", "label_id")

    fit_rows = write_table(with_class_weight(prepared(train)).drop("label"))
    check_rows = write_table(prepared(validation).drop("label"))
    f1 = MulticlassClassificationEvaluator(labelCol="label_id", metricName="f1")
    best, trials = None, []
    for number, params in enumerate(grid):
        model = relation_stages(**params).fit(fit_rows)
        score = f1.evaluate(model.transform(check_rows))
        trials.append((number, ",".join(f"{k}={v}" for k, v in sorted(params.items())), float(score)))
        if best is None or score > best[0]:
            best = (score, model)
    return best[1], train.sparkSession.createDataFrame(trials, "trial int, params string, f1 double")


def evaluate_tagger(model: CountModel | PipelineModel, test: DataFrame, label_map: DataFrame, key: Sequence[str]) -> DataFrame:
    """H8 for taggers: span metrics and token metrics of the test split -> (level, label, measures).

    The overall line is told apart from the per-type lines by `label = 'overall'`.
    """
    predicted = write_table(predict_tags(model, test, label_map, key).select("tags", "pred_tags"))
    spans = span_metrics(predicted, "tags", "pred_tags").drop("support").withColumn("level", F.lit("span"))
    tokens = token_metrics(predicted, "tags", "pred_tags").withColumn("level", F.lit("token"))
    return spans.unionByName(tokens)


def evaluate_relations(
    model: CountModel | PipelineModel, test: DataFrame, label_map: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H8 for relation models: weighted metrics, the per-class report and the confusion matrix."""
    counts = write_table(
        predict_relations(model, test, label_map).groupBy(F.col("label").alias("truth"), "pred").agg(F.count("*").alias("n"))
    )
    return weighted_metrics(counts), classification_report(counts, label_map), confusion_matrix(counts, label_map)


def with_relations(sentences: DataFrame, scorer, labels: Sequence[str] = ()) -> DataFrame:
    """H3 and D2 together: sentences with entities -> sentences with entities and relations.

    `scorer` is a factory as in `score_relations`, or a `RelationModel` of `learned`.
    """
    found = scorer.found(sentences) if hasattr(scorer, "found") else found_relations(sentences, scorer, labels)
    return nest_found(sentences, found)
