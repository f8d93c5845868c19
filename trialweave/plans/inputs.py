"""Bridge tables that many registered queries start from, written once per session and scale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.text import hash_u, let
from trialweave.operators import annotations, criteria, labels, pairs, sampling, spans, tokens
from trialweave.plans import bridge, datasets
from trialweave.session import write_table
from trialweave.sources.corpus import annotation_lines

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def made(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The DataFrame `name`, planned at the first call of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = build()
    return _WRITTEN[key]


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The written table `name`, built at the first call of a session."""
    return made(spark, sf_dir, name, lambda: write_table(build(), name))


def documents(spark, sf_dir):
    return written(spark, sf_dir, "documents", lambda: bridge.documents(spark, sf_dir))


def ann_lines(spark, sf_dir):
    return annotation_lines(documents(spark, sf_dir).select("file", "ann_text"))


def lines(spark, sf_dir):
    return spans.line_offsets(documents(spark, sf_dir).select("file", "text"))


def line_mentions(spark, sf_dir):
    """Mentions without their text, for pairs."""
    return written(spark, sf_dir, "line_mentions", lambda: datasets.line_mentions(documents(spark, sf_dir), text=False))


def mention_texts(spark, sf_dir):
    """Mentions with their text, for the lexicon."""
    return written(spark, sf_dir, "mention_texts", lambda: datasets.line_mentions(documents(spark, sf_dir)))


def relations(spark, sf_dir):
    return written(spark, sf_dir, "relations", lambda: annotations.all_relations(ann_lines(spark, sf_dir)))


def line_entities(spark, sf_dir):
    return written(spark, sf_dir, "line_entities", lambda: datasets.line_entities(documents(spark, sf_dir)))


def pair_tiles(spark, sf_dir):
    """Written tiles of mentions with their gold labels, without any text."""

    def build():
        mentions = line_mentions(spark, sf_dir)
        return pairs.pair_tiles(mentions, keyed=True, gold=pairs.gold_in_lines(mentions, relations(spark, sf_dir)))

    return written(spark, sf_dir, "pair_tiles", build)


def labelled_pairs(spark, sf_dir):
    """Pairs with their label, made from written tiles by each reader."""
    return made(spark, sf_dir, "labelled_pairs", lambda: pairs.labelled_tiles(pair_tiles(spark, sf_dir)))


def text_pairs(spark, sf_dir):
    """Labelled pairs with `line_text`, for the queries that read it; the text stands once in each written tile."""

    def build():
        texts = datasets.line_texts(documents(spark, sf_dir))
        return pairs.labelled_tiles(write_table(pairs.with_line_texts(pair_tiles(spark, sf_dir), texts), "text_tiles"))

    return made(spark, sf_dir, "text_pairs", build)


def re_label_map(spark, sf_dir):
    return written(spark, sf_dir, "re_label_map", lambda: labels.re_label_map(labelled_pairs(spark, sf_dir)))


def split_pairs(spark, sf_dir):
    return made(
        spark,
        sf_dir,
        "split_pairs",
        lambda: sampling.stratified_split(labelled_pairs(spark, sf_dir), "label", datasets.PAIR_KEY),
    )


def split_text_pairs(spark, sf_dir):
    return made(
        spark,
        sf_dir,
        "split_text_pairs",
        lambda: sampling.stratified_split(text_pairs(spark, sf_dir), "label", datasets.PAIR_KEY),
    )


def scored_pairs(spark, sf_dir):
    """Labelled pairs with a score per label: hash values, and a lead of 0.8 for the gold label."""
    label_map = re_label_map(spark, sf_dir)
    names = [r["label"] for r in label_map.orderBy("id").collect()]  # at most the accept-list
    scores = F.array(
        *[
            hash_u("file", "e1_id", "e2_id", k) / F.lit(sampling.UNIT)
            + F.when(F.col("label") == name, 0.8).otherwise(0.0)
            for k, name in enumerate(names)
        ]
    )
    return labelled_pairs(spark, sf_dir).withColumn("scores", scores)


def tagged_lines(spark, sf_dir):
    """Lines with whole-line tokens, gold tags and noisy tags (a rule on the token's hash)."""

    def build():
        aligned = tokens.align_bio(tokens.tokenize_offsets(line_entities(spark, sf_dir)))
        noise = lambda t: hash_u(F.lower(t)) % 6
        noisy = F.zip_with(
            "tokens",
            "tags",
            lambda t, tag: F.when(t.isin(tokens.CLS, tokens.SEP), tag).otherwise(
                let(noise(t), lambda n: F.when(n == 0, "O").when(n == 1, "I-Drug").otherwise(tag))
            ),
        )
        return aligned.withColumn("pred_tags", noisy)

    return written(spark, sf_dir, "tagged_lines", build)


def ner_label_map(spark, sf_dir):
    return written(
        spark,
        sf_dir,
        "ner_label_map",
        lambda: labels.ner_label_map(line_entities(spark, sf_dir).select(F.explode("entities.type").alias("type"))),
    )


def tagger_rows(spark, sf_dir):
    """The tagger dataset, whole lines without padding: label ids, stratum and split."""

    def build():
        samples = tagged_lines(spark, sf_dir).select(*datasets.LINE_KEY, "text", "tokens", "attention_mask", "tags")
        label_map = ner_label_map(spark, sf_dir)
        encoded = labels.encode_tags(samples, label_map)
        # The passes of the split read each line's own few tags; all tokens are encoded once, behind it.
        seen = labels.encode_tags(encoded.withColumn("_seen", F.array_distinct("tags")), label_map, "_seen", "_seen")
        return sampling.multilabel_split(seen, datasets.LINE_KEY, "_seen").drop("_seen")

    return written(spark, sf_dir, "tagger_rows", build)


def balanced_rows(spark, sf_dir):
    """The label ids of all lines with their iterative split."""
    return written(
        spark,
        sf_dir,
        "balanced_rows",
        lambda: sampling.iterative_split(tagger_rows(spark, sf_dir).select(*datasets.LINE_KEY, "labels"), datasets.LINE_KEY),
    )


def sentences(spark, sf_dir):
    """Criteria items of the registry view with a sentence id."""
    return written(
        spark,
        sf_dir,
        "sentences",
        lambda: criteria.with_sentence_id(
            criteria.explode_criteria(bridge.studies(spark, sf_dir)), "study_row", "item_no"
        ),
    )


def entity_sentences(spark, sf_dir):
    """Corpus lines in the inference layout (T13): gold mentions with a score of 1.

    The numbered lines are written by `with_sentence_id`; a second copy would hold the same rows.
    """
    entity = F.transform(
        "entities",
        lambda x: F.struct(
            x["type"].alias("entity_group"),
            x["text"].alias("word"),
            x["start"].cast("int").alias("start"),
            x["end"].cast("int").alias("end"),
            F.lit(1.0).alias("confidence_score"),
        ),
    )
    return made(
        spark,
        sf_dir,
        "entity_sentences",
        lambda: criteria.with_sentence_id(
            line_entities(spark, sf_dir).select(
                "file",
                "line_no",
                F.regexp_extract("file", "^D[0-9]+", 0).alias("studyNCTid"),
                annotations.criteria_type_of(F.col("file")).alias("criteria_type"),
                "text",
                entity.alias("entities"),
            ),
            "file",
            "line_no",
        ),
    )
