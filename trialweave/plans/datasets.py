"""From documents and annotations to the two training datasets.

Tables that several later steps read are written once below the shared folder, so
no step parses the annotations again and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators import annotations, labels, pairs, sampling, spans, tokens
from trialweave.operators.criteria import non_blank
from trialweave.operators.skew import fits, join_small
from trialweave.session import write_table
from trialweave.sources.corpus import annotation_lines

PAIR_KEY = ("file", "e1_id", "e2_id")
LINE_KEY = ("file", "line_no")


def line_entities(
    documents: DataFrame, accepted: Iterable[str] | None = annotations.ENTITY_TYPES
) -> DataFrame:
    """Non-blank lines with their mention fragments.

    Text and annotations of a file stand in one row, so its lines are made there. Where a file
    name comes more than once, each of its texts meets all of its annotations by a join.
    """
    rows = documents.select("file", "text", "ann_text")
    repeated = rows.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file")
    if fits(repeated, 0):
        return spans.entities_in_documents(rows, accepted)
    again = join_small(rows, repeated, ["file"], "left_semi")
    lines = spans.line_offsets(again.select("file", "text"))
    fragments = annotations.parse_mentions_fragments(annotation_lines(again.select("file", "ann_text")), accepted)
    joined = spans.nest_entities(non_blank(lines), spans.assign_to_lines(lines, write_table(fragments)))
    return spans.entities_in_documents(join_small(rows, repeated, ["file"], "left_anti"), accepted).unionByName(joined)


def tagger_samples(
    documents: DataFrame, max_len: int | None = None, mask_special: bool = False, pad: bool = True
) -> DataFrame:
    """Lines with tokens, offsets and BIO tags (T10 before id encoding)."""
    return aligned_samples(line_entities(documents), max_len, mask_special, pad)


def aligned_samples(
    entities: DataFrame, max_len: int | None = None, mask_special: bool = False, pad: bool = True
) -> DataFrame:
    """With `max_len` a long line gives several windows (column `window`); tags are set before the cut."""
    aligned = tokens.align_bio(tokens.tokenize_offsets(entities), mask_special)
    arrays = ("tokens", "offsets", "attention_mask", "tags")
    cut = aligned if max_len is None else tokens.token_windows(aligned, max_len, arrays, pad)
    return cut.select(
        *LINE_KEY,
        *(["window"] if max_len else []),
        "text",
        annotations.criteria_type_of(F.col("file")).alias("criteria_type"),
        *arrays,
        "entities",
    )


def tagger_dataset(
    documents: DataFrame, max_len: int | None = None, seed: int = 42, pad: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Split samples with label ids, and the label map."""
    samples = write_table(tagger_samples(documents, max_len, pad=pad))
    entity_types = samples.select(F.explode("entities.type").alias("type"))
    label_map = write_table(labels.ner_label_map(entity_types))
    encoded = labels.encode_tags(samples, label_map)
    return sampling.iterative_split(encoded, LINE_KEY, "labels", seed), label_map


def line_mentions(documents: DataFrame, text: bool = True) -> DataFrame:
    """Envelope mentions with their line (relation path); `line_key` tells the texts of lines of one number apart.

    Pairs do not read the mentions' own `text`, which is left out on request.
    """
    lines = spans.line_offsets(documents.select("file", "text")).withColumn("key", F.xxhash64("text"))
    mentions = annotations.parse_mentions_envelope(annotation_lines(documents.select("file", "ann_text")), text)
    return spans.assign_to_lines(lines, write_table(mentions, "mentions"), ["key"])


def line_texts(documents: DataFrame) -> DataFrame:
    """The text of each line, once: (file, line_no, line_key, line_text)."""
    lines = spans.line_offsets(documents.select("file", "text"))
    keyed = lines.select("file", "line_no", F.xxhash64("text").alias("line_key"), F.col("text").alias("line_text"))
    return keyed.dropDuplicates(["file", "line_no", "line_key"])


def relations_of(documents: DataFrame) -> DataFrame:
    return annotations.all_relations(annotation_lines(documents.select("file", "ann_text")))


def relation_samples(documents: DataFrame, rate: float | None = None, seed: int = 42) -> DataFrame:
    """Labelled candidate pairs (T11); negatives thinned to `rate` while they are made."""
    mentions = write_table(line_mentions(documents, text=False), "line-mentions")
    labelled = pairs.label_pairs(mentions, relations_of(documents), lines=line_texts(documents), write=True)
    kept = sampling.downsample(labelled, rate, PAIR_KEY, seed)
    return kept.select(
        *LINE_KEY,
        "e1_id",
        "e2_id",
        F.col("line_text").alias("text"),
        *[f"{e}_{f}" for e in ("e1", "e2") for f in ("start", "end", "type")],
        "label",
        annotations.criteria_type_of(F.col("file")).alias("criteria_type"),
    )


def relation_dataset(
    documents: DataFrame, rate: float | None = None, train_rate: float | None = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split pair samples and the label map: rare labels dropped, train negatives thinned."""
    samples = labels.drop_rare_labels(relation_samples(documents, rate, seed))
    label_map = write_table(labels.re_label_map(samples))
    split = sampling.stratified_split(samples, "label", PAIR_KEY, seed)
    return sampling.downsample(split, train_rate, PAIR_KEY, seed, split="train"), label_map
