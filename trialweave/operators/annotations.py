"""Annotation lines to mentions and relations.

Input rows are (file, ann_line, line) as given by `sources.corpus.annotation_lines`.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.text import WHITESPACE, WS

# Accepted entity types (exact case).
ENTITY_TYPES = (
    "Condition",
    "Device",
    "Drug",
    "Measurement",
    "Observation",
    "Person",
    "Procedure",
    "Visit",
    "Temporal",
    "Value",
    "Negation",
    "Qualifier",
    "Multiplier",
    "Reference_point",
    "Mood",
    "Non-query-able",
    "Post-eligibility",
    "Informed_consent",
    "Pregnancy_considerations",
    "Parsing_error",
    "Non-representable",
    "Competing_trial",
    "Context_Error",
    "Subjective_judgement",
    "Not_a_criteria",
    "Undefined_semantics",
    "Intoxication_considerations",
)

# The negative label and the accepted relation types.
NO_RELATION = "NO_RELATION"
RELATION_TYPES = (
    "AND",
    "OR",
    "Subsumes",
    "Has_negation",
    "Has_multiplier",
    "Has_qualifier",
    "Has_value",
    "Has_temporal",
    "Has_index",
    "Has_mood",
    "Has_context",
)


def criteria_type_of(file_name: Column) -> Column:
    """Criteria type from a file name; `_exc` is looked for first."""
    return (
        F.when(F.contains(file_name, F.lit("_exc")), "exclusion")
        .when(F.contains(file_name, F.lit("_inc")), "inclusion")
        .otherwise("unknown")
    )


def _fields(ann_lines: DataFrame, initial: str, least: int) -> DataFrame:
    return (
        ann_lines.where(F.col("line").startswith(initial))
        .withColumn("parts", F.split("line", "\t", -1))
        .where(F.size("parts") >= least)
    )


def filter_entity_types(mentions: DataFrame, accepted: Iterable[str] = ENTITY_TYPES) -> DataFrame:
    """Exact-case accept-list."""
    return mentions.where(F.col("type").isin(*accepted))


def parse_mentions_fragments(ann_lines: DataFrame, accepted: Iterable[str] | None = ENTITY_TYPES) -> DataFrame:
    """One row per fragment -> (file, ann_line, frag_no, id, type, start, end, text).

    `accepted=None` leaves the type filter out.
    """
    pair = f"([0-9]+)[{WS}]([0-9]+)"
    indices = F.regexp_extract("meta", "^[^ ]* (.*)$", 1)
    parsed = _fields(ann_lines, "T", 3).select(
        "file",
        "ann_line",
        F.col("parts")[0].alias("id"),
        F.col("parts")[1].alias("meta"),
        F.split_part(F.col("parts")[1], F.lit(" "), F.lit(1)).alias("type"),
        F.col("parts")[2].alias("text"),
    )
    if accepted is not None:
        parsed = filter_entity_types(parsed, accepted)
    spans = F.arrays_zip(
        F.regexp_extract_all(indices, F.lit(pair), F.lit(1)).alias("start"),
        F.regexp_extract_all(indices, F.lit(pair), F.lit(2)).alias("end"),
    )
    return parsed.select(
        "file", "ann_line", "id", "type", "text", F.posexplode(spans).alias("frag_no", "z")
    ).select(
        "file",
        "ann_line",
        "frag_no",
        "id",
        "type",
        F.col("z.start").try_cast("bigint").alias("start"),
        F.col("z.end").try_cast("bigint").alias("end"),
        "text",
    )


_INDICES = re.compile("[^ ]* ([^\n\r\x85\u2028\u2029]*)(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z")
_INDEX_PAIR = re.compile(f"([0-9]+)[{WS}]([0-9]+)")


def _bigint(digits: str) -> int | None:
    """The number, or None if it is no bigint."""
    digits = digits.lstrip("0") or "0"
    return int(digits) if len(digits) < 19 or len(digits) == 19 and digits <= "9223372036854775807" else None


def fragments_in(ann_text: str | None, accepted: Collection[str] | None = ENTITY_TYPES) -> Iterator[tuple]:
    """B6 in the row of a document: (start, end, ann_line, frag_no, id, type, text) as `parse_mentions_fragments` gives them."""
    for ann_line, raw in enumerate(() if ann_text is None else ann_text.split("\n")):
        parts = raw.strip(WHITESPACE).split("\t")
        if not parts[0].startswith("T") or len(parts) < 3:
            continue
        kind, indices = parts[1].split(" ", 1)[0], _INDICES.match(parts[1])
        if indices and (accepted is None or kind in accepted):
            for frag_no, (start, end) in enumerate(_INDEX_PAIR.findall(indices[1])):
                yield _bigint(start), _bigint(end), ann_line, frag_no, parts[0], kind, parts[2]


def parse_mentions_envelope(ann_lines: DataFrame, text: bool = True) -> DataFrame:
    """One row per (file, id), first to last offset -> (file, ann_line, id, type, start, end, text).

    A repeated id keeps its last line. Lines without numbers drop out; types are not filtered.
    Without `text` that column is neither shuffled nor returned; the rows are the same.
    """
    surface = ["text"] if text else []
    numbers = F.transform(
        F.regexp_extract_all(F.col("parts")[1], F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint")
    )
    spans = _fields(ann_lines, "T", 3).select(
        "file",
        "ann_line",
        F.col("parts")[0].alias("id"),
        F.split_part(F.col("parts")[1], F.lit(" "), F.lit(1)).alias("type"),
        numbers.alias("numbers"),
        F.col("parts")[2].alias("text"),
    ).where(F.size("numbers") > 0)
    last = spans.groupBy("file", "id").agg(
        F.max(
            F.struct(
                "ann_line",
                "type",
                F.array_min("numbers").alias("start"),
                F.array_max("numbers").alias("end"),
                *surface,
            )
        ).alias("m")
    )
    return last.select("file", "m.ann_line", "id", "m.type", "m.start", "m.end", *[f"m.{c}" for c in surface])


def _relation_fields(ann_lines: DataFrame, initial: str) -> DataFrame:
    return _fields(ann_lines, initial, 2).select(
        "file", "ann_line", F.split(F.col("parts")[1], " ", -1).alias("words")
    )


def parse_relations(ann_lines: DataFrame) -> DataFrame:
    """Binary relation lines -> (file, ann_line, perm_no, rel_type, arg1, arg2).

    Arguments may come in any order; the last of a kind counts; both must be non-empty.
    """

    def argument(prefix: str) -> Column:
        hits = F.filter("words", lambda w: w.startswith(prefix))
        return F.split_part(F.try_element_at(hits, F.lit(-1)), F.lit(":"), F.lit(2))

    return (
        _relation_fields(ann_lines, "R")
        .select(
            "file",
            "ann_line",
            F.lit(0).alias("perm_no"),
            F.col("words")[0].alias("rel_type"),
            argument("Arg1:").alias("arg1"),
            argument("Arg2:").alias("arg2"),
        )
        .where("arg1 <> '' AND arg2 <> ''")
    )


def expand_nary_relations(ann_lines: DataFrame) -> DataFrame:
    """N-ary lines to all ordered pairs of their arguments, numbered in `perm_no`."""
    args = (
        _relation_fields(ann_lines, "*")
        .withColumn("args", F.slice("words", 2, F.size("words")))
        .where(F.size("args") >= 2)
    )
    firsts = args.select(
        "file", "ann_line", F.col("words")[0].alias("rel_type"), "args", F.posexplode("args").alias("i", "arg1")
    )
    pairs = firsts.select(
        "file", "ann_line", "rel_type", "i", "arg1", F.size("args").alias("n"), F.posexplode("args").alias("j", "arg2")
    ).where("i <> j")
    return pairs.select(
        "file",
        "ann_line",
        F.expr("i * (n - 1) + IF(j > i, j - 1, j)").alias("perm_no"),
        "rel_type",
        "arg1",
        "arg2",
    )


def all_relations(ann_lines: DataFrame) -> DataFrame:
    """Binary and expanded n-ary relations together."""
    return parse_relations(ann_lines).unionByName(expand_nary_relations(ann_lines))


def filter_relation_types(relations: DataFrame, accepted: Iterable[str] = RELATION_TYPES) -> DataFrame:
    """Accept-list. An annotated NO_RELATION counts as negative and is left out too."""
    return relations.where(F.col("rel_type").isin(*accepted))


def rejected_relations(relations: DataFrame, accepted: Iterable[str] = RELATION_TYPES) -> DataFrame:
    """The other side, as (rel_type, n)."""
    return relations.where(~F.col("rel_type").isin(*accepted, NO_RELATION)).groupBy("rel_type").agg(
        F.count("*").alias("n")
    )


def distinct_types(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a type column."""
    return df.select(column).distinct()
