"""Views over the given text tables in the shape of the engine's inputs.

`documents` plays the registry and the annotated corpus. Whole tables and whole texts are
used; a line of the corpus is a sentence, as the text is cut behind `.`, `!` and `?`.
Mentions and relations follow rules over the words, so that an SQL twin gives the same.
Everything is computed inside the document row; the annotations in Python, a batch of texts at a
time, as nested Spark lambdas are interpreted per word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.text import let, text_lines
from trialweave.session import ship_package, spread

# Fixed values of the views.
MENTION = "^([A-Z][a-z]+|[0-9]+|[A-Za-z]{9,})"
TYPES = ("Condition", "Drug", "Procedure", "Measurement", "Value", "Temporal", "Non-query-able", "Parsing_Error")
RELATIONS = ("AND", "Has_value", "Has_temporal", "Has_qualifier", "multi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows: headers before the first and the middle line, bullets by line length."""

    def marked(lines: Column) -> Column:
        middle = F.floor(F.size(lines) / 2)

        def one(line: Column, i: Column) -> Column:
            kind = F.length(line) % 4
            bullet = F.when(kind == 0, "* ").when(kind == 1, "- ").when(kind == 2, "1. ").otherwise("")
            header = F.when(i == 0, "Inclusion Criteria:\n").when(i == middle, " EXCLUSION  criteria\n").otherwise("")
            return F.concat(header, bullet, line)

        return F.array_join(F.transform(lines, one), "\n")

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("study_row"),
        F.concat(F.lit("D"), F.col("doc_id")).alias("StudyNCTid"),
        let(text_lines(F.col("text")), marked).alias("EligibilityCriteria"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, lang, text); the file name says inclusion, exclusion or nothing by language."""
    suffix = F.when(F.col("lang") == "en", "_inc").when(F.col("lang").isin("fr", "de"), "_exc").otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id"), suffix).alias("file"),
        "lang",
        F.regexp_replace("text", "([.!?]) ", "$1\n").alias("text"),
    )


def _mentions(text: str, lang: str | None) -> Iterator[tuple[str, int, str | None, int, int | None]]:
    """(surface, start, next word, its start, code) in text order; a word that repeats the one before it is none."""
    find, line_start = re.compile(MENTION).match, 0
    for line in text.split("\n"):
        words, start, before = line.split(" "), line_start, None
        for i, word in enumerate(words):
            found = None if word == before else find(word)
            if found:
                surface, after = found[0], start + len(word) + 1
                key = None if lang is None else f"{surface.lower()}|{lang}".encode()
                code = None if key is None else int(hashlib.md5(key).hexdigest()[:8], 16) % len(TYPES)
                yield surface, start, words[i + 1] if i + 1 < len(words) else None, after, code
            start, before = start + len(word) + 1, word
        line_start = start


def _annotation(m: list[tuple], i: int) -> list[str]:
    """The annotation lines of mention i: the mention, its relation to the next one, a 3-ary set, a negation."""
    surface, start, following, at, code = m[i]
    if code is None:  # no language
        return []
    second = len(surface) == 2 and following is not None
    fragment, more = (f";{at} {at + len(following)}", f" {following}") if second else ("", "")
    lines = [f"T{i + 1}\t{TYPES[code]} {start} {start + len(surface)}{fragment}\t{surface}{more}"]
    related = i + 1 < len(m) and code < m[i + 1][4]
    if related:
        lines.append(f"R{i + 1}\t{RELATIONS[(code + m[i + 1][4]) % len(RELATIONS)]} Arg1:T{i + 1} Arg2:T{i + 2}\t")
    if i + 2 < len(m) and code == m[i + 2][4]:
        lines.append(f"*\t{'NOT' if code == 0 else 'OR'} T{i + 1} T{i + 2} T{i + 3}")
    if related and code == 1:  # behind the relation it overrides
        lines.append(f"R{i + 1}\tNO_RELATION Arg1:T{i + 1} Arg2:T{i + 2}\t")
    return lines


def _rendered(text: str | None, lang: str | None) -> str | None:
    if text is None:
        return None
    m = list(_mentions(text, lang))
    return "\n".join("\n".join(_annotation(m, i)) for i in range(len(m)))


def _ann_text(text: Column, lang: Column) -> Column:
    """All annotation lines of a document; no row where it has no mention."""

    @F.pandas_udf("string")
    def render(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([_rendered(t, x) for t, x in zip(texts, langs, strict=True)], dtype=object)

    return F.explode(F.filter(F.array(render(text, lang)), lambda a: a != ""))


def ann_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ann_text); a document without a mention has no annotation file."""
    ship_package(spark)
    return texts(spark, sf_dir).select("file", _ann_text(F.col("text"), F.col("lang")).alias("ann_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text, ann_text) read in one pass, for plans that start behind the pairing."""
    ship_package(spark)
    return texts(spark, sf_dir).select("file", "text", _ann_text(F.col("text"), F.col("lang")).alias("ann_text"))
