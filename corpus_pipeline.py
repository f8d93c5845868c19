"""The corpus pipeline: language, exact copies, near copies, mix, packing.

Every stage takes all that its predecessor kept; each result is written as Parquet and read
again. All stages but the last return the columns of `documents`; the mix repeats a row as
often as it is taken. SQL cannot express the stages, so the tests compare them with
brute-force versions.

A stage's own tables are needed until its result has been written. The next stage, which is
given that result, therefore drops them first, unless its input still reads them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from trialweave.llm import exact_dedup, langid, mixing, near_dedup, packing
from trialweave.llm.common import crc_mod, table
from trialweave.session import release_tables, tables_written, write_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the model learns from the rows that op9 learns from."""
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    return langid.keep_identified(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


#: Tables of the stages so far.
_OWN: list[str] = []


def _releasing(stage):
    """The stage, which first drops the tables of the stages before it that `docs` does not read."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _OWN[:] = release_tables(_OWN, docs)
        before = set(tables_written())
        result = stage(spark, docs, sf_dir)
        _OWN.extend(path for path in tables_written() if path not in before)
        return result

    return run_stage


STAGES = [
    ("language", _releasing(identify_language)),
    ("exact_dedup", _releasing(drop_exact)),
    ("near_dedup", _releasing(drop_near)),
    ("mixing", _releasing(mix_sources)),
    ("packing", _releasing(pack)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        _OWN.append(docs.scratch_path)
    _OWN[:] = [path for path in release_tables(_OWN, docs) if path != docs.scratch_path]
    return docs
