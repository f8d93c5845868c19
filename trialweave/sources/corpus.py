"""Stand-off annotated corpus: text scan (A2) and annotation scan (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.text import strip, text_lines, universal_newlines
from trialweave.session import listing_by_cores


def _whole_files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """The key is the file name; in a folder partitioned by `file` (one key per sub-folder) it is that."""
    with listing_by_cores(spark):
        files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{extension}")
    name = F.regexp_replace(F.col("_metadata.file_name"), f"\\{extension}$", "")
    key = F.col("file").cast("string") if "file" in files.columns else name
    return files.select(key.alias("file"), universal_newlines(F.col("value")).alias("value"))


def read_corpus(spark: SparkSession, path: str, extension: str = ".txt") -> DataFrame:
    """All `*.txt` of a folder -> (file, text); `file` is the name without extension."""
    return _whole_files(spark, path, extension).withColumnRenamed("value", "text")


def read_annotation_texts(spark: SparkSession, path: str, extension: str = ".ann") -> DataFrame:
    """All `*.ann` of a folder -> (file, ann_text)."""
    return _whole_files(spark, path, extension).withColumnRenamed("value", "ann_text")


def annotation_lines(ann_texts: DataFrame) -> DataFrame:
    """(file, ann_text) -> (file, ann_line, line): stripped, blank lines skipped, order kept."""
    return (
        ann_texts.select("file", F.posexplode(text_lines(F.col("ann_text"))).alias("ann_line", "raw"))
        .select("file", "ann_line", strip(F.col("raw")).alias("line"))
        .where("line <> ''")
    )


def read_annotations(spark: SparkSession, path: str, extension: str = ".ann") -> DataFrame:
    """A3: the annotation lines of a folder."""
    return annotation_lines(read_annotation_texts(spark, path, extension))
