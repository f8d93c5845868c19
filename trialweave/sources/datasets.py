"""Sinks A5-A7, split dataset scan A8 and label map A9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "validation", "test")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row; nested lists and null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flat CSV with a header; nested columns become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).csv(path, header=True, escape='"')


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Train, validation and test in one parquet dataset, one folder per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All splits or one (pruned to its folder); a `label` column is renamed to `labels`."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.withColumnRenamed("label", "labels")


def write_label_map(label_map: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(id, label) -> one JSON object with both directions; it holds label-many entries."""
    both = label_map.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "id")))).alias("label2id"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "label")))).alias("id2label"),
    )
    both.select(F.to_json(F.struct("label2id", "id2label"))).coalesce(1).write.mode(mode).text(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON with string keys -> (id int, label); a missing path raises."""
    schema = "label2id map<string,int>, id2label map<string,string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    return raw.select(F.explode("m.id2label").alias("id", "label")).withColumn("id", F.col("id").cast("int"))
