"""Registry exports that arrive as files: the criteria explosion is stateless and streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trialweave.operators.criteria import explode_criteria
from trialweave.session import scratch_path

SCHEMA = "StudyNCTid string, EligibilityCriteria string"


def read_study_stream(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.readStream.schema(SCHEMA).csv(path, header=True, multiLine=True, escape='"')
    return raw.select(F.xxhash64("StudyNCTid", "EligibilityCriteria").alias("study_row"), "StudyNCTid", "EligibilityCriteria")


def stream_criteria(spark: SparkSession, path: str, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Explode all files now in `path` to parquet in `out`; later files are taken up by the next call
    with the same checkpoint folder."""
    return (
        explode_criteria(read_study_stream(spark, path))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
