"""Sentences that arrive as files: the extraction of each micro-batch, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trialweave.plans.extraction import run_extraction

SCHEMA = "sentence_id bigint, studyNCTid string, criteria_type string, text string"


def stream_extraction(spark: SparkSession, path: str, out: str, checkpoint: str, store: str, **options) -> StreamingQuery:
    """Extract all JSON-lines files now in `path`; later files are taken up by the next call.

    `options` are those of `run_extraction`. A batch that is repeated after a failure
    overwrites its own folder and finds its sentences tagged in `store`.
    """

    def extract(batch: DataFrame, number: int) -> None:
        run_extraction(batch, store=store, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        spark.readStream.schema(SCHEMA)
        .json(path)
        .writeStream.foreachBatch(extract)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
