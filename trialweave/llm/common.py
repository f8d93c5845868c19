"""What the training-data operators share: table access, Arrow passes, row identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.session import ship_package

#: Python code looks at so many bytes of text at once, whatever the size of an Arrow batch.
SLICE_BYTES = 8 << 20

#: Words are runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`mapInArrow` for functions of this package, which the workers must be able to import."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_slices(batch: pa.RecordBatch, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about SLICE_BYTES of text each; a row is never cut."""
    column = batch.column(text_col)
    n = batch.num_rows
    if column.nbytes <= SLICE_BYTES or n < 2:
        yield batch
        return
    start, held = 0, 0
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, size in enumerate(lengths):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start, n - start)


def by_slices(batches: Iterator[pa.RecordBatch], fn, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, text_col):
            if part.num_rows:
                yield fn(part)


def crc_mod(c: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null id counts as empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def share_of(key: Column, fraction: float) -> Column:
    """True for about `fraction` of the keys, the same ones in every run."""
    if fraction >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < int(fraction * (1 << 30))
