"""Exact duplicates by skew-safe combining.

Three stages, each of which compares whole texts:

1. every task reduces the rows it reads to one representative per distinct text;
2. representatives with equal digest meet in salted groups and elect a salt winner;
3. salt winners of one digest meet and elect the row that stays.

A text that fills a third of the table reaches stage 2 as a few rows per task, a salted
group holds about SALT_ROWS of them, and stage 3 one row per salt. Members follow pointers
(row -> representative -> salt winner -> winner), all of them narrow equi-joins whose
fan-in the earlier stage has bounded. No row is dropped on the way.

Null text counts as empty; a null id loses against every other id. Rows that repeat an id
and a text count as copies of which one stays. An empty table gives an empty result. Other
columns are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.llm.common import map_arrow
from trialweave.session import write_table

#: Texts that a task holds at once in stage 1.
WINDOW_BYTES = 48 << 20
#: Representatives of one digest above which they are salted, and the size of a salted group.
SALT_ROWS = 1_000
#: No more than so many digests are salted, so that their list may be broadcast.
MAX_SALTED = 10_000

OWN = ("_rid", "_rep", "_n", "_digest")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _elect(window: pa.Table, id_col: str, text_col: str, digest: Callable[[str], str]) -> pa.Table:
    """Point every row of the window at the best row with the same text."""
    texts = [t or "" for t in window[text_col].to_pylist()]
    ids, rids = window[id_col].to_pylist(), window["_rid"].to_pylist()
    rank = [(i is not None, 0 if i is None else i, r) for i, r in zip(ids, rids, strict=True)]
    best: dict[str, int] = {}
    for row, text in enumerate(texts):
        held = best.get(text)
        if held is None or rank[row] > rank[held]:
            best[text] = row
    rep = [best[t] for t in texts]
    count = [0] * len(texts)
    for r in rep:
        count[r] += 1
    is_rep = pa.array([r == i for i, r in enumerate(rep)])
    none = {c: pa.nulls(len(texts), window[c].type) for c in window.column_names if c not in ("_rid", id_col)}
    kept = {c: window[c] if c not in none else pc.if_else(is_rep, window[c], none[c]) for c in window.column_names}
    kept[text_col] = pc.if_else(is_rep, pc.fill_null(window[text_col], ""), none[text_col])
    return pa.table(
        kept
        | {
            "_rep": pa.array([rids[r] for r in rep], pa.int64()),
            "_n": pa.array(count, pa.int64()),
            "_digest": pa.array([digest(t) if i == r else None for i, (t, r) in enumerate(zip(texts, rep, strict=True))], pa.string()),
        }
    )


def _local(id_col: str, text_col: str, digest: Callable[[str], str], window_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= window_bytes:
                yield from _elect(pa.Table.from_batches(held), id_col, text_col, digest).to_batches()
                held, size = [], 0
        if held:
            yield from _elect(pa.Table.from_batches(held), id_col, text_col, digest).to_batches()

    return run


def local_representatives(
    docs: DataFrame, id_col: str, text_col: str, digest: Callable[[str], str] = sha256_hex, window_bytes: int = WINDOW_BYTES
) -> DataFrame:
    """Stage 1, written: all rows with `_rid` and `_rep`; representatives also keep their columns."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(c) for c in docs.columns], F.monotonically_increasing_id().alias("_rid"))
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in renamed.schema]
        + [T.StructField("_rep", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_digest", T.StringType())]
    )
    return write_table(map_arrow(renamed, _local(id_col, text_col, digest, window_bytes), schema), "exact-local")


def _rank(id_col: str):
    return F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col("_rid").alias("rid"))


def elect_winners(local: DataFrame, id_col: str, text_col: str, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Stages 2 and 3 -> one row per representative: _rep, _digest, keep_id, keep_rid, group_size."""
    reps = local.where("_rid = _rep").select("_rid", id_col, text_col, "_n", "_digest")
    counts = reps.groupBy("_digest").agg(F.count("*").alias("_reps"))
    # At most MAX_SALTED digests can exceed the total divided by MAX_SALTED.
    total = reps.select("_rid").count()
    hot = counts.where(F.col("_reps") > max(salt_rows, total // MAX_SALTED)).select(
        "_digest", F.ceil(F.col("_reps") / salt_rows).cast("int").alias("_salts")
    )
    salted = reps.join(F.broadcast(hot), "_digest", "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64("_rid"), F.col("_salts")).cast("int"), F.lit(0))
    )
    group = Window.partitionBy("_digest", "_salt", text_col)
    stage2 = write_table(
        salted.withColumn("_best", F.max(_rank(id_col)).over(group))
        .withColumn("_size", F.sum("_n").over(group))
        .select(
            "_rid",
            "_digest",
            "_best",
            "_size",
            F.col("_salts").isNotNull().alias("_salted"),
            F.when(F.col("_salts").isNotNull() & (F.col("_best.rid") == F.col("_rid")), F.col(text_col)).alias("_text"),
        ),
        "exact-salted",
    )
    whole = Window.partitionBy("_digest", "_text")
    stage3 = (
        stage2.where("_salted AND _best.rid = _rid")
        .withColumn("_top", F.max("_best").over(whole))
        .withColumn("_all", F.sum("_size").over(whole))
        .select(F.col("_rid").alias("_winner"), "_top", "_all")
    )
    return (
        stage2.withColumn("_winner", F.col("_best.rid"))
        .join(stage3, "_winner", "left")
        .select(
            F.col("_rid").alias("_rep"),
            "_digest",
            F.coalesce("_top", "_best").alias("_top"),
            F.coalesce("_all", "_size").alias("group_size"),
        )
        .select("_rep", "_digest", F.col("_top.id").alias("keep_id"), F.col("_top.rid").alias("keep_rid"), "group_size")
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[str], str] = sha256_hex,
    salt_rows: int = SALT_ROWS,
    window_bytes: int = WINDOW_BYTES,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    `digest` only brings texts together; that they are equal is decided on the texts, so a
    digest with collisions gives the same groups (text_sha256 is what `digest` returns).
    """
    local = local_representatives(docs.select(id_col, text_col), id_col, text_col, digest, window_bytes)
    winners = elect_winners(local, id_col, text_col, salt_rows)
    return (
        local.select("_rid", "_rep", id_col)
        .join(winners, "_rep")
        .select(
            id_col,
            "keep_id",
            "group_size",
            (F.col("_rid") == F.col("keep_rid")).alias("kept"),
            F.col("_digest").alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns (null text as it was read: empty)."""
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ids, texts = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    local = local_representatives(safe, ids, texts)
    keep = elect_winners(local, ids, texts).where("_rep = keep_rid").select("_rep")
    kept = local.where("_rid = _rep").join(keep, "_rep", "left_semi").select(*safe.columns)
    return kept.toDF(*docs.columns)
