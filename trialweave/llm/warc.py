"""Merkle fixity audit of WARC replicas.

`warc_records` renders pages as WARC response records and lays them out in archives with
byte offsets. `merkle_tree` hashes the records of one replica and combines them over
ordered offset ranges: a leaf range covers RANGE bytes of an archive, a node covers FANOUT
ranges of the level below, up to one root per archive. `audit` compares the roots of two
trees and descends only below nodes that differ, so that a sound archive costs one
comparison, and names the records that were changed, lost or added.

Ranges are computed from offsets, not from ranks, so every level is one grouping of bounded
groups (records are at least as long as their header) and an archive that holds a third of
all records is spread over its ranges. Trees are written tables.

Null pages, urls and ids are rendered as empty text. Rows that repeat are records of their
own. Records that share an archive and offset are one leaf, as a replica has one content
there: its hash covers their number and digests. Empty tables have no root. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import write_table

RANGE = 1 << 16
FANOUT = 16
ARCHIVE_ROWS = 1_000

CHANGED, MISSING, EXTRA = "changed", "missing", "extra"


def record_bytes(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC/1.1 response record as binary."""
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def warc_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_rows: int = ARCHIVE_ROWS
) -> DataFrame:
    """Written: archive, offset, length, record_id, record; archives hold `archive_rows` records by id.

    A range sort spreads the pages, also those with equal ids; the places of its tasks' first
    rows come from one count per task, and offsets from sums inside an archive.
    """
    rendered = pages.select(
        F.col(id_col).alias("record_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("_url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"),
        record_bytes(F.col(id_col), F.col(url_col), F.col(html_col)).alias("record"),
    ).withColumn("_digest", F.sha2("record", 256))
    # The pages are moved once, by the join; sorting and numbering see narrow rows. Ties share a
    # digest, that is, they are the same record; a salt lets them spread.
    whole = write_table(rendered.withColumn("_salt", F.monotonically_increasing_id()).drop("_html"), "warc-rendered")
    order = [F.col("record_id").asc_nulls_first(), "_url", "_digest", "_salt"]
    placed = write_table(
        whole.select("record_id", "_url", "_digest", "_salt", F.octet_length("record").cast("bigint").alias("length"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("_salt", "length", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")),
        "warc-placed",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = (
        placed.join(F.broadcast(starts.select("_part", "_first")), "_part")
        .withColumn("_at", F.col("_first") + F.col("_pos"))
        .withColumn("archive", F.expr(f"_at div {archive_rows}"))
    )
    inside = Window.partitionBy("archive").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return write_table(
        whole.select("_salt", "record_id", "record")
        .hint("merge")  # the layout grows with the pages, so it is never broadcast
        .join(offsets.select("_salt", "archive", "offset", "length"), "_salt")
        .select("archive", "offset", "length", "record_id", "record"),
        "warc-records",
    )


def leaves(records: DataFrame) -> DataFrame:
    """archive, offset -> hash of what the replica holds there."""
    digest = F.sha2("record", 256)
    return (
        records.select("archive", "offset", F.coalesce(digest, F.lit("")).alias("_digest"))
        .groupBy("archive", "offset")
        .agg(F.count("*").alias("_n"), F.min("_digest").alias("_low"), F.max("_digest").alias("_high"), F.sum(F.crc32(F.col("_digest").cast("binary"))).alias("_sum"))
        .select("archive", "offset", F.sha2(F.concat_ws("|", "_n", "_low", "_high", "_sum"), 256).alias("hash"))
    )


def _combined(place: str) -> Column:
    """The hash over (place, hash) of the children in order; their number is bounded by the range."""
    children = F.sort_array(F.collect_list(F.struct(place, "hash")))
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c[place], c["hash"])), "|"), 256)


def merkle_tree(records: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT, levels: int | None = None) -> DataFrame:
    """Written: level, archive, node, hash. Level -1 holds the records (node = offset), the last one the roots."""
    own = write_table(leaves(records), "merkle-leaves")
    if levels is None:
        levels = tree_levels(own, range_bytes, fanout)
    level = own.groupBy("archive", F.expr(f"offset div {range_bytes}").alias("node")).agg(_combined("offset").alias("hash"))
    tree = own.select(F.lit(-1).alias("level"), "archive", F.col("offset").alias("node"), "hash")
    for depth in range(levels):
        level = write_table(level, "merkle-level")
        tree = tree.unionByName(level.withColumn("level", F.lit(depth)))
        level = level.groupBy("archive", F.expr(f"node div {fanout}").alias("_parent")).agg(_combined("node").alias("hash")).withColumnRenamed("_parent", "node")
    return tree


def tree_levels(records: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> int:
    """Levels until one node spans the longest archive."""
    last = (records.agg(F.max("offset")).first()[0] or 0) // range_bytes
    levels = 1
    while last:
        last //= fanout
        levels += 1
    return levels


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.select("archive", "node", F.col("hash").alias("_l")).join(
        right.select("archive", "node", F.col("hash").alias("_r")), ["archive", "node"], "full_outer"
    )
    return both.where(~F.col("_l").eqNullSafe(F.col("_r")))


def audit(replica: DataFrame, other: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Damaged records of `other` against `replica`: archive, offset, kind.

    Both trees get the height of the taller one, so that roots cover the same ranges. Each
    level reads only the children of the nodes that differ one level above.
    """
    levels = max(tree_levels(replica, range_bytes, fanout), tree_levels(other, range_bytes, fanout))
    left, right = (merkle_tree(r, range_bytes, fanout, levels) for r in (replica, other))
    at = lambda tree, level: tree.where(F.col("level") == level)
    differing = _differing(at(left, levels - 1), at(right, levels - 1))
    for level in range(levels - 2, -2, -1):
        step = range_bytes if level < 0 else fanout
        above = write_table(differing.select("archive", F.col("node").alias("_parent")), "merkle-differing")
        below = [at(t, level).withColumn("_parent", F.expr(f"node div {step}")).join(above, ["archive", "_parent"], "left_semi") for t in (left, right)]
        differing = _differing(*below)
    kind = F.when(F.col("_r").isNull(), MISSING).when(F.col("_l").isNull(), EXTRA).otherwise(CHANGED)
    return differing.select("archive", F.col("node").alias("offset"), kind.alias("kind"))
