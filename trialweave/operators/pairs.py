"""Candidate entity pairs and their gold labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.annotations import NO_RELATION, RELATION_TYPES, filter_relation_types
from trialweave.session import write_table

LINE = ("file", "line_no")
#: First mentions of a tile; each comes with all mentions of its line.
FIRSTS = 64


def _own(lines: bool) -> Column:
    """The mentions a tile's firsts are cut from."""
    return F.filter("mentions", lambda m: m["line_key"] == F.col("line_key")) if lines else F.col("mentions")


def pair_tiles(
    mentions: DataFrame,
    left_only: Sequence[str] = (),
    fields: Sequence[str] = ("id", "type", "start", "end"),
    block_rows: int | None = FIRSTS,
    lines: DataFrame | None = None,
    keyed: bool = False,
    gold: DataFrame | None = None,
) -> DataFrame:
    """Rows of (keys, `mentions`, `block`), from which `tile_pairs` makes the pairs of a line.

    `mentions` are all of the line, `block` numbers the `block_rows` of them that come
    first in its pairs. Of `keyed` tiles the mentions have a `line_key` too, and a tile's
    firsts share it. With `lines` (keys, `line_key`, `line_text`) tiles are keyed: their
    line's text stands once in the tile, whatever the number of pairs. With `gold`, as
    `gold_in_lines` gives it, each mention has a map `outgoing` from the second argument to
    the label; it is looked up in the line's row, so that mentions are shuffled once.
    """
    keys = [k for k in LINE if k in mentions.columns]
    keyed = keyed or lines is not None
    held = [*fields, *left_only, *(["line_key"] if keyed else [])]
    rows = (
        mentions.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(*held)).alias("mentions"))
        .where(F.size("mentions") > 1)
    )
    if gold is not None:
        out = gold.groupBy(*keys, "arg1").agg(F.map_from_entries(F.collect_list(F.struct("arg2", "label"))).alias("outgoing"))
        out = out.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("arg1", "outgoing"))).alias("_gold"))
        found = lambda m: F.struct(*[m[c].alias(c) for c in held], F.try_element_at("_gold", m["id"]).alias("outgoing"))
        rows = rows.join(out, keys, "left").withColumn("mentions", F.transform("mentions", found)).drop("_gold")
    if keyed:
        rows = rows.withColumn("line_key", F.explode(F.array_distinct(F.col("mentions.line_key"))))
    last = F.floor((F.size(_own(keyed)) - 1) / F.lit(block_rows)).cast("int") if block_rows else F.lit(0)
    tiles = rows.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    return _dealt(tiles, keys) if lines is None else with_line_texts(tiles, lines)


def _dealt(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    # With a number of its own: tiles are few bytes but many pairs, so they must not be packed by size.
    return tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "block")


def with_line_texts(tiles: DataFrame, lines: DataFrame) -> DataFrame:
    """Keyed tiles with the `line_text` of their firsts."""
    keys = [k for k in LINE if k in tiles.columns]
    return _dealt(tiles.join(lines, [*keys, "line_key"]), keys)


def tile_pairs(
    tiles: DataFrame,
    left_only: Sequence[str] = (),
    fields: Sequence[str] = ("id", "type", "start", "end"),
    block_rows: int | None = FIRSTS,
) -> DataFrame:
    """The ordered pairs of distinct mentions of tiles: a narrow step, no pair is shuffled."""
    keys = [k for k in LINE if k in tiles.columns]
    text = [c for c in ("line_text",) if c in tiles.columns]
    own = _own("line_key" in tiles.columns)
    firsts = F.slice(own, F.col("block") * block_rows + 1, block_rows) if block_rows else own
    one = tiles.select(*keys, *text, "mentions", F.explode(firsts).alias("_1"))
    both = one.select(*keys, *text, "_1", F.explode("mentions").alias("_2")).where("_1.id <> _2.id")
    return both.select(
        *keys,
        *[F.col(f"_1.{f}").alias(f"e1_{f}") for f in fields],
        *[F.col(f"_1.{c}").alias(c) for c in left_only],
        *text,
        *[F.col(f"_2.{f}").alias(f"e2_{f}") for f in fields],
    )


def candidate_pairs(
    mentions: DataFrame,
    left_only: Sequence[str] = (),
    fields: Sequence[str] = ("id", "type", "start", "end"),
    block_rows: int | None = FIRSTS,
) -> DataFrame:
    """All ordered pairs of distinct mentions of one line, as e1_* and e2_* columns.

    The mentions are shuffled, the pairs are not. A line with more than `block_rows`
    mentions is cut into blocks of first arguments, each with a copy of the line's mentions,
    so its pairs come from many tasks.
    """
    return tile_pairs(pair_tiles(mentions, left_only, fields, block_rows), left_only, fields, block_rows)


#: Mentions per side of a tile of the pair matrix; a pair costs its reader a pass over the text, so a tile holds few thousand.
TILE = 64


def nested_pairs(sentences: DataFrame, entities: str = "entities", tile: int | None = None) -> DataFrame:
    """C3 on the inference layout: ordered pairs of the entities in a row's array.

    Gives the sentence columns plus i, j, e1 and e2 (structs). With `tile`, the pair matrix
    of a row with more mentions than that is cut into tiles of `tile` first and second
    mentions, which are dealt to the tasks; only such rows are shuffled, once per tile and
    with no mentions but those of the tile.
    """
    others = [c for c in sentences.columns if c != entities]
    n = F.size(entities)

    def pairs_of(rows: DataFrame, firsts: Column, seconds: Column, at: Column, behind: Column) -> DataFrame:
        one = rows.select(*rows.columns, F.posexplode(firsts).alias("_i", "e1"))
        both = one.select(*one.columns, F.posexplode(seconds).alias("_j", "e2"))
        placed = both.withColumn("i", F.col("_i") + at).withColumn("j", F.col("_j") + behind)
        return placed.where("i <> j").select(*others, "i", "e1", "j", "e2")

    whole, zero = F.col(entities), F.lit(0)
    if tile is None:
        return pairs_of(sentences.where(n >= 2), whole, whole, zero, zero)
    small = pairs_of(sentences.where((n >= 2) & (n <= tile)), whole, whole, zero, zero)
    side = F.ceil(n / tile).cast("int")
    low, high = F.expr("_tile div _side").cast("int") * tile, (F.col("_tile") % F.col("_side")) * tile
    cut = lambda at: F.slice(whole, at + 1, tile)
    large = (
        sentences.where(n > tile)
        .withColumn("_side", side)
        .withColumn("_tile", F.explode(F.sequence(F.lit(0), side * side - 1)))
        .select(*others, "_side", "_tile", cut(low).alias("_firsts"), cut(high).alias("_seconds"))
        # With a number of its own: tiles are few bytes but many pairs, so they must not be packed by size.
        .repartition(int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("_tile"), F.xxhash64("_firsts"))
    )
    return small.unionByName(pairs_of(large, F.col("_firsts"), F.col("_seconds"), low, high))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s1, s2) < F.least(e1, e2)


def drop_overlaps(pairs: DataFrame) -> DataFrame:
    """C4: drop pairs whose spans share characters; touching and zero-length spans stay."""
    return pairs.where(
        ~overlaps(F.col("e1_start"), F.col("e1_end"), F.col("e2_start"), F.col("e2_end"))
    )


def gold_labels(relations: DataFrame, accepted: Iterable[str] = RELATION_TYPES) -> DataFrame:
    """The accepted relation of each (file, arg1, arg2); the last line wins.

    An annotated NO_RELATION is accepted, so it can be the last line; the pair is negative then.
    """
    return (
        filter_relation_types(relations, [*accepted, NO_RELATION])
        .groupBy("file", "arg1", "arg2")
        .agg(F.max(F.struct("ann_line", "perm_no", "rel_type")).alias("m"))
        .select("file", "arg1", "arg2", F.col("m.rel_type").alias("label"))
        .where(F.col("label") != NO_RELATION)
    )


def gold_in_lines(mentions: DataFrame, relations: DataFrame, accepted: Iterable[str] = RELATION_TYPES) -> DataFrame:
    """Gold labels whose two arguments are mentions of one line -> (file, line_no, arg1, arg2, label).

    Relations across lines or to unknown ids drop out.
    """
    gold = gold_labels(relations, accepted)
    place = mentions.select("file", "line_no", "id")
    first = place.select("file", F.col("id").alias("arg1"), "line_no")
    second = place.select("file", F.col("id").alias("arg2"), F.col("line_no").alias("line_no_2"))
    return (
        gold.where("arg1 <> arg2")
        .join(first, ["file", "arg1"])
        .join(second, ["file", "arg2"])
        .where("line_no = line_no_2")
        .select("file", "line_no", "arg1", "arg2", "label")
    )


def label_pairs(
    mentions: DataFrame,
    relations: DataFrame,
    accepted: Iterable[str] = RELATION_TYPES,
    left_only: Sequence[str] = (),
    block_rows: int | None = FIRSTS,
    lines: DataFrame | None = None,
    write: bool = False,
) -> DataFrame:
    """Candidate pairs with their gold label, NO_RELATION where there is none.

    The lookup meets the mentions in the row of their line: shuffles grow with mentions and
    relations, never with the pairs. With `lines`, as in `pair_tiles`, a pair has its `line_text`.
    `write` writes the tiles, no larger than mentions and lines, and each reader makes the
    pairs from them.
    """
    gold = gold_in_lines(mentions, relations, accepted)
    tiles = pair_tiles(mentions, left_only, block_rows=block_rows, lines=lines, gold=gold)
    return labelled_tiles(write_table(tiles, "pair-tiles") if write else tiles, left_only, block_rows)


def labelled_tiles(tiles: DataFrame, left_only: Sequence[str] = (), block_rows: int | None = FIRSTS) -> DataFrame:
    """The pairs of tiles that were made with `gold`, with their label."""
    pairs = tile_pairs(tiles, ["outgoing", *left_only], block_rows=block_rows)
    return pairs.withColumn(
        "label", F.coalesce(F.try_element_at("outgoing", F.col("e2_id")), F.lit(NO_RELATION))
    ).drop("outgoing")
