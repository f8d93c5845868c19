"""Documents, lines and the mentions inside them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.markers import inject_markers
from trialweave.functions.text import WHITESPACE, let, lines_with_offsets
from trialweave.operators.annotations import ENTITY_TYPES, fragments_in
from trialweave.operators.skew import hot_blocks, replicate, scatter
from trialweave.session import ship_package

OFFSET_BUCKET = 4096
MAX_TEXT = 1 << 31  # a Spark string is shorter
LINE_ENTITIES = "array<struct<id:string,type:string,start:bigint,end:bigint,text:string>>"


def pair_documents(texts: DataFrame, ann_texts: DataFrame) -> DataFrame:
    """Texts that have an annotation file, with it. File names are unique on both sides."""
    return texts.join(ann_texts, "file", "inner")


def unpaired_documents(texts: DataFrame, ann_texts: DataFrame) -> DataFrame:
    """The skipped texts."""
    return texts.join(ann_texts.select("file"), "file", "left_anti")


def line_offsets(texts: DataFrame) -> DataFrame:
    """(file, text) -> (file, line_no, text, off); blank lines keep their place."""
    return texts.select("file", F.explode(lines_with_offsets(F.col("text"))).alias("z")).select("file", "z.*")


def realign_offsets(df: DataFrame, off: str = "off") -> DataFrame:
    """Document offsets to offsets inside the line."""
    return df.withColumn("start", F.col("start") - F.col(off)).withColumn("end", F.col("end") - F.col(off))


def assign_to_lines(
    lines: DataFrame,
    mentions: DataFrame,
    carry: Sequence[str] = (),
    block_rows: int | None = 1_000_000,
) -> DataFrame:
    """Mentions that lie inside one line, with line_no and offsets inside the line.

    Range join `start >= off AND end <= off + length`. File and a 4,096-character offset
    bucket form the equi-join key, which also splits one huge file over many tasks. A line
    or mention is listed in each bucket it touches; a match counts only in the last of the
    two first buckets, so that no pair comes twice. A bucket that holds very many mentions
    is split into blocks. The line text is not shuffled unless `carry` names it.
    """

    def bucket(c: Column) -> Column:
        return F.floor(c / OFFSET_BUCKET)

    line_end = F.col("off") + F.length("text")
    line_side = lines.select(
        "file",
        "line_no",
        "off",
        line_end.alias("_line_end"),
        *[F.col(c).alias(f"_c_{c}") for c in carry],
        bucket(F.col("off")).alias("_line_first"),
        F.explode(F.sequence(bucket(F.col("off")), bucket(line_end))).alias("_bucket"),
    )
    # A mention whose end precedes its start can only touch lines between the two.
    first = bucket(F.least("start", "end"))
    last = F.least(bucket(F.col("start")), F.lit(MAX_TEXT // OFFSET_BUCKET))
    mention_side = mentions.withColumn("_first", first).withColumn(
        "_bucket", F.explode(F.sequence(F.least(first, last), last))
    )
    keys = ["file", "_bucket"]
    blocks = hot_blocks(mention_side, keys, block_rows)
    joined = scatter(mention_side, blocks, keys, ["id", "start", "end"]).join(
        replicate(line_side, blocks, keys), [*keys, "_block"]
    )
    inside = joined.where(
        (F.col("start") >= F.col("off"))
        & (F.col("end") <= F.col("_line_end"))
        & (F.col("_bucket") == F.greatest("_line_first", "_first"))
    )
    return realign_offsets(inside).select(
        "file",
        "line_no",
        *[c for c in mentions.columns if c != "file"],
        *[F.col(f"_c_{c}").alias(f"line_{c}") for c in carry],
    )


def nest_entities(lines: DataFrame, line_mentions: DataFrame) -> DataFrame:
    """Lines with their mentions as an array, stable by start; empty where none."""
    order = ["start", "ann_line", "frag_no"]
    nested = line_mentions.groupBy("file", "line_no").agg(
        F.sort_array(F.collect_list(F.struct(*order, "end", "id", "type", "text"))).alias("e")
    )
    entities = F.transform("e", lambda x: F.struct(*[x[f].alias(f) for f in ("id", "type", "start", "end", "text")]))
    return (
        lines.join(nested, ["file", "line_no"], "left")
        .withColumn(
            "entities",
            F.coalesce(entities, F.array().cast(LINE_ENTITIES)),
        )
        .drop("e")
    )


BATCH_LINES = 20_000
_ENTITY = ("id", "type", "start", "end", "text")
_ENTITY_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())


def entities_by_line(text: str, fragments: Iterator[tuple]) -> Iterator[tuple[int, str, int, list[tuple]]]:
    """(line_no, text, off, entities) of the non-blank lines; two binary searches give the lines that hold a fragment.

    A fragment whose end precedes its start lies inside every line between the two.
    """
    texts, starts, ends, at = text.split("\n"), [], [], 0
    for line in texts:
        starts.append(at), ends.append(at + len(line))
        at += len(line) + 1
    held: dict[int, list[tuple]] = {}
    for start, end, ann_line, frag_no, *rest in fragments:
        if start is not None and end is not None:
            for i in range(bisect_left(ends, end), bisect_right(starts, start)):
                held.setdefault(i, []).append((start - starts[i], ann_line, frag_no, end - starts[i], *rest))
    for i, line in enumerate(texts):
        if line.strip(WHITESPACE):
            yield i, line, starts[i], [(name, kind, s, e, shown) for s, _, _, e, name, kind, shown in sorted(held.get(i, ()))]


def _line_batch(lines: list[tuple]) -> pa.RecordBatch:
    file, number, text, off, entities = zip(*lines, strict=True)
    bounds = [0]
    for found in entities:
        bounds.append(bounds[-1] + len(found))
    fields = [list(c) for c in zip(*(e for found in entities for e in found), strict=True)] or [[]] * len(_ENTITY)
    values = [pa.array(c, t) for c, t in zip(fields, _ENTITY_TYPES, strict=True)]
    nested = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(values, list(_ENTITY)))
    columns = [pa.array(file, pa.string()), pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(off, pa.int32()), nested]
    return pa.record_batch(columns, ["file", "line_no", "text", "off", "entities"])


def entities_in_documents(documents: DataFrame, accepted: Collection[str] | None = ENTITY_TYPES) -> DataFrame:
    """C2 and D1 in the row of a document (file, text, ann_text): its non-blank lines with their mention fragments.

    For files that come once this gives what `assign_to_lines` and `nest_entities` give, and
    shuffles nothing. A null file name has no mentions.
    """
    kinds = None if accepted is None else frozenset(accepted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []
        for batch in batches:
            for file, text, ann_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is not None:
                    fragments = fragments_in(None if file is None else ann_text, kinds)
                    lines += [(file, *line) for line in entities_by_line(text, fragments)]
                if len(lines) >= BATCH_LINES:
                    yield _line_batch(lines)
                    lines = []
        if lines:
            yield _line_batch(lines)

    ship_package(documents.sparkSession)
    schema = f"file string, line_no int, text string, off int, entities {LINE_ENTITIES}"
    return documents.select("file", "text", "ann_text").mapInArrow(run, schema)


RELATION = (
    "struct<arg1:string,arg1_type:string,arg2:string,arg2_type:string,"
    "relation:string,confidence_score:double,marked_context:string>"
)


def nest_relations(sentences: DataFrame, relations: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Append each sentence's relations as an array in pair order; empty where none."""
    fields = ("arg1", "arg1_type", "arg2", "arg2_type", "relation", "confidence_score", "marked_context")
    nested = relations.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("i", "j", *fields))).alias("r")
    )
    plain = F.transform("r", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return (
        sentences.join(nested, key, "left")
        .withColumn("relations", F.coalesce(plain, F.array().cast(f"array<{RELATION}>")))
        .drop("r")
    )


def nest_found(sentences: DataFrame, found: DataFrame, key: str = "sentence_id") -> DataFrame:
    """D2 from pair numbers: `found` has key, i, j, relation, confidence_score.

    Only these are shuffled; names and marked contexts are made in the row of the sentence,
    from its own entities and text.
    """
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "j", "relation", "confidence_score"))).alias("_r"))

    def shown(r: Column) -> Column:
        return let(
            F.struct(F.col("entities")[r["i"]].alias("e1"), F.col("entities")[r["j"]].alias("e2")),
            lambda e: F.struct(
                e["e1"]["word"].alias("arg1"),
                e["e1"]["entity_group"].alias("arg1_type"),
                e["e2"]["word"].alias("arg2"),
                e["e2"]["entity_group"].alias("arg2_type"),
                r["relation"].alias("relation"),
                r["confidence_score"].alias("confidence_score"),
                inject_markers(
                    F.col("text"), e["e1"]["start"], e["e1"]["end"], e["e2"]["start"], e["e2"]["end"], bounds="skip"
                ).alias("marked_context"),
            ),
        )

    return (
        sentences.join(listed, key, "left")
        .withColumn("relations", F.coalesce(F.transform("_r", shown), F.array().cast(f"array<{RELATION}>")))
        .drop("_r")
    )
