"""Label maps, encoding, rare labels, presence and class weights."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.annotations import NO_RELATION, RELATION_TYPES
from trialweave.operators.skew import join_small


def _numbered(names: DataFrame, first: str, per_name: Sequence[str] = ("",)) -> DataFrame:
    """(id, label): `first` is 0, then the sorted names, each once per prefix. Label-sized."""
    spark = names.sparkSession
    prefixed = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit(p), F.col("name")).alias("label")) for k, p in enumerate(per_name)])
    )
    ranked = names.selectExpr("name", "row_number() OVER (ORDER BY name) AS r").select("r", prefixed.alias("z"))
    rest = ranked.select(
        ((F.col("r") - 1) * len(per_name) + F.col("z.k") + 1).cast("int").alias("id"), F.col("z.label").alias("label")
    )
    return spark.createDataFrame([(0, first)], "id int, label string").unionByName(rest)


def ner_label_map(mentions: DataFrame) -> DataFrame:
    """D3: O = 0, then `B-` and `I-` of each type in sorted order."""
    return _numbered(mentions.select(F.col("type").alias("name")).distinct(), "O", ("B-", "I-"))


def re_label_map(samples: DataFrame, column: str = "label") -> DataFrame:
    """NO_RELATION = 0, then the other labels in sorted order."""
    names = samples.select(F.col(column).alias("name")).distinct().where(F.col("name") != NO_RELATION)
    return _numbered(names, NO_RELATION)


def drop_rare_labels(
    samples: DataFrame, accepted: Iterable[str] = RELATION_TYPES, column: str = "label", least: int = 2
) -> DataFrame:
    """Rows whose label has at least `least` rows and is accepted (or negative)."""
    frequent = (
        samples.where(F.col(column).isin(*accepted, NO_RELATION))
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .select(column)
    )
    return join_small(samples, frequent, [column], "left_semi")


def encode_labels(df: DataFrame, label_map: DataFrame, column: str = "label", out: str = "label_id", unknown: int | None = None) -> DataFrame:
    """Name -> id; `unknown` for names outside the map."""
    table = label_map.select(F.col("label").alias(column), F.col("id").cast("int").alias(out))
    joined = join_small(df, table, [column], "left")
    return joined if unknown is None else joined.withColumn(out, F.coalesce(F.col(out), F.lit(unknown)))


def decode_labels(df: DataFrame, label_map: DataFrame, column: str = "label_id", out: str = "label", unknown: str = "O") -> DataFrame:
    """Id -> name; an id outside the map gives `unknown`, where `{id}` stands for the id."""
    table = label_map.select(F.col("id").cast("int").alias(column), F.col("label").alias(out))
    before, found, after = unknown.partition("{id}")
    default = F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after)) if found else F.lit(unknown)
    return join_small(df, table, [column], "left").withColumn(out, F.coalesce(F.col(out), default))


def map_of(label_map: DataFrame, key: str, value: str) -> Column:
    """The label map as one map value (scalar subquery); it has label-many entries."""
    return label_map.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m")).scalar()


def encode_tags(df: DataFrame, label_map: DataFrame, tags: str = "tags", out: str = "labels", ignore: int = -100) -> DataFrame:
    """C6 on arrays: tag names -> ids inside the row; null tags get the ignore id."""
    return (
        df.withColumn("_map", map_of(label_map, "label", "id"))
        .withColumn(
            out,
            F.transform(tags, lambda t: F.when(t.isNull(), ignore).otherwise(F.coalesce(F.try_element_at("_map", t), F.lit(0)))),
        )
        .drop("_map")
    )


def decode_tags(df: DataFrame, label_map: DataFrame, labels: str = "labels", out: str = "tags", unknown: str = "O") -> DataFrame:
    """C6 on arrays: ids -> tag names inside the row; unknown and ignored ids give `unknown`."""
    return (
        df.withColumn("_map", map_of(label_map, "id", "label"))
        .withColumn(out, F.transform(labels, lambda x: F.coalesce(F.try_element_at("_map", x), F.lit(unknown))))
        .drop("_map")
    )


def label_presence(df: DataFrame, key: Sequence[str], labels: str = "labels") -> DataFrame:
    """The multi-hot matrix in long form, one row per row key and present non-zero label id."""
    return df.select(*key, F.explode(F.array_distinct(F.filter(labels, lambda x: x != 0))).alias("label_id"))


def presence_vector(labels: Column, ids: Sequence[int]) -> Column:
    """D11 as a dense row: 1 where the id occurs."""
    return F.array(*[F.array_contains(labels, i).cast("int") for i in ids])


def class_weights(train: DataFrame, column: str = "label") -> DataFrame:
    """Square root of n / (k * n_c), divided by the mean over classes -> (label, n, weight)."""
    counts = train.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return counts.selectExpr(
        "label", "n", "sqrt(sum(n) OVER () / (count(*) OVER () * n)) AS w"
    ).selectExpr("label", "n", "w / avg(w) OVER () AS weight")
