"""Connected components of a link table, distributed: labels and links never leave the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import scratch, write_table


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label), label being the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours, and of that node
    the label it had before, so the number of rounds grows with the logarithm of the longest
    path. Labels are written once a round. Sums over a node's neighbours are combined before
    they move; the joins are plain equi-joins that adaptive execution splits at hot nodes.
    """
    with scratch() as keep:
        return keep(_contracted(links))


def _contracted(links: DataFrame) -> DataFrame:
    """Each node hangs on its smallest neighbour; rounds run over the links between such neighbours only.

    Most nodes of a large group have the same few smaller neighbours, so their links become
    a few equal ones. A node that is nobody's smaller neighbour takes part in no round.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = write_table(ordered, "links")
    lowest = write_table(edges.groupBy("b").agg(F.min("a").alias("low")), "lowest")
    heads = write_table(edges.select("a").distinct(), "heads")
    between = edges.join(lowest, "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b")).distinct()
    hung = lowest.join(heads.withColumnRenamed("a", "b"), "b", "left_semi").select(F.col("low").alias("a"), "b")
    core = _components(between.unionByName(hung))
    placed = lowest.select(F.col("b").alias("node"), "low").unionByName(
        heads.join(lowest.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("low"))
    )
    return write_table(
        placed.join(core, "node", "left")
        .join(core.toDF("low", "of_low"), "low", "left")
        .select("node", F.coalesce("label", "of_low", "low").alias("label")),
        "labels",
    )


def _components(links: DataFrame) -> DataFrame:
    both = write_table(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "links"
    )
    labels = write_table(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        before = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        labels = write_table(lowered.join(before, "low").select("node", "old", F.least("low", "further").alias("label")), "labels")
        if not labels.where("old <> label").limit(1).count():
            return write_table(labels.select("node", "label"), "labels")
        labels = labels.select("node", "label")


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only the components that a link joins are labelled anew."""
    of = lambda side: labels.toDF(side, f"{side}_label")
    between = (
        links.join(of("a"), "a", "left")
        .join(of("b"), "b", "left")
        .select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    )
    joined = components(between.where("a <> b"))
    renamed = joined.select(F.col("node").alias("label"), F.col("label").alias("lower"))
    kept = labels.join(renamed, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return write_table(kept.unionByName(joined.join(labels, "node", "left_anti")), "labels")
