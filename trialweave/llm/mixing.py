"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document has a base rate of one copy. Among all rates r_i in [0, MAX_COPIES] that
give a source its target of words, sum(r_i * size_i) = target, the ones closest to the base
in relative entropy are exponentially tilted: r_i = min(MAX_COPIES, exp(a * size_i)) with
one multiplier a per source, the root of the convex dual's gradient. Newton steps for all
sources run together as joins and grouped sums over the histogram (source, size, count),
kept inside a bracket that every step narrows.

Rates become copies by error diffusion over the cumulative rates of a source's sizes, and a
few passes then move copies of the size that leaves the fewest words over, while that helps. Equal sizes of a source share their copies in
hash order, ranked inside slices of about SLICE_ROWS rows, so a source or a size that holds
a third of the table is spread over many tasks.

Null text has size 0; a document without words is taken once and adds nothing. A null
source is a source of its own and comes last. Rows that repeat an id are separate rows. An
empty table gives an empty result. Results depend on values only: reruns agree. Other columns
are not read; `repeat_documents` carries them, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import WORD
from trialweave.session import write_table

MAX_COPIES = 3
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
NEWTON_STEPS = 40
TOLERANCE = 1e-10
REPAIR_PASSES = 8
SLICE_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Written: _id, _source, _size and the row's place, which tells repeated rows apart."""
    return write_table(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_source"),
            word_count(F.col(text_col)).alias("_size"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mix-sizes",
    )


def source_targets(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: _source, _total, _target.

    Shares by weight, stopped at max_copies times the source, the excess reshared by weight:
    the sources that stop are the first ones in the order of total / weight, so one pass of
    running sums finds them. The windows run over one row per source.
    """
    totals = histogram.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).cast("bigint").alias("_total"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weighed = totals.withColumn("_w", F.element_at(listed, (rank % len(weights) + 1).cast("int"))).withColumn(
        "_cap", F.col("_total") * F.lit(float(max_copies))
    )
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    earlier, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = weighed.select(
        "*",
        (F.sum("_total").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))).alias("_left"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))).alias("_weights"),
    ).withColumn("_share", F.col("_left") / F.col("_weights"))
    # A source is open if its share at its own place is below its cap; from then on all are.
    open_at = F.when(F.col("_share") * F.col("_w") < F.col("_cap"), F.struct("_place", "_share"))
    return (
        level.withColumn("_place", F.row_number().over(order))
        .withColumn("_first", F.min(open_at).over(everything))
        .select(
            "_source",
            "_total",
            F.when(F.col("_place") >= F.col("_first._place"), F.least(F.col("_first._share") * F.col("_w"), F.col("_cap")))
            .otherwise(F.col("_cap"))
            .alias("_target"),
        )
    )


def tilted_rate(tilt: Column, size: Column, mean: Column, max_copies: int = MAX_COPIES) -> Column:
    return F.exp(F.least(F.lit(math.log(max_copies)), tilt * size / mean))


def solve_tilts(histogram: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """_source, _target, _mean, _tilt; sources at their cap have no tilt (null: every rate is the cap).

    A step costs one join of the histogram with the state and one grouped sum; the state is
    one row per source and is written after each step.
    """
    sizes = histogram.groupBy("_source").agg(
        (F.sum(F.col("_size") * F.col("_n")) / F.greatest(F.sum(F.when(F.col("_size") > 0, F.col("_n")).otherwise(0)), F.lit(1))).alias("_mean")
    )
    state = write_table(
        targets.join(sizes, targets["_source"].eqNullSafe(sizes["_source"])).select(
            targets["_source"],
            "_target",
            F.greatest("_mean", F.lit(1.0)).alias("_mean"),
            F.when(F.col("_target") < F.col("_total") * max_copies, F.lit(0.0)).alias("_tilt"),
            F.lit(None).cast("double").alias("_lo"),
            F.lit(None).cast("double").alias("_hi"),
            F.lit(False).alias("_done"),
        ),
        "mix-state",
    )
    for _ in range(NEWTON_STEPS):
        rate = tilted_rate(F.col("_tilt"), F.col("_size"), F.col("_mean"), max_copies)
        words = F.col("_size") * F.col("_n") * rate
        bent = F.col("_tilt") * F.col("_size") / F.col("_mean") < math.log(max_copies)
        open_state = state.where("_tilt IS NOT NULL AND NOT _done")
        sums = (
            histogram.alias("h")
            .join(open_state.alias("s"), F.col("h._source").eqNullSafe(F.col("s._source")))
            .groupBy(F.col("s._source").alias("_source"))
            .agg(F.sum(words).alias("_f"), F.sum(F.when(bent, words * F.col("_size") / F.col("_mean")).otherwise(0.0)).alias("_d"))
        )
        gap = F.col("_f") - F.col("_target")
        lo = F.when(gap < 0, F.col("_tilt")).otherwise(F.col("_lo"))
        hi = F.when(gap > 0, F.col("_tilt")).otherwise(F.col("_hi"))
        newton = F.col("_tilt") - F.try_divide(gap, F.col("_d"))
        inside = newton.isNotNull() & (newton > F.coalesce("_lo2", F.lit(-1e300))) & (newton < F.coalesce("_hi2", F.lit(1e300)))
        # Outside the bracket: halve it, or double the distance from zero where one end is open.
        middle = (
            F.when(F.col("_lo2").isNotNull() & F.col("_hi2").isNotNull(), (F.col("_lo2") + F.col("_hi2")) / 2)
            .when(F.col("_lo2").isNotNull(), F.greatest(F.col("_lo2") * 2, F.col("_lo2") + 1))
            .otherwise(F.least(F.col("_hi2") * 2, F.col("_hi2") - 1))
        )
        state = write_table(
            state.alias("s")
            .join(sums.alias("f"), F.col("s._source").eqNullSafe(F.col("f._source")), "left")
            .select("s.*", "f._f", "f._d")
            .withColumn("_met", F.col("_done") | F.col("_f").isNull() | (F.abs(gap) <= F.col("_target") * TOLERANCE))
            .withColumn("_lo2", lo)
            .withColumn("_hi2", hi)
            .select(
                "_source",
                "_target",
                "_mean",
                F.when(F.col("_met"), F.col("_tilt")).when(inside, newton).otherwise(middle).alias("_tilt"),
                F.col("_lo2").alias("_lo"),
                F.col("_hi2").alias("_hi"),
                F.col("_met").alias("_done"),
            ),
            "mix-state",
        )
        if not state.where("NOT _done").limit(1).count():
            break
    return state.select("_source", "_target", "_mean", "_tilt")


def whole_copies(rated: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(_source, _size, _n, _rate, _target) -> _source, _size, _n, _copies, written.

    Copies of a size are the steps of the rounded running sum of rates, from the longest
    size down; the words still missing or in excess then go, pass by pass, to the size whose
    copies come closest to them.
    """
    down = Window.partitionBy("_source").orderBy(F.desc("_size"))
    want = F.col("_n") * F.col("_rate")
    upto = F.sum(want).over(down.rowsBetween(Window.unboundedPreceding, 0))
    given = write_table(
        rated.withColumn("_upto", upto)
        .withColumn("_copies", F.floor(F.col("_upto") + 0.5 + 1e-9) - F.floor(F.coalesce(F.lag("_upto").over(down), F.lit(0.0)) + 0.5 + 1e-9))
        .select("_source", "_size", "_n", "_target", F.least(F.col("_copies"), F.col("_n") * max_copies).cast("bigint").alias("_copies")),
        "mix-copies",
    )
    for _ in range(REPAIR_PASSES):
        left = given.groupBy("_source").agg((F.max("_target") - F.sum(F.col("_copies") * F.col("_size"))).alias("_left"))
        room = F.when(F.col("_left") > 0, F.col("_n") * max_copies - F.col("_copies")).otherwise(F.col("_copies"))
        gap = F.abs("_left")
        moved = F.least(F.greatest(F.floor(gap / F.col("_size")), F.lit(1)), F.col("_room"))
        choice = (
            given.alias("g")
            .join(left.alias("l"), F.col("g._source").eqNullSafe(F.col("l._source")))
            .select("g.*", "l._left")
            .withColumn("_room", room)
            .where("_size > 0 AND _room > 0")
            .withColumn("_moved", moved.cast("bigint"))
            .withColumn("_rest", F.abs(gap - F.col("_moved") * F.col("_size")))
            .where(F.col("_rest") < gap)
            .groupBy("_source")
            .agg(F.min_by(F.struct("_size", "_moved", "_left"), F.struct("_rest", "_size")).alias("_pick"))
            .select(
                F.col("_source").alias("_s"),
                F.col("_pick._size").alias("_z"),
                (F.signum("_pick._left") * F.col("_pick._moved")).cast("bigint").alias("_step"),
            )
        )
        choice = write_table(choice, "mix-choice")
        if not choice.limit(1).count():
            break
        given = write_table(
            given.join(choice, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")), "left").select(
                "_source", "_size", "_n", "_target", (F.col("_copies") + F.coalesce("_step", F.lit(0))).alias("_copies")
            ),
            "mix-copies",
        )
    return given


def mix_rows(
    rows: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(_id, _source, _size, _row), a written table -> those columns, _total, _target, _copies."""
    histogram = write_table(rows.groupBy("_source", "_size").agg(F.count("*").alias("_n")), "mix-histogram")
    targets = write_table(source_targets(histogram, weights, max_copies), "mix-targets")
    tilts = solve_tilts(histogram, targets, max_copies)
    rated = (
        histogram.alias("h")
        .join(tilts.alias("t"), F.col("h._source").eqNullSafe(F.col("t._source")))
        .select(
            "h.*",
            "_target",
            F.when(F.col("_size") == 0, 1.0)
            .otherwise(F.coalesce(tilted_rate(F.col("_tilt"), F.col("_size"), F.col("_mean"), max_copies), F.lit(float(max_copies))))
            .alias("_rate"),
        )
    )
    copies = whole_copies(rated, max_copies)
    totals = targets.select(F.col("_source").alias("_s"), "_total", "_target")
    units = copies.join(totals, F.col("_source").eqNullSafe(F.col("_s"))).select(
        F.coalesce("_source", F.lit("")).alias("_key"),
        F.col("_source").isNull().alias("_none"),
        "_size",
        "_total",
        totals["_target"],
        "_copies",
        "_n",
        F.ceil(F.col("_n") / slice_rows).cast("bigint").alias("_slices"),
    )
    # Rows of one (source, size) get base copies; the first (copies mod n) in slice and hash order one more.
    placed = write_table(
        rows.withColumn("_key", F.coalesce("_source", F.lit("")))
        .withColumn("_none", F.col("_source").isNull())
        .join(units, ["_key", "_none", "_size"])
        .withColumn("_h", F.xxhash64("_id", "_source", "_size"))
        .withColumn("_slice", F.pmod(F.xxhash64("_h", "_row"), F.col("_slices"))),
        "mix-placed",
    )
    group = ["_key", "_none", "_size"]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*group, "_slice")
        .agg(F.count("*").alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        .drop("_m")
    )
    inside = Window.partitionBy(*group, "_slice").orderBy("_h", "_id", "_row")
    extra = F.expr("_before + _rank - 1 < _copies % _n").cast("bigint")
    return (
        placed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*group, "_slice"])
        .select("_id", "_source", "_size", "_row", "_total", "_target", (F.expr("_copies div _n") + extra).alias("_copies"))
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken."""
    mixed = mix_rows(sized(docs, id_col, text_col, source_col), weights, max_copies)
    return mixed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of `docs`."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ids, texts, sources = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    whole = write_table(
        safe.withColumn("_size", word_count(F.col(texts))).withColumn("_row", F.monotonically_increasing_id()), "mix-rows"
    )
    rows = whole.select(F.col(ids).alias("_id"), F.col(sources).alias("_source"), "_size", "_row")
    taken = mix_rows(rows).where("_copies > 0").select("_row", "_copies")
    # The copies grow with the table: never broadcast, also while they are few.
    return (
        whole.drop("_size")
        .hint("merge")
        .join(taken, "_row")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .select(*safe.columns)
        .toDF(*names)
    )
