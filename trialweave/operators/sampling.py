"""Splits and downsampling with value hashes instead of random numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.functions.text import hash_u, key_digest
from trialweave.operators.annotations import NO_RELATION
from trialweave.operators.skew import MAX_SMALL_ROWS, join_small
from trialweave.session import write_table

UNIT = float(1 << 32)


def hash_share(key: Sequence[str], seed: int) -> Column:
    """Uniform value in [0, 1) that depends on the key and the seed only."""
    return hash_u(*key, seed) / F.lit(UNIT)


def downsample(
    df: DataFrame,
    rate: float | None,
    key: Sequence[str],
    seed: int = 42,
    negative: str = NO_RELATION,
    split: str | None = None,
) -> DataFrame:
    """keep each negative with probability `rate`; positives always stay.

    Without `split` a row stays if u <= rate; with `split` only that split is thinned and a
    row stays if u < rate. A rate of null or at least 1 keeps everything. One narrow filter.
    """
    if rate is None or rate >= 1.0:
        return df
    u = hash_share(key, seed)
    keep = F.col("label") != negative
    if split is None:
        return df.where(keep | (u <= rate))
    return df.where(keep | (F.col("split") != split) | (u < rate))


def test_quota(n: Column) -> Column:
    """A tenth, rounded half up."""
    return F.floor((n + 5) / 10)


def validation_quota(rest: Column) -> Column:
    """A ninth of what the test split leaves, rounded half up."""
    return F.floor((2 * rest + 9) / 18)


MAX_RANKED = 100_000


def stratified_split(
    df: DataFrame,
    label: str | Column,
    key: Sequence[str],
    seed: int = 42,
    bucket_digits: int = 3,
    max_ranked: int = MAX_RANKED,
    quotas: DataFrame | None = None,
) -> DataFrame:
    """add `split`, 80/10/10 within each label, exact to the row.

    `quotas` (`_label`, `n_test`, `n_held`: rows of test, and of test and validation
    together) replaces the shares. Rows of a label are ordered by md5(key, seed); the first tenth is test, the next ninth
    validation. Only the two cut points per label are searched: counts by leading hash
    digits find the bucket of each cut. A bucket of more than `max_ranked` rows is counted
    again by further digits until it is small; just its rows are then ranked. The rows
    themselves are compared with their label's cut points, without a shuffle.
    """
    digest = key_digest(*key, seed)
    stratum = F.col(label) if isinstance(label, str) else label
    ordered = df.select(
        stratum.alias("_label"), F.concat_ws("|", digest, *[F.col(k).cast("string") for k in key]).alias("_rank_key")
    )
    prefix = lambda digits: F.substring("_rank_key", 1, digits)
    counts = ordered.groupBy("_label", prefix(bucket_digits).alias("_bucket")).agg(F.count("*").alias("n"))
    if quotas is None:
        totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy("_label"))).withColumn("n_test", test_quota(F.col("total")))
        totals = totals.withColumn("n_held", F.col("n_test") + validation_quota(F.col("total") - F.col("n_test")))
    else:
        totals = join_small(counts, quotas, ["_label"])
    wanted = F.array(*[F.struct(F.lit(cut).alias("cut"), F.col(f"n_{cut}").alias("quota")) for cut in ("test", "held")])
    cuts = _locate(totals.select("_label", "_bucket", "n", F.explode(wanted).alias("c")).select("*", "c.*"), ["_label", "cut"])
    found, digits = [], bucket_digits
    while True:
        # Two rows per label: the bucket that holds the quota-th row, its size and the rank inside it.
        cuts = write_table(cuts, "split-cuts")
        if digits >= DIGEST_DIGITS:
            found.append((cuts, digits))
            break
        found.append((cuts.where(F.col("n") <= max_ranked), digits))
        large = cuts.where(F.col("n") > max_ranked)
        if not large.limit(1).count():
            break
        finer = min(digits + bucket_digits, DIGEST_DIGITS)
        rows = join_small(
            ordered.withColumn("_bucket", prefix(digits)),
            large.select("_label", "_bucket", "cut", F.col("rank").alias("quota")),
            ["_label", "_bucket"],
        )
        counts = rows.groupBy("_label", "cut", "quota", prefix(finer).alias("_bucket")).agg(F.count("*").alias("n"))
        cuts, digits = _locate(counts, ["_label", "cut"]), finer
    points = None
    for part, length in found:
        buckets = part.groupBy("_label", "_bucket").agg(F.collect_list(F.struct("cut", "rank")).alias("cuts"))
        inside = join_small(ordered.withColumn("_bucket", prefix(length)), buckets, ["_label", "_bucket"])
        ranked = inside.withColumn("n", F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_rank_key")))
        hits = ranked.where(F.exists("cuts", lambda c: c["rank"] == F.col("n"))).select("_label", "_rank_key", "n", F.explode("cuts").alias("c"))
        hits = hits.where("c.rank = n").select("_label", "_rank_key", "c.cut")
        points = hits if points is None else points.unionByName(hits)
    cut_point = lambda name: F.max(F.when(F.col("cut") == name, F.col("_rank_key"))).alias(f"_{name}_cut")
    return (
        join_small(df.withColumn("_label", stratum), points.groupBy("_label").agg(cut_point("test"), cut_point("held")), ["_label"], "left")
        .withColumn("_rank_key", F.concat_ws("|", digest, *[F.col(k).cast("string") for k in key]))
        .withColumn(
            "split",
            F.when(F.col("_rank_key") <= F.col("_test_cut"), "test")
            .when(F.col("_rank_key") <= F.col("_held_cut"), "validation")
            .otherwise("train"),
        )
        .drop("_label", "_rank_key", "_test_cut", "_held_cut")
    )


DIGEST_DIGITS = 32


def _locate(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bucket counts with a quota per group -> the bucket of the quota-th row and its rank there."""
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.withColumn("upto", F.sum("n").over(upto))
        .where("quota > upto - n AND quota <= upto")
        .select("_label", "_bucket", "cut", "n", (F.col("quota") - F.col("upto") + F.col("n")).alias("rank"))
    )


def _present(labels: str) -> Column:
    """The label ids of a row, each once: distinct first, so that the filter runs over few values, not over all tokens."""
    return F.filter(F.array_distinct(labels), lambda x: x > 0)


def multilabel_split(df: DataFrame, key: Sequence[str], labels: str = "labels", seed: int = 42) -> DataFrame:
    """split rows that carry several label ids; adds `stratum` and `split`.

    The stratum is the rarest label present (by rows, in the whole set), 0 where there is
    none. The frequencies are as long as the label map; they travel as one small map, or
    by a join should there ever be very many.
    """
    present = _present(labels)
    frequencies = (
        df.select(F.explode(present).alias("id")).groupBy("id").agg(F.count("*").cast("bigint").alias("n"))
    )
    rows = frequencies.limit(MAX_SMALL_ROWS + 1).collect()
    if len(rows) <= MAX_SMALL_ROWS:
        small = df.sparkSession.createDataFrame(rows, frequencies.schema).agg(
            F.map_from_entries(F.collect_list(F.struct("id", "n"))).alias("m")
        )
        counted = F.transform(present, lambda x: F.struct(F.col("_m")[x].alias("n"), x.alias("id")))
        tagged = (
            df.withColumn("_m", small.scalar())
            .withColumn("stratum", F.coalesce(F.array_min(counted)["id"], F.lit(0)))
            .drop("_m")
        )
    else:
        rarest = (
            df.select(*key, F.explode(present).alias("id"))
            .join(frequencies, "id")
            .groupBy(*key)
            .agg(F.min(F.struct("n", "id"))["id"].alias("stratum"))
        )
        tagged = df.join(rarest, list(key), "left").fillna(0, ["stratum"])
    return stratified_split(tagged, "stratum", key, seed)


def _shared_out(rows: int, demands: tuple[int, int, int]) -> tuple[int, int]:
    """Rows for test and validation, in proportion to what the splits still need (rounded half up)."""
    test, validation, train = (max(d, 0) for d in demands)
    need = test + validation + train
    n_test = (2 * rows * test + need) // (2 * need) if need else 0
    rest = need - test
    n_validation = (2 * (rows - n_test) * validation + rest) // (2 * rest) if rest else 0
    return n_test, n_validation


def iterative_split(df: DataFrame, key: Sequence[str], labels: str = "labels", seed: int = 42) -> DataFrame:
    """split rows that carry several label ids so that every label is shared out 80/10/10; adds `split`.

    Labels take turns from the rarest to the most common (ties by id). A turn deals the rows
    that have this label and no rarer one, by what each split still needs of the label after
    the turns before. The rows are dealt in order of their label sets, at even distances, so
    that the labels which come along are shared out evenly too; inside a label set the order
    is that of the key's hash. What the common labels gain or lose in earlier turns is made
    good in their own. Rows without a label come last, with shares of their own.

    Row counts per label set and, for each turn, sums per label and split are all that is
    computed before the split; the driver holds one number per label and split. Rows are
    then cut off by hash inside their label set, as in `stratified_split`.
    """
    spark = df.sparkSession
    present = _present(labels)
    totals = df.select(F.explode(present).alias("id")).groupBy("id").agg(F.count("*").alias("n")).limit(MAX_SMALL_ROWS + 1).collect()
    if len(totals) > MAX_SMALL_ROWS:
        raise ValueError(f"more than {MAX_SMALL_ROWS} labels")
    turns = sorted(totals, key=lambda r: (r["n"], r["id"]))
    turn_of = spark.createDataFrame([(r["id"], k) for k, r in enumerate(turns, 1)], f"id {df.schema[labels].dataType.elementType.simpleString()}, k int")
    ranks = turn_of.agg(F.map_from_entries(F.collect_list(F.struct("id", "k"))).alias("m")).scalar()
    label_set = F.array_sort(F.transform(present, lambda x: F.col("_turns")[x]))
    rows = df.withColumn("_turns", ranks).withColumn("_set", F.coalesce(label_set, F.array().cast("array<int>"))).drop("_turns")
    # Label sets in order, one stratum per turn: places first .. first + n - 1.
    sets = rows.groupBy("_set").agg(F.count("*").alias("n")).withColumn("_turn", F.coalesce(F.get("_set", F.lit(0)), F.lit(0)))
    before = Window.partitionBy("_turn").orderBy("_set").rowsBetween(Window.unboundedPreceding, -1)
    sets = write_table(sets.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "label-sets")
    sizes = {r["_turn"]: r["n"] for r in sets.groupBy("_turn").agg(F.sum("n").alias("n")).collect()}

    def dealt(n: int, n_test: int, n_held: int) -> list[Column]:
        """How many of a set's rows are test, and test or validation, if these lie at even distances."""
        held = lambda place: f"(({place}) * {n_held} div {n})"
        test = lambda place: f"({held(place)} * {n_test} div {max(n_held, 1)})"
        return [F.expr(f"{f('first + n')} - {f('first')}").alias(name) for f, name in ((test, "n_test"), (held, "n_held"))]

    given = {k: [0, 0, 0] for k in range(len(turns) + 1)}
    parts = None
    for k in [*range(1, len(turns) + 1), 0]:
        n = sizes.get(k, 0)
        if not n:
            continue
        total = turns[k - 1]["n"] if k else n
        want_test = (total + 5) // 10
        want_validation = (2 * (total - want_test) + 9) // 18
        wanted = (want_test, want_validation, total - want_test - want_validation)
        n_test, n_validation = _shared_out(n, tuple(w - g for w, g in zip(wanted, given[k], strict=True)))
        own = sets.where(F.col("_turn") == k).select("_set", "n", *dealt(n, n_test, n_test + n_validation))
        taken = own.select(F.explode("_set").alias("k"), "n_test", (F.col("n_held") - F.col("n_test")).alias("v"), (F.col("n") - F.col("n_held")).alias("t"))
        for r in taken.groupBy("k").agg(F.sum("n_test").alias("a"), F.sum("v").alias("b"), F.sum("t").alias("c")).collect():
            given[r["k"]] = [x + y for x, y in zip(given[r["k"]], (r["a"], r["b"], r["c"]), strict=True)]
        part = own.select(F.array_join(F.col("_set").cast("array<string>"), ",").alias("_label"), "n_test", "n_held")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return df.withColumn("split", F.lit("train"))
    named = F.array_join(F.col("_set").cast("array<string>"), ",")
    return stratified_split(rows, named, key, seed, quotas=write_table(parts, "quotas")).drop("_set")


def label_balance(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows per label id and split, to check a split: label_id, total, n_train, n_validation, n_test."""
    counted = lambda split: F.count_if(F.col("split") == split).alias(f"n_{split}")
    present = F.explode(_present(labels))
    return (
        df.select("split", present.alias("label_id"))
        .groupBy("label_id")
        .agg(F.count("*").alias("total"), *[counted(s) for s in ("train", "validation", "test")])
    )
