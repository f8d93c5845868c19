import pytest
from pyspark.sql import functions as F

from trialweave.operators import skew


@pytest.fixture(scope="module")
def tables(spark):
    many = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"))
    one = spark.range(0, 90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return many, one


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("options", [{}, {"max_broadcast": 0}, {"max_broadcast": 0, "block_rows": 50}])
def test_hot_key_join_is_the_plain_join(tables, how, options):
    many, one = tables
    got = skew.join_on_hot_key(many, one, ["k"], ["row"], how, **options).select("k", "row", "v")
    want = many.join(one, "k", how).select("k", "row", "v")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_hot_rows_are_spread(tables):
    many, _ = tables
    blocks = skew.hot_blocks(many, ["k"], 100)
    assert [tuple(r) for r in blocks.collect()] == [(0, 11)]
    spread = skew.scatter(many, blocks, ["k"], ["row"]).where("k = 0").groupBy("_block").count().collect()
    assert len(spread) == 11 and max(r["count"] for r in spread) < 200
    assert skew.hot_blocks(many, ["k"], 5000) is None and skew.hot_blocks(many, ["k"], None) is None


def test_many_hot_keys_are_joined_not_broadcast(tables, monkeypatch):
    many, one = tables
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 2)
    got = skew.join_on_hot_key(many, one, ["k"], ["row"], max_broadcast=0, block_rows=5)
    assert got.count() == many.join(one, "k").count()


def test_sampled_hot_keys_do_not_change_the_result(tables):
    many, one = tables
    got = skew.join_on_hot_key(many, one, ["k"], ["row"], "left", many.sample(0.2, seed=3), 0.2, 50, 0)
    assert got.count() == 3000


@pytest.mark.parametrize("bound", [10_000, 1])
def test_small_join(tables, bound):
    many, one = tables
    assert skew.join_small(many, one, ["k"], "inner", bound).count() == many.join(one, "k").count()


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    from trialweave.session import spread

    import pyarrow as pa
    import pyarrow.parquet as pq

    def at(name, row_group_size):
        pq.write_table(pa.table({"k": list(range(20_000))}), tmp_path / name, row_group_size=row_group_size)
        return spark.read.parquet(str(tmp_path / name))

    def held(df):
        return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    cores = spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "4096")
        one = at("one.parquet", 20_000)
        assert one.rdd.getNumPartitions() >= cores and held(one) == [20_000]
        dealt = spread(one)
        assert len(held(dealt)) >= cores and held(dealt)[-1] * cores <= 2 * 20_000
        assert sorted(r.k for r in dealt.collect()) == list(range(20_000))
        many = at("many.parquet", 200)
        assert spread(many) is many
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert spread(spark.range(0, 0, 1, cores)).count() == 0
