from pyspark.sql import functions as F

from trialweave.llm import warc


def pages(spark, n=300):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>é {i}</p>" * (1 + i % 7)) for i in range(n)]
    rows += [(5, "http://h2.example/5", "again"), (5, "http://h2.example/5", "again"), (None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_layout_is_gapless_and_ordered(spark):
    records = warc.warc_records(pages(spark).repartition(5), archive_rows=50).orderBy("archive", "offset").collect()
    assert len(records) == 303
    at = {}
    for r in records:
        assert r.offset == at.get(r.archive, 0) and r.length == len(r.record)
        at[r.archive] = r.offset + r.length
        assert bytes(r.record).startswith(b"WARC/1.1\r\n") and bytes(r.record).endswith(b"\r\n\r\n")
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert int(head.rpartition(b"Content-Length: ")[2]) == len(rest) - 4
    assert [r.record_id for r in records][:2] == [None, 0]
    ids = [-1 if r.record_id is None else r.record_id for r in records]
    assert ids == sorted(ids)


def test_audit_names_exactly_the_damage(spark):
    records = warc.warc_records(pages(spark), archive_rows=50)
    assert warc.audit(records, records, 512, 4).count() == 0
    flipped = F.overlay("record", F.lit(b"X"), F.octet_length("record"), F.lit(1))
    other = (
        records.where("record_id IS NULL OR record_id <> 17")
        .withColumn("record", F.when(F.col("record_id").isin(3, 250), flipped).otherwise(F.col("record")))
        .unionByName(records.where("record_id = 8").withColumn("offset", F.col("offset") + 10_000_000))
    )
    got = {(r.archive, r.offset, r.kind) for r in warc.audit(records, other, 512, 4).collect()}
    place = {r.record_id: (r.archive, r.offset) for r in records.collect()}
    assert got == {
        (*place[3], "changed"),
        (*place[250], "changed"),
        (*place[17], "missing"),
        (place[8][0], place[8][1] + 10_000_000, "extra"),
    }


def test_sound_archives_are_not_descended_into(spark):
    records = warc.warc_records(pages(spark), archive_rows=50)
    levels = warc.tree_levels(records, 512, 4)
    tree = warc.merkle_tree(records, 512, 4, levels)
    roots = tree.where(F.col("level") == levels - 1)
    assert roots.select("node").distinct().count() == 1
    assert roots.count() == records.select("archive").distinct().count()


def test_rows_at_one_offset_and_empty_tables(spark):
    schema = "archive long, offset long, record binary"
    one = spark.createDataFrame([(0, 0, bytearray(b"a")), (0, 0, bytearray(b"b"))], schema)
    two = spark.createDataFrame([(0, 0, bytearray(b"a"))], schema)
    assert [(r.offset, r.kind) for r in warc.audit(one, two).collect()] == [(0, "changed")]
    assert warc.audit(one.limit(0), two.limit(0)).count() == 0
    assert [r.kind for r in warc.audit(one.limit(0), two).collect()] == ["extra"]
    assert warc.warc_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_columns_are_not_read(spark):
    df = pages(spark)
    wide = df.selectExpr("*", "1 AS archive", "'x' AS record", "2L AS offset")
    shown = lambda d: sorted(map(tuple, warc.warc_records(d, archive_rows=50).select("archive", "offset", "length").collect()))
    assert shown(wide) == shown(df)
