"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import decontaminate, exact_dedup, langid, lexical_search, mixing, near_dedup, packing, pii, quality, secret_scan, topk, warc, whitening
from trialweave.llm.common import crc_mod, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    scored = quality.score_documents(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs.where(crc_mod("doc_id", 5) != 0)))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"]))
    return found.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.array_join(spans, ",").alias("spans")
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a replica in which a rule on the record's id flips bytes and loses records."""
    records = warc.warc_records(table(spark, sf_dir, "pages"))
    mark = F.substring(F.md5(F.coalesce(F.col("record_id").cast("string"), F.lit(""))), 1, 2)
    flipped = F.overlay("record", F.lit(b"X"), F.octet_length("record"), F.lit(1))
    replica = records.where(mark != "00").withColumn("record", F.when(mark.isin("01", "02", "03", "04"), flipped).otherwise(F.col("record")))
    damaged = warc.audit(records, replica)
    return damaged.join(records.select("archive", "offset", "length", "record_id"), ["archive", "offset"]).select(
        "archive", "offset", "length", F.col("record_id").alias("page_id"), "kind"
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(shown, ",").alias("spans"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations beyond a long, which need some millions of vectors, are null here."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_exact_dedup,
        op3_topk,
        op4_packing,
        op5_secrets,
        op6_mixing,
        op7_near_dedup,
        op8_quality,
        op9_language,
        op10_warc,
        op11_search,
        op12_decontamination,
        op13_whitening,
    )
}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_search": r"""
        WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
        docs AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, doc_id,
                regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents, low),
        counts AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) GROUP BY ALL),
        totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_words FROM docs),
        asked AS MATERIALIZED (
            SELECT row_number() OVER () AS q, item_id,
                list_distinct(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
            FROM benchmark, low),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
            FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
        scores AS (
            SELECT q, c.rid, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(d.w) * n_docs) // n_words)))))::BIGINT AS score
            FROM (SELECT q, unnest(w) AS term FROM asked) i JOIN weights USING (term) JOIN counts c USING (term) JOIN docs d ON d.rid = c.rid, totals
            GROUP BY ALL),
        ranked AS (
            SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
            FROM scores JOIN docs USING (rid) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked JOIN asked USING (q) WHERE rank <= 50""",
    "op12_decontamination": r"""
        WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
        items AS (
            SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark, low),
        grams AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS gram
            FROM items, unnest(range(0, greatest(len(w) - 9, 1))) t(i) WHERE len(w) > 0),
        docs AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents, low),
        placed AS (
            SELECT rid, n, i, array_to_string(w[i + 1 : i + n], ' ') AS gram
            FROM docs, (SELECT DISTINCT n FROM grams), unnest(range(0, len(w) - n + 1)) t(i)),
        hits AS (SELECT p.rid, p.i, p.n, g.item FROM placed p JOIN grams g ON g.n = p.n AND g.gram = p.gram),
        covered AS (SELECT DISTINCT rid, i + k AS pos FROM hits, unnest(range(0, n)) t(k)),
        spans AS (
            SELECT rid, string_agg(s || ':' || e, ',' ORDER BY s) AS spans, sum(e - s)::BIGINT AS n_hit FROM (
                SELECT rid, min(pos) AS s, max(pos) + 1 AS e
                FROM (SELECT rid, pos, pos - row_number() OVER (PARTITION BY rid ORDER BY pos) AS run FROM covered) GROUP BY rid, run) GROUP BY rid),
        found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN spans USING (rid) LEFT JOIN found USING (rid)""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, row_number() OVER (ORDER BY page_id) - 1 AS place FROM pages),
        l AS (
            SELECT *, place // 1000 AS archive, strlen('WARC/1.1') + 2 + strlen('WARC-Type: response') + 2
                + strlen('WARC-Record-ID: <urn:page:>') + strlen(page_id::VARCHAR) + 2 + strlen('WARC-Target-URI: ') + strlen(url) + 2
                + strlen('WARC-Payload-Digest: sha256:') + 64 + 2 + strlen('Content-Type: text/html') + 2
                + strlen('Content-Length: ') + strlen(strlen(html)::VARCHAR) + 4 + strlen(html) + 4 AS length FROM p),
        o AS (
            SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset",
                left(md5(page_id::VARCHAR), 2) AS mark FROM l)
        SELECT archive, "offset", length, page_id, CASE WHEN mark = '00' THEN 'missing' ELSE 'changed' END AS kind
        FROM o WHERE mark IN ('00', '01', '02', '03', '04')""",
}
