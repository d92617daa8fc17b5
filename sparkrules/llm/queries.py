"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, line_dedup, lm_scoring, near_dedup, packing, quality, sharding, url_filters, warc
from .common import Scratch

#: The rules of the URL query: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scoring.score(docs, lm_scoring.train(docs))
    return scored.select("doc_id", "n_tokens", "sum_logprob", "mean_logprob")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.apply_rules(pages, url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    read = warc.round_trip(pages)
    return read.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = Scratch(spark, "index").table(decontaminate.build_index(docs))
    found = decontaminate.search(index, _table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.n_hit())
    return found.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # taken before the exchange, so that texts need not travel
    crc = docs.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    sharded = sharding.shard(crc, shards=8)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_url_filters": op2_url_filters,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_warc": op5_warc,
        "op6_decontamination": op6_decontamination,
        "op7_packing": op7_packing,
        "op8_near_dedup": op8_near_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": r"""
            WITH p AS (
                SELECT page_id,
                       translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
                FROM pages),
            r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
            m AS (
                SELECT page_id, host, path, max({'n': length(h || r.p), 'rule': h || r.p, 'verdict': verdict}) AS best
                FROM p LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, r.p)
                GROUP BY page_id, host, path)
            SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m""",
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op5_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                              max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
            SELECT page_id, payload_bytes,
                   array_to_string(list_transform(range(32), lambda i:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
                   CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> best THEN best END AS refers_to
            FROM p""",
        "op6_decontamination": r"""
            WITH w AS (
                SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
                UNION ALL
                SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
            i AS (SELECT id AS item_id, ws, least(10, len(ws)) AS k FROM w WHERE kind = 'i' AND len(ws) > 0),
            iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM i)),
            d AS (SELECT id AS doc_id, ws FROM w WHERE kind = 'd'),
            dw AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS win
                   FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) AS ks)),
            hit AS (SELECT DISTINCT doc_id, item_id, k, p FROM dw JOIN iw USING (k, win)),
            words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM hit) GROUP BY doc_id),
            items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
            SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op9_line_dedup": """
            WITH l AS (SELECT doc_id, source, n, trim(line) AS t, line
                       FROM (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS n
                             FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
            total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
            often AS (SELECT source, t FROM l JOIN total USING (source) WHERE t <> ''
                      GROUP BY source, t, pages HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) > pages * 0.1),
            marked AS (SELECT l.*, often.t IS NOT NULL AS gone FROM l LEFT JOIN often USING (source, t)),
            done AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
            SELECT doc_id, CAST(n_dropped AS INT) AS n_dropped, sha256(text) AS text_sha256 FROM done""",
    }
