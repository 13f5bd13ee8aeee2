"""Queries of the thirteen operators, each over its whole table, and their DuckDB SQL where that can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, exact_dedup, fim, html_text, language_id, licenses, line_dedup, near_dedup, packing, secret_scan, sharding, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.rendezvous_shards(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long").alias(f"n_{secret_scan.RULES[k].kind}")
    base = F.filter("spans", lambda s: s["rule"] < len(secret_scan.BASE))
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(secret_scan.shown(base), 256).alias("base_sha256"), secret_scan.shown(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    restored = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op10_licenses": op10_licenses,
    "op6_language_id": op6_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op11_whitening": op11_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op4_warc": """
        WITH hashed AS (
            SELECT page_id, url, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages
        ), firsts AS (
            SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM hashed
        ), ids AS (
            SELECT *, md5('request ' || page_id || ' ' || digest || ' 1') AS h FROM firsts
        )
        SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, url AS target_uri,
               '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS request_id,
               true AS digest_ok
        FROM ids
    """,
    "op10_licenses": licenses.oracle_sql(),
    "op12_secret_scan": secret_scan.oracle_sql(),
    "op13_fill_in_middle": fim.oracle_sql(),
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, line, pos FROM (
                SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                       generate_subscripts(string_split(text, chr(10)), 1) AS pos
                FROM documents)
        ), common AS (
            SELECT trim(line) AS t FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10
        ), marked AS (
            SELECT l.doc_id, l.line, l.pos, c.t IS NOT NULL AS goes FROM lines l LEFT JOIN common c ON trim(l.line) = c.t
        )
        SELECT d.doc_id, coalesce(m.n, 0) AS lines, coalesce(m.removed, 0) AS lines_removed,
               CASE WHEN d.text IS NOT NULL THEN coalesce(m.kept, '') END AS text
        FROM documents d LEFT JOIN (
            SELECT doc_id, count(*) AS n, count(*) FILTER (goes) AS removed,
                   string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes) AS kept
            FROM marked GROUP BY doc_id) m USING (doc_id)
    """,
    "op7_exact_dedup": """
        WITH folded AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM folded WINDOW same AS (PARTITION BY norm)
    """,
}
