"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common, covertree, extraction, mixing, packing, quality, sharding, simhash, substring, suffix, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", common.word_count(F.col("text")).alias("size"), common.text_hash("text").alias("h"))
    docs = common.stage(docs, "op1-docs")  # words are counted once
    mixed = mixing.mix(docs, F.col("size"), F.col("source"), [F.col("doc_id"), F.col("h")])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", "fingerprint", "component_id")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "text")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_left")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", common.word_count(F.col("text")).alias("size"), common.text_hash("text").alias("h"))
    return packing.pack(docs, F.col("size"))


def op8_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = covertree.near_duplicates(table(spark, sf_dir, "embeddings"))
    return linked.select("vec_id", "n_links", "component_id", "kept")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_simhash, op3_substring, op4_suffix, op5_shard, op6_quality, op7_pack, op8_covertree, op9_extract, op10_warc)
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op3_substring": f"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents)),
g AS (SELECT doc_id, i, md5(string_agg(w, ' ') OVER s) AS h, count(*) OVER s AS n FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
b AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS bad FROM g WHERE n = 50),
c AS (SELECT w.doc_id, w.i, w.w, coalesce(max(CASE WHEN bad THEN w.i - 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS gone FROM w LEFT JOIN b ON w.doc_id = b.doc_id AND w.i = b.i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op6_quality": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, text IS NULL AS none FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d)),
c AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM w GROUP BY doc_id),
g AS (SELECT doc_id, i, md5(string_agg(w, ' ') OVER s) AS h, count(*) OVER s AS n FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {quality.REPEAT_WINDOW - 1} FOLLOWING)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS k FROM g WHERE n = {quality.REPEAT_WINDOW}) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r CROSS JOIN (SELECT unnest(range({quality.REPEAT_WINDOW})) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, line, lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')) AS nl, len(regexp_extract_all(line, '{_WORD}')) AS n FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE n > 0 GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS documents FROM d GROUP BY source),
f AS (SELECT source, nl, count(DISTINCT doc_id) AS k, min(doc_id) AS first FROM l WHERE n > 0 GROUP BY source, nl),
above AS (SELECT f.source, nl, first FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source WHERE k > {quality.LINE_DOCS} AND (k > {quality.LINE_MOST} OR k * {quality.LINE_SHARE} > documents)),
x AS (SELECT doc_id, count(*) AS n_lines_removed, sum(n) AS words_removed FROM l JOIN above ON l.source IS NOT DISTINCT FROM above.source AND l.nl = above.nl WHERE n > 0 AND doc_id <> first GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
coalesce(n_lines_removed, 0) AS n_lines_removed, CAST(coalesce(n_words, 0) - coalesce(words_removed, 0) AS BIGINT) AS n_words_left
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words_left >= {quality.WORDS_LEFT} AND n_words_left >= {quality.SHARE_LEFT} * n_words AS kept FROM m""",
    "op8_covertree": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
lows AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN lows ON vec_id = lows.a""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> max(page_id) OVER (PARTITION BY payload_digest) AS again, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM m""",
}
