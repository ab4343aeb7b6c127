"""The registered corpus queries, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.simhash import near_duplicates

    found = near_duplicates(_documents(spark, sf_dir))
    # hex() of a long drops leading zeros.
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.neural_lm import score_texts

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score_texts(_documents(spark, sf_dir), held_out).withColumnRenamed("key", "doc_id")


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.compression_rules import compression_quality

    return compression_quality(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "verdict.*")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from planweave.llm.token_counts import token_counts

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "tokens.*")


def op1_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.fm_quality import fit, score_texts
    from planweave.llm.labelled import fold

    docs = _documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=["n_chars"])
    scored = score_texts(docs, machine, metadata=["n_chars"], into="score")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.ring_sharding import shard_rows

    placed = shard_rows(_documents(spark, sf_dir), shards=40)
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.suffix_decontam import find_contamination

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(_documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select("doc_id", *[f"contamination.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op8_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.warc import read_warc, write_warc

    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)
    return read_warc(files, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op9_apportion_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.apportion_mixing import mix

    return mix(_documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planweave.llm.labelled import fold
    from planweave.llm.pu_toxicity import fit, score_texts

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs, model, into="score")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_fm_quality, op2_ring_sharding, op3_simhash_pivots, op4_log_bilinear_lm, op5_compression_bands, op6_suffix_decontamination, op7_token_counts, op8_warc_roundtrip, op9_apportion_mixing, op10_pu_toxicity)}
#: Words and windows of benchmark contamination: 13 words in a row, or a whole item of fewer.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP6 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), i AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wi AS MATERIALIZED (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM wi),
wd AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN ns ON len(w) >= n)),
m AS MATERIALIZED (SELECT r, p, wd.n, item FROM wd JOIN wi ON wi.n = wd.n AND wi.t = wd.t),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN k ON k.r = d.r"""
_OP8 = """
WITH b AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
s AS MATERIALIZED (SELECT page_id, octet_length(encode(p)) AS payload_bytes, sha1(encode(p)) AS h FROM b),
f AS (SELECT h, min(page_id) AS first FROM s GROUP BY h),
bits AS (SELECT DISTINCT h, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', h[i])]), '') AS b FROM s),
d AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[5 * i + 1] AS INTEGER) + 8 * CAST(b[5 * i + 2] AS INTEGER) + 4 * CAST(b[5 * i + 3] AS INTEGER) + 2 * CAST(b[5 * i + 4] AS INTEGER) + CAST(b[5 * i + 5] AS INTEGER)]), '') AS payload_digest FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM s JOIN f ON f.h = s.h JOIN d ON d.h = s.h"""
#: The others need hashes, compressors, tokenizers or training that SQL has not; the tests hold them against brute force.
ORACLE_SQL = {"op6_suffix_decontamination": _OP6.strip(), "op8_warc_roundtrip": _OP8.strip()}
