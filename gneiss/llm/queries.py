"""The corpus queries: thin functions over this package's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import ann, bpe, license, linededup, packing, pii, quality, setsketch, sharding, warc
from gneiss.llm.common import table

#: Shards before and after resharding.
OLD_SHARDS, SHARDS = 32, 40


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.capture_histories(table(spark, sf_dir, "pages"), least_bytes=0)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", terms)).alias("spans")
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.reshard(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + sharding.ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = setsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.COUNTS, "base_failed", "kept", "reason")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_line_dedup, op3_bpe, op4_warc, op5_pii, op6_nearest, op7_reshard, op8_pack, op9_near_duplicates, op10_quality]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
f AS (SELECT key AS gone FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.gone GROUP BY r"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(html), {} * 5 + 1, 5))::BIGINT >> {}) & 31) + 1)::BIGINT, 1)"
_BASE32 = " || ".join(_DIGIT.format(k, s) for k in range(8) for s in (15, 10, 5, 0))

WARC_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, url, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 1 THEN words ELSE list_distinct([words[k] || ' ' || words[k + 1] for k in range(1, len(words))]) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = n.doc_id AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license.oracle_sql(), "op2_line_dedup": LINE_DEDUP_SQL, "op4_warc": WARC_SQL, "op9_near_duplicates": NEAR_SQL}
