"""Queries ``(spark, sf_dir) -> DataFrame`` of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from wavespark import ship
from wavespark.llm import html, licenses, lm, media, mixing, near, packing, quality, storage, tokens, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored images are a table of the shared folder, with zstd; features and tiles come from what is read back."""
    at = storage.shared_dir(spark, "media")
    media.store(_read(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(at)
    return media.features(spark.read.parquet(at), f"{at}-tiles")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(storage.table(quality.measures(_read(spark, sf_dir, "documents")), "measures"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str, order: int = 3) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs.filter(~lm.held_out()), order))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.shared_dir(spark, "warc")
    parts = warc.write_index(warc.write_archives(_read(spark, sf_dir, "pages"), folder), folder)
    return warc.read_back(spark, parts, folder).drop("url")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(_read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if not tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    files = tokens.write(_read(spark, sf_dir, "documents"), str(tokenizer), storage.shared_dir(spark, "ids"))
    return tokens.read(spark, files)


WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS r FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r = page_id THEN NULL ELSE r END AS refers_to FROM m
"""


def _shipped(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str, *a, **b) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir, *a, **b)

    return run


def queries() -> dict:
    return {k: _shipped(f) for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC_SQL, "op6_mixing": mixing.TAKEN_SQL}
