"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import classifier, exact, hamming, html_text, licenses, neardup, packing, pii, repetition, spelling, tokens, urls, whitening
from tracklake.llm._session import table
from tracklake.llm.oracle import ORACLE_SQL as ORACLE_SQL


def _vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = classifier.fit(docs, labels.where(~held_out))
    return classifier.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.codes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    return hamming.top_k(codes, codes.where("id % 50 = 0"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary())


def op4_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(table(spark, sf_dir, "documents"), _vocabulary(), keep=False)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.unwanted_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = pii.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), "replace-this-key", report=True)
    return changed.select("doc_id", "n_entities", "entity_kinds", "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_quality(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 9) for c in ("top_share", "line_share")})


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_convolution,
        op2_multi_index_hashing,
        op3_best_fit_packing,
        op4_bpe_chunk_reuse,
        op5_minhash_near_dedup,
        op6_html_layout,
        op7_url_filter,
        op8_surrogates,
        op9_repetition_rules,
        op10_license_scan,
        op11_spelling_variants,
        op12_exact_dedup,
        op13_embedding_whitening,
    )
}
