"""The queries opN_<name>: each operator with its production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .alignment import align
from .alignment import digests as link_digests
from .decontamination import decontaminate
from .html_text import html_text
from .language_id import language_id
from .licenses import license_scan
from .ngram_join import ngram_join
from .packing import pack
from .periodic_runs import digests as run_digests
from .periodic_runs import periodic_runs, with_planted_runs
from .pieces import digests as piece_digests
from .pieces import encode_pieces
from .quality import quality
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .topk_search import topk_search


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary packing uses; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """The public piece vocabulary; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(_read(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup(_read(spark, sf_dir, "documents"), with_text=False)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_read(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup(_read(spark, sf_dir, "documents"), with_text=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(_read(spark, sf_dir, "documents"))))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_digests(align(_read(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path()))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(encode_pieces(_read(spark, sf_dir, "documents"), piece_model_path()))


QUERIES = {
    f.__name__: f
    for f in (op1_topk_search, op2_substring_dedup, op3_license_scan, op4_ngram_join, op5_quality, op6_language_id, op7_packing, op8_html_text, op9_suffix_dedup, op10_decontamination, op11_periodic_runs, op12_alignment, op13_pieces)
}
ORACLE_SQL = oracle.SQL
