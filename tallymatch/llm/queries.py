"""The queries of this subpackage, each with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .common import documents, remainder
from .fill_in_middle import fill_in_middle, fim_digests
from .html_extraction import main_texts
from .language_id import fit, identify
from .lm_suffix_tree import lm_scores
from .media_tiff import tiff_digests, tiff_from_text
from .mixing import mix
from .ngram_join import jaccard_components
from .oracles import ORACLES as ORACLES
from .packing import pack_documents
from .quality_rules import quality_verdicts
from .secret_scan import KINDS, find_secrets, span_text
from .substring_dedup import repeated_passages
from .token_alignment import align_tokens
from .token_counts import token_counts


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 3) == 1
    return identify(docs, fit(docs.where(~held_out)), "text", "doc_id", held_out.alias("held_out"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_lm_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), new_path(spark, "token-cache"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir)).withColumn("base", F.filter("secrets", lambda x: x["kind"] < KINDS.index("random")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_digests(tiff_from_text(documents(spark, sf_dir)))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(fill_in_middle(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_packing, op4_lm_suffix_tree, op5_token_counts, op6_mixing, op7_secret_scan, op8_ngram_join, op9_quality_rules, op10_media_tiff, op11_token_alignment, op12_html_extraction, op13_fill_in_middle)}
