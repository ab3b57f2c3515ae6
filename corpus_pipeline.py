"""The corpus pipeline: documents in a known language, one of each near-duplicate group, without secrets, mixed, packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch.llm.common import documents, kept
from tallymatch.llm.language_id import UNKNOWN, fit, language_of
from tallymatch.llm.mixing import mix, mixed_texts
from tallymatch.llm.ngram_join import jaccard_components
from tallymatch.llm.packing import pack_documents
from tallymatch.llm.queries import tokenizer
from tallymatch.llm.secret_scan import find_secrets, redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and that column's name."""
    key = next(k for k in (f"_key{i or ''}" for i in range(len(docs.columns) + 1)) if k not in docs.columns)
    return kept(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: a null text or one without a letter."""
    return docs.where(language_of(spark, fit(docs), F.col("text"))["lang_pred"] != UNKNOWN)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the least id. Where ids are null or repeat, rows are
    written with a key: of rows alike in id one stays, and one without an id where its group has no other."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty():
        groups = jaccard_components(docs)
        return docs.join(groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    keyed, key = with_key(docs)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    groups = jaccard_components(keyed.select(row.alias("row"), "text"), "row")
    return keyed.join(groups.where("row.key = component_id.key").select(F.col("row.key").alias(key)), key, "left_semi").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with a mark where a secret was; n_chars follows the text."""
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("doc")
    found = find_secrets(docs.select(row, "text"), ("doc",))
    text = redact(F.col("doc.text"), F.col("secrets"))
    new = {"text": text, "n_chars": F.when(F.size("secrets") > 0, F.char_length(text).cast("long")).otherwise(F.col("doc.n_chars"))}
    return found.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, the last time the words of the chosen blocks alone.

    Rows are written with a key, as ids may be null or repeat.
    """
    keyed, key = with_key(docs)
    return mixed_texts(keyed, mix(keyed, key_col=key), key).drop(key).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack_documents(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The stages in order: each takes what its predecessor kept, and all but the last return documents.
STAGES: list[tuple[str, Stage]] = [("language_id", known_language), ("ngram_join", one_of_each), ("secret_scan", without_secrets), ("mixing", mixed), ("packing", packed)]

#: Language models and tokenizers have no SQL; tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
