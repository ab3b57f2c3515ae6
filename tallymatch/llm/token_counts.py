"""Token counts through a cache of digests: every text is encoded once for each version of a tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of texts that a worker remembers the counts of, before it starts anew.
MEMO = 1_000_000

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _pieces(path: str):
    """A sentencepiece model's counts. Where normalising only marks the spaces of a text and no piece reaches over one,
    its parts between single spaces merge apart from each other, so each distinct part is encoded once and remembered."""
    import sentencepiece
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model, mark = sentencepiece.SentencePieceProcessor(model_file=path), "\u2581"
    (spec := ModelProto()).ParseFromString(model.serialized_model_proto())
    plain = not spec.normalizer_spec.precompiled_charsmap and spec.normalizer_spec.add_dummy_prefix and spec.normalizer_spec.escape_whitespaces and not spec.normalizer_spec.remove_extra_whitespaces
    apart = plain and all(mark not in piece.piece.lstrip(mark) for piece in spec.pieces)
    memo: dict[str, int] = {}

    def count(text: str) -> int:
        parts = text.split(" ")
        if not apart or mark in text or "" in parts:
            return len(model.encode(text))
        try:
            return sum(map(memo.__getitem__, parts))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            new = [x for x in dict.fromkeys(parts) if x not in memo]
            memo.update(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
        return sum(map(memo.__getitem__, parts))

    return lambda texts: list(map(count, texts))


@lru_cache(maxsize=4)
def _encoder(path: str):
    """Counts of a list of texts by the library that the file is for."""
    if path.endswith(".model"):
        return _pieces(path)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def version(path: str) -> str:
    """A tokenizer's version: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _cache(spark, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(df: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch: int = 64) -> DataFrame:
    """Per row of df: id, n_bytes, n_tokens, over_limit (n_tokens > limit), by the tokenizer in the file given.

    cache is a Parquet folder that may be missing at first. Content is normalised only as far as no tokenizer could
    tell (a null is an empty text; UTF-8 bytes) before it is digested. Digests that the cache lacks for this version
    are encoded once each and appended before the counts are joined to the rows, so copies and later runs cost a join.
    A lost append leaves no rows (the writer commits at the end); a repeated one leaves equal rows, which count once.
    Null ids and repeated rows are kept, empty texts have the library's count for them, an empty table gives no rows.
    """
    spark, stamp = df.sparkSession, version(tokenizer)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    known = lambda: _cache(spark, cache).where(F.col("tokenizer") == stamp).select("digest", "n_tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(tokenizer)
        for b in batches:
            texts, n = b.column(1), []
            for i in range(0, len(texts), batch):
                n += count(texts.slice(i, batch).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([stamp] * len(n), pa.string()), b.column(0).cast(pa.binary()), pa.array(n, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    distinct.join(known(), "digest", "left_anti").select("digest", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = known().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
