"""Language identification: words by their frequency in each language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, kept

UNKNOWN = "und"
#: Lengths of n-grams, from the first that an unseen word falls back to; words have a mark at either end.
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
#: Words whose evidence the score is spread over: a longer text is as sure as one of so many words.
EVIDENCE = 20
#: Entries that a worker holds before it hands them on or starts anew.
HELD = 300_000
#: Languages whose row counts are broadcast to the rows; of more, they are joined. Longest entry that the model has.
FEW, LONGEST = 10_000, 64


def letters(token: str) -> list[str]:
    """The words of a token: its runs of letters, in lower case."""
    token = token.lower()
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


def grams(word: str, n: int) -> list[str]:
    line = f"^{word}$" if n > 1 else word
    return [line[i : i + n] for i in range(len(line) - n + 1)]


@dataclass(frozen=True)
class Model:
    """Log frequencies by language of words and, by order, of n-grams; rows follow the dictionaries' numbers."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


def _logs(table: pa.Table, languages: list[str], totals: dict) -> tuple[dict[str, int], np.ndarray]:
    """totals: (order, language) -> n. Columns are size (the order), entry, lang, n; entries differ from order to order."""
    entries = table["entry"].combine_chunks().dictionary_encode()
    if isinstance(entries, pa.ChunkedArray):
        entries = entries.combine_chunks()
    codes, sizes = entries.indices.to_numpy(zero_copy_only=False), table["size"].to_numpy()
    at = pc.index_in(table["lang"], pa.array(languages, pa.string())).to_numpy()
    orders = np.zeros(len(entries.dictionary), int)
    orders[codes] = sizes
    counts = np.full((len(orders), len(languages)), SMOOTH)
    counts[codes, at] += table["n"].to_numpy()
    whole = {o: np.array([totals.get((o, x), 0) + SMOOTH * (n + 1) for x in languages]) for o, n in zip(*np.unique(orders, return_counts=True), strict=True)}
    for order, sums in whole.items():
        counts[orders == order] /= sums
    return dict(zip(entries.dictionary.to_pylist(), range(len(orders)), strict=True)), np.log(counts, out=counts)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 6_000, max_words: int = 120_000, max_grams: int = 160_000) -> Model:
    """A model of the languages in lang_col, from a sample of about per_language labelled rows of each.

    The sample is the rows whose hash of the whole row is low, so a language's hot rows don't fill it. max_words and
    max_grams bound what each worker gets: every language names its most frequent entries up to its equal share of them,
    and an entry that one names has the counts of all. Words over LONGEST letters are left to their n-grams. Rows with a
    null text or label don't train.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(*df.columns).alias("hash")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sample = rows.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, "lang").where(F.pmod("hash", F.lit(1 << 20)) * F.col("n") < F.lit(per_language << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(held.values(), pa.int64())], names=["lang", "word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for token, n in Counter(text.split()).items():
                    for word in letters(token):
                        held[lang, word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, int, str]] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([k[2] for k in held], pa.string()), pa.array(held.values(), pa.int64())], names=["lang", "size", "entry", "n"])
            held.clear()
            return batch

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for size in ORDERS:
                    for gram in grams(word, size):
                        held[lang, size, gram] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    words = kept(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    tables = kept(words.select("lang", F.lit(0).alias("size"), F.col("word").alias("entry"), "n").unionAll(words.mapInArrow(spread, "lang string, size int, entry string, n long").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))), "lang-tables")
    totals = {(r["size"], r.lang): r.n for r in tables.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for _, lang in totals})

    def best(where: str, most: int) -> pa.Table:
        entries = tables.where(where).where(F.char_length("entry") <= LONGEST)
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "size", "entry"))
        named = entries.withColumn("place", place).where(F.col("place") <= most // max(1, len(languages))).select("size", "entry").distinct()
        return entries.join(named, ["size", "entry"], "left_semi").select("size", "entry", "lang", "n").toArrow()

    return Model(languages, *_logs(best("size = 0", max_words), languages, totals), *_logs(best("size > 0", max_grams), languages, totals))


class Identifier:
    """Languages of texts by a model; what a token says is worked out once and remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.seen = model, {}
        self.rows, self.counts = np.zeros((1 << 12, len(model.languages))), np.zeros(1 << 12, int)

    def word(self, word: str) -> np.ndarray:
        m = self.model
        if word in m.words:
            return m.word_logs[m.words[word]]
        for n in ORDERS:
            known = [m.grams[g] for g in grams(word, n) if g in m.grams]
            if known:
                return m.gram_logs[known].sum(axis=0) / n
        return np.zeros(len(m.languages))

    def token(self, token: str) -> int:
        at = self.seen.get(token)
        if at is None:
            at = self.seen[token] = len(self.seen)
            if at == len(self.rows):
                self.rows, self.counts = np.concatenate((self.rows, np.zeros_like(self.rows))), np.concatenate((self.counts, np.zeros_like(self.counts)))
            found = letters(token)
            self.counts[at] = len(found)
            self.rows[at] = sum(map(self.word, found), np.zeros(len(self.model.languages)))
        return at

    def text(self, text: str | None) -> tuple[str, float]:
        if len(self.seen) > HELD:
            self.seen.clear()
        tokens = Counter((text or "").split())
        at = [self.seen[t] if t in self.seen else self.token(t) for t in tokens]
        times = np.fromiter(tokens.values(), float, len(tokens))
        n = float(times @ self.counts[at]) if at else 0.0
        if not n or not self.model.languages:
            return UNKNOWN, 0.0
        logs = times @ self.rows[at]
        logs = (logs - logs.max()) * min(1.0, EVIDENCE / n)
        shares = np.exp(logs) / np.exp(logs).sum()
        best = int(np.argmax(shares))
        return self.model.languages[best], min(1.0, float(shares[best]))


def language_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct (lang_pred, score) of each whole text, from that alone; the text is all that goes to the Python worker."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        identifier = Identifier(shared.value)
        for texts in batches:
            rows = [identifier.text(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.float64())], ["lang_pred", "score"])
        del identifier
        give_back()

    return found(text)


def identify(df: DataFrame, model: Model, text_col: str, *keep: Column) -> DataFrame:
    """keep, then lang_pred and score (its share of the likelihood, 0 to 1) of each row's whole text, from that alone.

    A null text or one without a letter is und with score 0, and so is any text where no language was learned. Ties go to
    the first language in order. Repeated rows are kept; an empty table gives no rows.
    """
    return df.select(*keep, F.inline(F.array(language_of(df.sparkSession, model, F.col(text_col)))))
