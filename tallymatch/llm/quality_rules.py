"""Quality rules whose cutoffs are certified on labelled holdouts: exact binomial bounds hold false rejections down."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept, words

#: Cutoffs to try for each rule, from lenient to strict; fixed before any label is seen.
GRID = {
    "symbols": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "dup_lines": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeats": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
    "brevity": (0.1, 0.09, 0.08, 0.07, 0.06, 0.05),
}


def text_features(df: DataFrame, text_col: str, *keep: Column, window: int = 5) -> DataFrame:
    """keep, then counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    n_repeat_words: the words in windows of so many words that occur twice or more in the text. Windows are compared
    by 64-bit hashes of their words' hashes. A null text has no words.
    """
    at = lambda array, i: F.get(array, i)
    out = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = out.withColumns({"_words": words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))})
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "_hashes": F.transform("_words", lambda x: F.xxhash64(x))})
    last = F.col("n_words").cast("int") - window
    out = out.withColumn("_windows", F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(at(F.col("_hashes"), i + k) for k in range(window))))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i, j: F.coalesce(x["h"] == at(F.col("_sorted"), i + j)["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: same(x, i, 1) | F.when(i > 0, same(x, i, -1)).otherwise(False))
    out = out.withColumn("_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, i: F.struct((acc["n"] + i + window - F.greatest(i, acc["end"])).alias("n"), (i + window).alias("end")), lambda acc: acc["n"])
    return out.select(
        *(c for c in out.columns if c[0] != "_"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def rule_scores() -> dict[str, Column]:
    """Each rule's score of a row of text_features; a higher one speaks against the text."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "brevity": F.lit(1) / F.greatest(F.col("n_words"), F.lit(1))}


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of Binomial(n, rate), summed term by term as logarithms; 1 where k is over its mean."""
    step = math.log(rate / (1 - rate))
    start = n * F.lit(math.log1p(-rate))

    def more(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + step
        high, low = F.greatest(term, acc["sum"]), F.least(term, acc["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>")), F.struct(start.alias("term"), start.alias("sum")), more, lambda acc: F.exp(acc["sum"]))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(total)


def certified_cutoffs(holdout: DataFrame, stratum_col: str, good: Column, false_rejections: float = 0.04, risk: float = 0.05) -> DataFrame:
    """(stratum, n_good, cut_<rule>...): the strictest certified cutoff of each rule in each stratum, null where none is.

    A cutoff's false rejection rate on a stratum's good documents is at most false_rejections / rules where the exact
    binomial test of the opposite is rejected. The risk is split over all pairs of stratum and rule (Bonferroni); within a
    pair the cutoffs are tested from lenient to strict up to the first that fails, which needs no further correction.
    So with probability 1 - risk, no stratum loses more than false_rejections of its good documents to all rules together.
    """
    rules, scores = list(GRID), rule_scores()
    counts = holdout.where(good).groupBy(F.col(stratum_col).alias("stratum")).agg(F.count("*").alias("n_good"), *(F.sum((scores[r] > c).cast("long")).alias(f"{r}_{i}") for r in rules for i, c in enumerate(GRID[r])))
    strata = F.count("*").over(Window.partitionBy(F.lit(0)))
    passed = lambda r, i: binomial_tail(F.col(f"{r}_{i}"), F.col("n_good"), false_rejections / len(rules)) <= risk / (len(rules) * F.col("strata"))
    tested = counts.withColumn("strata", strata).select("stratum", "n_good", *(F.array(*(passed(r, i) for i in range(len(GRID[r])))).alias(r) for r in rules))

    def strictest(r: str) -> Column:
        failed = F.array_position(r, F.lit(False))
        n = F.when(failed == 0, F.lit(len(GRID[r]))).otherwise(failed - 1).cast("int")
        return F.get(F.array(*map(F.lit, GRID[r])), n - 1)

    return tested.select("stratum", "n_good", *(F.when(F.element_at(r, 1), strictest(r)).alias(f"cut_{r}") for r in rules))


def quality_verdicts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **certify: float) -> DataFrame:
    """One row per row of df: id, stratum, the text's counts, base_failed and kept.

    labels has (id, quality); a document with several labels counts as good if one says so, ids that are null or not in
    df are left out. Documents whose stratum has no certified cutoff are judged by the base rule alone, null strata
    form one of their own. Null and empty texts have no words and so fail the base rule. Repeated rows are kept.
    The counts are written once to the shared folder; only they are joined, never the texts.
    """
    features = kept(text_features(df, text_col, F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum")), "quality")
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"))
    cuts = kept(certified_cutoffs(features.join(marks, "id"), "stratum", F.col("quality") == 1, **certify), "cutoffs").withColumnRenamed("stratum", "of")
    rejected = F.lit(False)
    for rule, score in rule_scores().items():
        rejected |= F.coalesce(score > F.col(f"cut_{rule}"), F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = features.join(cuts, features["stratum"].eqNullSafe(cuts["of"]), "left")
    return out.select(F.col("id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
