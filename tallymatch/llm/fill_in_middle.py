"""Fill-in-middle: a text cut into units, rearranged around its middle with sentinels, and put back together from them.

Columns alone: regular expressions make the units, digits of a sha256 the cuts, slices the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Units of a text: its lines, each with its end.
LINES = r"[^\n]*\n|[^\n]+"


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of seed:key. A null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arranged(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The parts in the order of form, each after its sentinel; a plain text as it is."""
    p, s, m = map(F.lit, sentinels)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. A part has no sentinel within it, so the first of each parts the output."""
    p, s, m = sentinels
    until = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring(text, F.char_length(until(text, mark)) + len(mark) + 1, F.char_length(text))
    psm = F.concat(until(after(output, p), s), after(output, m), until(after(output, s), m))
    spm = F.concat(until(after(output, p), m), after(output, m), until(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, units: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row of df: id, text, n (units), form, prefix, middle and suffix (null where plain), output.

    rate of a hundred texts are rearranged, spm_rate of a hundred of these with the suffix first. The cuts are drawn from
    the id and the seed alone, so a rerun, or another order of rows, cuts alike. A null text is an empty one and plain; so
    is a text that has a sentinel already, which keeps every output restorable. Any part may be empty. Repeated rows are
    kept and cut alike; rows without an id draw as one with an empty id; an empty table gives no rows. Every text is taken
    whole, in one projection: nothing is shuffled.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(units), F.lit(0)).alias("units"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    n = F.size("units").cast("long")
    taken = F.col("text") == ""
    for mark in sentinels:
        taken |= F.contains("text", F.lit(mark))
    form = F.when(taken | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("*", n.alias("n"), form.alias("form"), F.least(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int").alias("a"), F.greatest(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int").alias("b"))
    part = lambda begin, end: F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, end - begin), ""))
    a, b = F.col("a"), F.col("b")
    rows = rows.select("id", "text", "n", "form", part(F.lit(0), a).alias("prefix"), part(a, b).alias("middle"), part(b, F.size("units")).alias("suffix"))
    output = arranged(F.col("form"), F.col("text"), F.col("prefix"), F.col("middle"), F.col("suffix"), sentinels)
    return rows.select(F.col("id").alias(id_col), "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def fim_digests(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What fill_in_middle gave, as lengths and digests; the text is rebuilt from output and form alone."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return parts.select(id_col, "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
