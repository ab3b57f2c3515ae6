"""Mixing sources to target weights: Sainte-Lague quotas of equal blocks of words, then a seeded choice of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, kept, words

#: No source gives more than so many times its words.
MOST = 3
#: Shards that a source has at most.
SHARDS = 1 << 16
SEED = "mix-1"


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size) with nth, its place in the order of sources, weight and target added.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share all words by weight; one that would exceed
    most times its source stops there, and what it leaves is shared among the rest again. In order of most * size /
    weight, the sources that stop are a prefix, so one pass over the sources finds the end of that sharing.
    """
    everything = Window.partitionBy(F.lit(0))
    by_code = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_limit), F.lit(0))
    out = sources.withColumns({"nth": F.row_number().over(by_code), "weight": (F.row_number().over(by_code) - 1) % 3 + 1, "cap": most * F.col("source_size"), "whole": F.sum("source_size").over(everything)})
    share = (F.col("whole") - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    out = out.withColumn("stops", F.col("cap") <= F.col("weight") * share)
    left = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))).over(everything), F.lit(0))
    level = (F.col("whole") - left("cap", F.col("stops"))) / left("weight", ~F.col("stops"))
    return out.select("source", "source_size", "nth", "weight", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def apportion(parties: DataFrame, by: list[str], party: str, votes: str, house: str, most: str) -> DataFrame:
    """parties (one row for each value of party within by) with seats: Sainte-Lague's apportionment of house seats.

    Seats go one by one to the highest quotients votes / (2k - 1), k being the seat that a party would get; equal quotients
    to the lesser party first; no party gets more than most. All seats that a divisor of sum(votes) / (house - n / 2) gives
    by rounding are among the highest of n parties, and one of sum(votes) / (house + n / 2) gives house seats or more; so
    only the few quotients of each party between these two are ranked.
    """
    of = Window.partitionBy(*(F.col(c) for c in by)) if by else Window.partitionBy(F.lit(0))
    rounded = lambda h: F.floor(F.col(votes) * h / F.greatest("_all", F.lit(1)) + 0.5)
    out = parties.withColumns({"_n": F.count("*").over(of), "_all": F.sum(votes).over(of)})
    out = out.withColumns({"_base": F.least(most, F.greatest(F.lit(0), rounded(F.col(house) - F.col("_n") / 2) - 1)), "_top": F.least(most, rounded(F.col(house) + F.col("_n") / 2) + 1)})
    out = out.withColumn("_left", F.col(house) - F.sum("_base").over(of))
    out = out.withColumn("_k", F.explode(F.sequence("_base", F.greatest("_base", "_top"))))
    asked = F.col("_k") > F.col("_base")
    place = F.row_number().over(of.orderBy(F.desc(asked), F.desc(F.col(votes) / (2 * F.greatest("_k", F.lit(1)) - 1)), party, "_k"))
    won = F.sum((asked & (F.col("_place") <= F.col("_left"))).cast("long"))
    return out.withColumn("_place", place).groupBy(*by, party).agg(*(F.first(c).alias(c) for c in parties.columns if c not in (*by, party)), (F.first("_base") + won).alias("seats"))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def _number(digest: Column, n: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 32, shard_words: int = 262_144, key_col: str | None = None) -> DataFrame:
    """Per row of df: id, source, size, source_size, target, taken, and where its words lie: at, repeats, extra, n_blocks, first.

    The mix has as many blocks of block_words as all words fill, and these are the seats of two apportionments: sources
    get theirs by their targets, and each source's shards by their words, MOST for each of their blocks at most. A hash of
    id and text deals a source's rows to shards, and seeded order lays a shard's words out as blocks. A shard's seats are
    whole rounds over its blocks (repeats), then one more for extra blocks evenly spaced from a seeded first one. So taken
    follows from a row's place alone, and no block or row is taken more than MOST times. Reruns agree.
    A null text has no words and takes none; a null id orders as an empty one; rows alike in id and text share a shard;
    equal ones have equal parts, whichever comes first. key_col, which tells rows apart where ids may not, comes last in
    that order and is handed on.
    """
    key = [key_col] if key_col else []
    digest = _hash(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = kept(df.select(*key, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), digest.alias("digest")), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumns({"house": F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_words + 0.5), "most": MOST * F.ceil(F.col("source_size") / block_words)})
    sources = apportion(sources, [], "nth", "target", "house", "most").select(F.col("source").alias("of"), "nth", "source_size", "target", F.col("seats").alias("source_seats"))
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["of"])).drop("of")
    shards = F.greatest(F.least(F.ceil(F.col("source_size") / shard_words), F.lit(SHARDS)), F.lit(1))
    placed = placed.withColumn("shard", _number(F.col("digest"), shards))
    n_blocks = F.ceil(F.col("shard_size") / block_words)
    sums = placed.groupBy("nth", "shard").agg(F.first("source_seats").alias("source_seats"), F.sum("size").alias("shard_size")).withColumn("most", MOST * n_blocks)
    seats = apportion(sums, ["nth"], "shard", "shard_size", "source_seats", "most").select("nth", "shard", F.greatest(n_blocks, F.lit(1)).alias("n_blocks"), "seats")
    order = Window.partitionBy("nth", "shard").orderBy("digest", "id", "size", *key)
    placed = placed.drop("source_seats").join(seats, ["nth", "shard"]).withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumns({"repeats": F.floor(F.col("seats") / F.col("n_blocks")), "extra": F.col("seats") % F.col("n_blocks"), "first": _number(_hash(F.coalesce("source", F.lit("\0")), F.col("shard")), F.col("n_blocks"))})
    upto = lambda x: block_words * _chosen(F.floor(x / block_words)) + x % block_words * is_extra(F.floor(x / block_words))
    taken = F.col("repeats") * F.col("size") + upto(F.col("at") + F.col("size")) - upto(F.col("at"))
    return placed.select(*key, F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"), "at", "repeats", "extra", "n_blocks", "first")


def _chosen(b: Column) -> Column:
    """How many extra blocks there are among a shard's first b."""
    grid = lambda y: F.floor(y * F.col("extra") / F.col("n_blocks"))
    y = b + F.col("first")
    return F.when(y <= F.col("n_blocks"), grid(y) - grid(F.col("first"))).otherwise(F.col("extra") - grid(F.col("first")) + grid(y - F.col("n_blocks")))


def is_extra(b: Column) -> Column:
    """1 for a block that gives its words once more than the others of its shard."""
    return F.when(b < F.col("n_blocks"), _chosen(b + 1) - _chosen(b)).otherwise(0)


def mixed_texts(df: DataFrame, places: DataFrame, id_col: str, text_col: str = "text", block_words: int = 32) -> DataFrame:
    """df's rows as the mix takes them: the whole text repeats times, then the words of its extra blocks as one more text.

    places: mix(df) with the same id_col, or with it as key_col; it must tell rows apart. Nothing is returned for a row that gives no words.
    """
    own = places.select(F.col(id_col).alias("_id"), "size", "at", "repeats", "extra", "n_blocks", "first", "taken").where(F.col("taken") > 0)
    rows = df.select(F.col(id_col).alias("_id"), F.struct(*(F.col(c) for c in df.columns)).alias("_row"))
    text = F.col("_row")[text_col]
    out = rows.join(own, "_id").withColumn("_words", F.when(F.col("taken") > F.col("repeats") * F.col("size"), F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))))
    blocks = F.filter(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)), lambda b: is_extra(b) > 0)
    begin = lambda b: F.greatest(b * block_words - F.col("at"), F.lit(0)).cast("int")
    end = lambda b: F.least((b + 1) * block_words - F.col("at"), F.col("size")).cast("int")
    part = F.array_join(F.flatten(F.transform(blocks, lambda b: F.slice("_words", begin(b) + 1, end(b) - begin(b)))), "")
    texts = F.concat(F.array_repeat(text, F.col("repeats").cast("int")), F.when(F.col("_words").isNotNull(), F.array(part)).otherwise(F.array().cast("array<string>")))
    made = out.select("_row", F.explode(texts).alias("_text"))
    return made.select(*(F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns))
