"""Integer money as column expressions: parsing, formatting, tolerance bands, shares that sum exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def parse_minor(text: Column) -> Column:
    """Digits with an optional sign; underscores and commas between digits are dropped; null for anything else."""
    bare = F.regexp_replace(F.trim(text), "[_,]", "")
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("bigint"))


def parse_major(text: Column) -> Column:
    """Exact decimal text times 100; finer than a hundredth is null, never rounded."""
    bare = F.regexp_replace(F.trim(text), "[_,]", "")
    value = bare.try_cast("decimal(30,8)") * 100
    return F.when(bare.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$") & (value == F.floor(value)), value.try_cast("bigint"))


def format_minor(amount: Column, symbol: str = "₹") -> Column:
    """Sign, symbol, whole units grouped three and then two and two, and the hundredths: -₹12,34,567.00."""
    whole = F.abs(amount).cast(WIDE)
    major = F.floor(whole / 100).cast("string")
    tail, front = F.right(major, F.lit(3)), F.left(major, F.length(major) - 3)
    pairs = F.reverse(F.regexp_replace(F.reverse(front), "([0-9]{2})(?=[0-9])", "$1,"))
    grouped = F.when(F.length(major) <= 3, major).otherwise(F.concat(pairs, F.lit(","), tail))
    return F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), F.lit(symbol), grouped, F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def ceil_bps(amount: Column, bps: int) -> Column:
    """Basis points of a non-negative amount, rounded up in integers."""
    return F.floor((amount.cast(WIDE) * bps + 9_999) / 10_000).cast("bigint")


def band(amount: Column, floor_minor: int, bps: int) -> Column:
    """The larger of a floor and so many basis points of the absolute amount, rounded up."""
    return F.greatest(F.lit(floor_minor).cast("bigint"), ceil_bps(F.abs(amount), bps))


def within(left: Column, right: Column, tolerance: Column) -> Column:
    return F.abs(left - right) <= tolerance


def delta_ratio(delta: Column, base: Column) -> Column:
    """|delta| / |base|; 0 over 0 is 0, anything else over 0 is infinite."""
    return F.when(base != 0, F.abs(delta) / F.abs(base)).when(delta == 0, 0.0).otherwise(F.lit(float("inf")))


def allocate(df: DataFrame, group: list[str], total: str, weight: str, pos: str, share: str = "share_minor") -> DataFrame:
    """df with each row's part of its group's total by weight: whole units by largest remainder, ties by position.

    Parts sum to the total exactly and bear its sign. Where no weight is positive, all parts are 0.
    """
    own = Window.partitionBy(*group)
    whole = F.sum(F.col(weight).cast(WIDE)).over(own)
    product = F.abs(F.col(total)).cast(WIDE) * F.col(weight).cast(WIDE)
    out = df.withColumn("_whole", whole).withColumn("_part", F.when(F.col("_whole") > 0, F.floor(product / F.col("_whole"))).otherwise(0).cast(WIDE))
    out = out.withColumn("_exact", F.col("_part") * F.col("_whole"))
    rest = F.when(F.col("_whole") > 0, product - F.col("_exact")).otherwise(0)
    ranked = own.orderBy(rest.desc(), F.col(pos))
    out = out.withColumns({"_left": F.abs(F.col(total)).cast(WIDE) - F.sum("_part").over(own), "_rank": F.row_number().over(ranked)})
    value = (F.col("_part") + ((F.col("_rank") <= F.col("_left")) & (F.col("_whole") > 0)).cast("int")) * F.signum(F.col(total)).cast("int")
    return out.withColumn(share, value.cast("bigint")).drop("_whole", "_part", "_exact", "_left", "_rank")


def share_of_two(total: Column, part: Column, whole: Column) -> Column:
    """The first of two largest-remainder shares of a total, by weights part and whole - part."""
    product = F.abs(total).cast(WIDE) * part.cast(WIDE)
    low = F.floor(product / whole.cast(WIDE)).cast(WIDE)
    rest = product - low * whole.cast(WIDE)
    other = (whole - part).cast(WIDE) * F.abs(total).cast(WIDE) % whole.cast(WIDE)
    return ((low + ((rest > 0) & (rest >= other)).cast("int")) * F.signum(total).cast("int")).cast("bigint")


def expected_credit(part: Column, whole: Column, net: Column) -> Column:
    """The part of a batch's net that a tranche with so much of its gross should bring."""
    return F.when(whole <= 0, F.lit(0).cast("bigint")).when(part >= whole, net).otherwise(share_of_two(net, part, F.greatest(whole, F.lit(1))))
