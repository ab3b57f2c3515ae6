"""Links by name: credits without a reference whose amount, day and merchant's name fit one settlement best by a margin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import band
from ..functions.text import merchant_skeleton, normalize_merchant, score_names, score_spellings
from ..schema import DEFAULTS, Config
from .keyed import near_amount


def merchant_profiles(settlements: DataFrame, credits: DataFrame) -> DataFrame:
    """(merchant_id, spelling): the names that a merchant's credits with its references bear."""
    return settlements.select("merchant_id", "utr").join(credits.where("utr is not null and merchant is not null").select("utr", F.col("merchant").alias("spelling")), "utr").select("merchant_id", "spelling").distinct()


def name_scores(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with score added; only distinct pairs of names are compared."""
    distinct = pairs.select(F.col(left).alias("_a"), F.col(right).alias("_b")).distinct()
    scored = distinct.withColumn("score", score_names(merchant_skeleton(F.col("_a")), merchant_skeleton(F.col("_b")), normalize_merchant(F.col("_a")), normalize_merchant(F.col("_b"))))
    return pairs.join(scored, (F.col(left) == F.col("_a")) & (F.col(right) == F.col("_b"))).drop("_a", "_b")


def ranked_credits(settlements: DataFrame, credits: DataFrame, profiles: DataFrame, config: Config = DEFAULTS, gate: float | None = None) -> DataFrame:
    """(settlement_id, txn_id, score, place): unreferenced credits near a settlement's net and day, by name, best first.

    gate: the least score, name_score where there is none. Names are compared where the pairs are made, so no pair travels
    before it has passed the gate, and of those that only rank, the best of each task.
    """
    bare = credits.where("utr is null and merchant is not null").select("txn_id", "value_date", "credit_minor", "merchant")
    claims = settlements.where("net_minor > 0").select("settlement_id", "merchant_id", "net_minor", "settled_on")
    fits = (F.abs(F.col("credit_minor") - F.col("net_minor")) <= band(F.col("net_minor"), config.band_floor_minor, config.band_bps)) & (F.abs(F.date_diff("value_date", "settled_on")) <= config.name_days)
    read = lambda c: F.struct(merchant_skeleton(F.col(c)).alias("skeleton"), normalize_merchant(F.col(c)).alias("name"))
    spellings = profiles.groupBy("merchant_id").agg(F.collect_set(read("spelling")).alias("spellings"))
    pairs = near_amount(claims.join(spellings, "merchant_id"), bare.withColumn("bears", read("merchant")), "net_minor", "credit_minor", fits, config.name_days)
    scored = pairs.select("settlement_id", "txn_id", "credit_minor", "net_minor", score_spellings("bears.skeleton", "bears.name", "spellings.skeleton", "spellings.name").alias("score"))
    best = scored.where(F.col("score") >= (config.name_score if gate is None else gate))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("settlement_id").orderBy(F.desc("score"), "txn_id")))


def tier3(settlements: DataFrame, credits: DataFrame, profiles: DataFrame, claimants: DataFrame | None = None, references: DataFrame | None = None, config: Config = DEFAULTS) -> DataFrame:
    """(settlement_id, txn_id, tier, p, outcome): the best credit by name, refused as CONTESTED where the runner-up or a
    rival claimant comes within the margin, or INEXACT where it is not the net.

    Every claim is laid before any is decided, so the order of settlements does not matter. claimants may be more
    settlements than those to assign (such as refused ones), which only count as rivals; references, (utr) of credits that
    are no longer open, whose settlements have their credit and are not assigned another.
    """
    every = ranked_credits(claimants if claimants is not None else settlements, credits, profiles, config)
    own = Window.partitionBy("settlement_id")
    on_credit = Window.partitionBy("txn_id").orderBy(F.desc("score"), "settlement_id")
    every = every.withColumns({"second": F.max(F.when(F.col("place") == 2, F.col("score"))).over(own), "claims": F.count("*").over(Window.partitionBy("txn_id")), "rank": F.row_number().over(on_credit)})
    on = Window.partitionBy("txn_id")
    every = every.withColumns({"top": F.max(F.when(F.col("rank") == 1, F.col("score"))).over(on), "next": F.max(F.when(F.col("rank") == 2, F.col("score"))).over(on)})
    best = every.where("place = 1").withColumn("rival", F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("top")))
    close = lambda other: F.coalesce(F.col("score") - F.col(other) < config.name_margin, F.lit(False))
    p = F.when(close("second"), F.col("score") / 2).when(close("rival"), F.col("score") / F.col("claims")).when(F.col("credit_minor") != F.col("net_minor"), F.col("score") / 2).otherwise(F.col("score"))
    outcome = F.when(close("second") | close("rival"), "CONTESTED").when(F.col("credit_minor") != F.col("net_minor"), "INEXACT").otherwise("LINKED")
    used = (credits if references is None else references).where("utr is not null").select("utr").distinct()
    assignable = settlements.join(used, "utr", "left_anti").select("settlement_id")
    return best.join(assignable, "settlement_id", "left_semi").select("settlement_id", "txn_id", F.lit(3).alias("tier"), p.alias("p"), outcome.alias("outcome"))
