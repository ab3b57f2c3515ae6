"""What to do with a candidate link, and what each tier contributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULTS, Config


def decision(p: Column, verified: Column, config: Config = DEFAULTS) -> Column:
    """AUTO_MATCHED if certain and verified, NEEDS_REVIEW if certain but not, or likely, else EXCEPTION."""
    return F.when((p >= config.tau_high) & verified, "AUTO_MATCHED").when((p >= config.tau_high) | (p > config.tau_low), "NEEDS_REVIEW").otherwise("EXCEPTION")


def tier_contributions(candidates: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    matched = (decision(F.col("p"), F.col("verified"), config) == "AUTO_MATCHED").cast("long")
    return candidates.groupBy("tier").agg(F.count("*").alias("proposed"), F.sum(matched).alias("auto_matched"))
