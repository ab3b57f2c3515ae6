"""Re-postings: credits of one amount and narration on different days within a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULTS


def duplicate_postings(credits: DataFrame, days: int = DEFAULTS.duplicate_days, key: str = "narration") -> DataFrame:
    """Re-posted credits (txn_id, original_id): of groups alike in amount and key with no day twice and a short span, all
    but the earliest by (date, id). Any other group is left whole. A hot key costs its own aggregate, not a sort."""
    groups = credits.groupBy("credit_minor", key).agg(
        F.count("*").alias("n"), F.countDistinct("value_date").alias("n_days"), F.date_diff(F.max("value_date"), F.min("value_date")).alias("span"), F.min(F.struct("value_date", "txn_id")).alias("first")
    )
    kept = groups.where((F.col("n") > 1) & (F.col("n") == F.col("n_days")) & (F.col("span") <= days)).select("credit_minor", key, F.col("first.txn_id").alias("original_id"))
    return credits.join(kept, ["credit_minor", key]).where("txn_id != original_id").select("txn_id", "original_id")
