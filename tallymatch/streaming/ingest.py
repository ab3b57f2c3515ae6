"""The order leg as a stream: payments that arrive in files meet the ledger that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import order_leg

PAYMENTS = "payment_id string, settlement_id string, order_ref string, amount_minor bigint, captured_at timestamp"


def payment_stream(spark: SparkSession, folder: str, days: int = 7) -> DataFrame:
    """Parquet files of payments as they come; an id counts once within so many days."""
    return spark.readStream.schema(PAYMENTS).parquet(folder).withWatermark("captured_at", f"{days} days").dropDuplicatesWithinWatermark(["payment_id"])


def run_order_leg(payments: DataFrame, ledger: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Provisional: refusals need a closed statement, so only the order leg runs on a stream. Ends with what is there."""
    return order_leg(payments, ledger).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
