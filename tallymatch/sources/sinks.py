"""Where results go: a run's tables, its log of events, and the running balance of a statement."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, so that later tiers neither redo it nor lose it; by: columns of few values that
    have a folder each."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_balance(bank: DataFrame, opening_minor: int) -> DataFrame:
    """bank with balance_minor after each row by (value_date, txn_id).

    Rows are dealt to ranges of that order, so that a busy day is parted like any other, and written with their range's
    number. Ranges sum first; only one row per range passes through the window over all ranges, and rows only through
    their own range's.
    """
    move = F.col("credit_minor") - F.col("debit_minor")
    ranges = int(bank.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(bank.repartitionByRange(ranges, "value_date", "txn_id").withColumn("_range", F.spark_partition_id()), "ranged")
    sums = rows.groupBy("_range").agg(F.sum(move).alias("moved"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    opened = sums.select("_range", (F.lit(opening_minor) + F.coalesce(F.sum("moved").over(before), F.lit(0))).alias("_opened"))
    upto = Window.partitionBy("_range").orderBy("value_date", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(opened), "_range").withColumn("balance_minor", (F.col("_opened") + F.sum(move).over(upto)).cast("bigint")).drop("_opened", "_range")


def save_run(folder: str, run_id: str, **tables: DataFrame) -> None:
    """Each table of a run as Parquet under folder/run_id; a reader sees a table only when it is whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{run_id}/{name}")


def load_run(spark: SparkSession, folder: str, run_id: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{run_id}/{name}") for name in names}


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, modified) of the runs saved in a folder, the newest first; none where the folder is not there."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", "modificationTime")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "run_id string, modified timestamp")
    run = F.element_at(F.split("path", "/"), -3)
    return files.groupBy(run.alias("run_id")).agg(F.max("modificationTime").alias("modified")).orderBy(F.desc("modified"), "run_id")


def audit_events(decisions: DataFrame, run_id: str) -> DataFrame:
    """One event per decision (run_id, node, event_type, refs, payload); text for a JSON-lines sink is to_json of it."""
    refs = F.array(F.concat(F.lit("payment:"), "payment_id"), F.concat(F.lit("bank:"), "txn_id"))
    return decisions.select(F.lit(run_id).alias("run_id"), F.concat(F.lit("tier"), "tier").alias("node"), F.col("decision").alias("event_type"), refs.alias("refs"), F.to_json(F.struct("p", "share_minor", "outcome")).alias("payload"))
