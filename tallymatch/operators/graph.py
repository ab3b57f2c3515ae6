"""Links by their neighbours: completing batches from premises, reachability, and rings of refunds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import allocate
from ..schema import DEFAULTS, Config
from ..sources.shared import shared_folder


def tier4(payments: DataFrame, settlement_links: DataFrame, payment_links: DataFrame, credits: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(payment_id, txn_id, settlement_id, rule, p, share_minor, blocked) of payments without a link in batches with one.

    A batch with exactly one credit takes its missing payments there (PATH_CLOSURE, certain). Else the credit that most of
    the linked payments share takes them, if they are enough (SIBLINGS, with their share as p; the smaller id on ties).
    What a credit has left goes to the first settlement by id; it blocks any other.
    """
    edges = settlement_links.select("settlement_id", "txn_id").distinct()
    direct = edges.groupBy("settlement_id").agg(F.count("*").alias("n"), F.min("txn_id").alias("txn_id")).where("n = 1").select("settlement_id", "txn_id", F.lit("PATH_CLOSURE").alias("rule"), F.lit(1.0).alias("p"))
    linked = payments.join(payment_links.select("payment_id", "txn_id").distinct(), "payment_id")
    votes = linked.groupBy("settlement_id", "txn_id").agg(F.count("*").alias("n"))
    ranked = votes.withColumns({"whole": F.sum("n").over(Window.partitionBy("settlement_id")), "place": F.row_number().over(Window.partitionBy("settlement_id").orderBy(F.desc("n"), "txn_id"))})
    siblings = ranked.where((F.col("place") == 1) & (F.col("n") >= config.sibling_support * F.col("whole"))).select("settlement_id", "txn_id", F.lit("SIBLINGS").alias("rule"), (F.col("n") / F.col("whole")).alias("p"))
    targets = direct.unionAll(siblings.join(direct, "settlement_id", "left_anti"))
    missing = payments.join(payment_links.select("payment_id"), "payment_id", "left_anti")
    absorbed = payment_links.groupBy("txn_id").agg(F.sum("share_minor").alias("absorbed"))
    return _closed(targets, missing, absorbed, credits)


def _closed(targets: DataFrame, missing: DataFrame, absorbed: DataFrame, credits: DataFrame) -> DataFrame:
    """What tier4 says of missing payments (settlement_id, payment_id, amount_minor) and the credit that their batch takes them to."""
    rest = credits.select("txn_id", "credit_minor").join(absorbed, "txn_id", "left").select("txn_id", (F.col("credit_minor") - F.coalesce("absorbed", F.lit(0))).alias("capacity"))
    wanting = targets.join(missing.select("settlement_id").distinct(), "settlement_id", "left_semi").join(rest, "txn_id")
    wanting = wanting.withColumn("turn", F.row_number().over(Window.partitionBy("txn_id").orderBy("settlement_id"))).withColumn("blocked", (F.col("capacity") <= 0) | (F.col("turn") > 1))
    rows = wanting.join(missing.select("settlement_id", "payment_id", "amount_minor"), "settlement_id").withColumn("pot", F.when(F.col("blocked"), 0).otherwise(F.col("capacity")))
    return allocate(rows, ["settlement_id"], "pot", "amount_minor", "payment_id").select("payment_id", "txn_id", "settlement_id", "rule", "p", "share_minor", "blocked")


def path_closure(payments: DataFrame, settlement_links: DataFrame, credits: DataFrame) -> DataFrame:
    """What tier4 has where payments (settlement_id, payment_id, amount_minor, known) themselves say which are linked, each
    with its amount to the one credit of its batch. A batch with no credit, or with several, has no closure.

    Payments are dealt by their batch once, and need not meet links by their ids. known follows from a payment's id. Payments
    of one id are in one batch, and each of them draws on the credit once for every row that the id has.
    """
    edges = settlement_links.select("settlement_id", "txn_id").distinct()
    direct = edges.groupBy("settlement_id").agg(F.count("*").alias("n"), F.min("txn_id").alias("txn_id")).where("n = 1").select("settlement_id", "txn_id", F.lit("PATH_CLOSURE").alias("rule"), F.lit(1.0).alias("p"))
    own = payments.select("settlement_id", "payment_id", "amount_minor", "known")
    each = own.where("known").repartition("settlement_id").groupBy("settlement_id", "payment_id").agg((F.sum("amount_minor") * F.count("*")).alias("share_minor"))
    shares = each.groupBy("settlement_id").agg(F.sum("share_minor").alias("share_minor"))
    absorbed = direct.join(shares, "settlement_id").groupBy("txn_id").agg(F.sum("share_minor").alias("absorbed"))
    return _closed(direct, own.where("not known"), absorbed, credits)


def refund_rings(ledger: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Customers with several refunded orders over several merchants: (customer_ref, events, merchants, refunded_minor)."""
    rings = ledger.where("status = 'REFUNDED'").groupBy("customer_ref").agg(F.count("*").alias("events"), F.countDistinct("merchant_id").alias("merchants"), F.sum("amount_minor").alias("refunded_minor"))
    return rings.where((F.col("events") >= config.ring_events) & (F.col("merchants") >= config.ring_merchants))


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node) for every node that src -> dst edges lead to from a source, itself included; safe on cycles.

    A level of the search is one join; it ends when a level finds nothing new. Levels are checkpointed, so that neither
    the plan nor what a lost executor must redo grows with the depth.
    """
    context = edges.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(edges.sparkSession))
    seen = front = sources.select(F.col("node").alias("source"), "node").distinct().checkpoint()
    while True:
        front = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("source", F.col("dst").alias("node")).distinct().join(seen, ["source", "node"], "left_anti").checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front).checkpoint()
