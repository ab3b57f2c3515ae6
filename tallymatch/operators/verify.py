"""Whether any proposed set of payments can be a credit, by the sources' own figures, and if not, why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import expected_credit
from ..schema import DEFAULTS, Config


def verify_proposals(proposals: DataFrame, payments: DataFrame, settlements: DataFrame, bank: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """One row per proposal: proposal_id, txn_id, settlement_id (that all its payments are of), n_payments, gross_minor,
    expected_minor, credit_minor, residual_minor, verified, and the first check that fails as reason (VERIFIED if none does).

    proposals: (proposal_id, txn_id, settlement_id, payment_id), a row per payment; one that names none has a row without.
    The settlement that a proposal names counts for nothing but a refusal: its payments' own nesting says where they are.
    payments: what the sources nest, whose sum a settlement's net is shared by. Rows are dealt by proposal once, for
    both its payments and its sums, and joined on ids, so a proposal of any number of payments costs its rows.
    """
    nested = payments.select("payment_id", F.col("settlement_id").alias("_nested"), "amount_minor")
    rows = proposals.join(nested, "payment_id", "left").select("proposal_id", "payment_id", "txn_id", "settlement_id", "_nested", "amount_minor")
    named = F.col("payment_id").isNotNull()
    each = rows.repartition("proposal_id").groupBy("proposal_id", "payment_id").agg(
        F.min("txn_id").alias("txn_id"), F.max("settlement_id").alias("_named"), F.count("payment_id").alias("_n"), F.count_if(named & F.col("_nested").isNull()).alias("_unknown"), F.min("_nested").alias("_least"), F.max("_nested").alias("_most"), F.sum("amount_minor").alias("_gross")
    )
    sums = each.groupBy("proposal_id").agg(
        F.min("txn_id").alias("txn_id"),
        F.max("_named").alias("_named"),
        F.sum("_n").alias("n_payments"),
        (F.sum("_n") != F.count("payment_id")).alias("_repeated"),
        F.sum("_unknown").alias("_unknown"),
        F.min("_least").alias("_least"),
        F.max("_most").alias("_most"),
        F.sum("_gross").alias("_gross"),
    )
    whole = payments.groupBy(F.col("settlement_id").alias("_least")).agg(F.sum("amount_minor").alias("_whole"))
    nets = settlements.select(F.col("settlement_id").alias("_least"), "net_minor")
    out = sums.join(bank.select("txn_id", "credit_minor"), "txn_id", "left").join(whole, "_least", "left").join(nets, "_least", "left")
    expected = expected_credit(F.col("_gross"), F.col("_whole"), F.col("net_minor"))
    reason = (
        F.when(F.col("credit_minor").isNull(), "NO_SUCH_CREDIT")
        .when(F.col("credit_minor") <= 0, "OUTGOING")
        .when(F.col("n_payments") == 0, "NO_PAYMENTS")
        .when(F.col("_repeated"), "REPEATED_PAYMENT")
        .when(F.col("_unknown") > 0, "UNKNOWN_PAYMENT")
        .when(F.col("_least") != F.col("_most"), "SEVERAL_SETTLEMENTS")
        .when(F.col("_named") != F.col("_least"), "OTHER_SETTLEMENT")
        .when(F.col("net_minor").isNull(), "UNKNOWN_SETTLEMENT")
        .when(F.abs(expected - F.col("credit_minor")) > config.subset_epsilon_minor, "DOES_NOT_ADD_UP")
        .otherwise("VERIFIED")
    )
    out = out.withColumn("reason", reason)
    weighed = F.col("reason").isin("DOES_NOT_ADD_UP", "VERIFIED")
    anchored = weighed | F.col("reason").isin("OTHER_SETTLEMENT", "UNKNOWN_SETTLEMENT")
    only = lambda x, when=weighed: F.when(when, x)
    return out.select(
        "proposal_id", "txn_id", only(F.col("_least"), anchored).alias("settlement_id"), "n_payments", only(F.col("_gross")).alias("gross_minor"), only(expected).alias("expected_minor"),
        only(F.col("credit_minor")).alias("credit_minor"), only(F.col("credit_minor") - expected).alias("residual_minor"), (F.col("reason") == "VERIFIED").alias("verified"), "reason",
    )
