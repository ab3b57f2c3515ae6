"""Links by key: the order leg, and the bank leg by reference within a tolerance, refusing wherever two answers fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import allocate, band
from ..schema import DEFAULTS, Config


def order_leg(payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per payment: its order and outcome LINKED, or why not: NO_REFERENCE, UNKNOWN_REFERENCE, AMOUNT_DIFFERS."""
    orders = ledger.select(F.col("order_id").alias("order_ref"), F.col("amount_minor").alias("order_minor"), "status", "customer_ref")
    out = payments.join(orders, "order_ref", "left")
    outcome = F.when(F.col("order_ref").isNull(), "NO_REFERENCE").when(F.col("order_minor").isNull(), "UNKNOWN_REFERENCE").when(F.col("order_minor") != F.col("amount_minor"), "AMOUNT_DIFFERS").otherwise("LINKED")
    return out.withColumn("outcome", outcome)


def settlement_view(settlements: DataFrame, payments: DataFrame) -> DataFrame:
    """Settlements with what their payments come to: n_payments, payments_minor, expected_net, net_delta, gross_reconciles."""
    sums = payments.groupBy("settlement_id").agg(F.count("*").alias("n_payments"), F.sum("amount_minor").alias("payments_minor"))
    out = settlements.join(sums, "settlement_id", "left").fillna({"n_payments": 0, "payments_minor": 0})
    expected = F.col("gross_minor") - F.col("fee_minor") - F.col("tax_minor") + F.col("adjustments_minor")
    return out.withColumns({"expected_net": expected, "net_delta": F.col("net_minor") - expected, "gross_reconciles": (F.col("n_payments") > 0) & (F.col("payments_minor") == F.col("gross_minor"))})


def clawbacks(settlements: DataFrame, payments: DataFrame) -> DataFrame:
    """Settlements with a negative adjustment: the one nested payment of that amount, or external, or not attributable."""
    owed = settlements.where("adjustments_minor < 0").select("settlement_id", (-F.col("adjustments_minor")).alias("amount_minor"))
    hits = owed.join(payments.select("settlement_id", "amount_minor", "payment_id"), ["settlement_id", "amount_minor"], "left")
    out = hits.groupBy("settlement_id", "amount_minor").agg(F.count("payment_id").alias("n_matches"), F.min("payment_id").alias("first_id"))
    kind = F.when(F.col("n_matches") == 1, "NETTED_PAYMENT").when(F.col("n_matches") == 0, "EXTERNAL").otherwise("AMBIGUOUS")
    return out.select("settlement_id", "amount_minor", "n_matches", kind.alias("kind"), F.when(F.col("n_matches") == 1, F.col("first_id")).alias("excluded_payment_id"))


def covered_payments(payments: DataFrame, attributed: DataFrame) -> DataFrame:
    """Payments without those that a claw-back has taken out of their own batch."""
    return payments.join(attributed.where("excluded_payment_id is not null").select(F.col("excluded_payment_id").alias("payment_id")), "payment_id", "left_anti")


def bucket(amount: Column) -> Column:
    """A number such that amounts within half a per cent or a hundred of each other are at most two apart."""
    small = F.lit(20_000)
    return F.when(amount < small, F.floor(amount / 100)).otherwise(200 + F.floor(F.log(F.greatest(amount, small) / small) / F.log(F.lit(1.005)))).cast("long")


def near_amount(left: DataFrame, right: DataFrame, amount: str, other: str, keep: Column, days: int | None = None, day: str = "settled_on", other_day: str = "value_date", how: str = "inner") -> DataFrame:
    """Pairs of rows whose amounts are close, by an equi-join on buckets and then the exact condition keep.

    Close is half a per cent of left's amount or a hundred. Where keep also has a limit of days, that is part of the key: a
    bucket is as many days wide as the limit reaches. how: inner, or left_semi for the rows of left alone that have a pair,
    each as often as in so many of its buckets, without making the pairs.
    """
    reach = F.greatest(F.lit(100), F.ceil(F.abs(F.col(amount)) / 200) + 1)
    probes = left.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(amount) - reach), bucket(F.col(amount) + reach))))
    built, on = right.withColumn("_spot", bucket(F.col(other))), F.col("_bucket") == F.col("_spot")
    if days is not None:
        number, width = lambda c: F.unix_date(F.col(c)), 2 * days + 1
        probes = probes.withColumn("_days", F.explode(F.sequence(F.floor((number(day) - days) / width), F.floor((number(day) + days) / width))))
        built, on = built.withColumn("_span", F.floor(number(other_day) / width)), on & (F.col("_days") == F.col("_span"))
    return probes.join(built, on & keep, how).drop("_bucket", "_days", "_spot", "_span")


def bank_leg(settlements: DataFrame, credits: DataFrame, tier: int, *, floor_minor: int = 0, bps: int = 0, days: int | None = None) -> DataFrame:
    """(settlement_id, txn_id, tier, p, outcome) for open settlements and credits; outcome LINKED, COLLISION or RIVALS.

    A reference that several settlements bear refuses all of them. Else the credits with a settlement's reference that fit
    its net (and day) qualify. It is left alone where none does, where one of several keyed ones does (a split), or where
    an open credit makes up exactly what the only one lacks. Credits without a reference that fit as well are rivals: with
    any, or with several that qualify, each gets a share of the certainty and the settlement is refused.
    """
    tolerance = band(F.col("net_minor"), floor_minor, bps) if floor_minor or bps else F.lit(0).cast("bigint")
    fits = F.abs(F.col("credit_minor") - F.col("net_minor")) <= F.col("tolerance")
    if days is not None:
        fits &= F.abs(F.date_diff("value_date", "settled_on")) <= days
    rows = settlements.where("utr is not null").select("settlement_id", "utr", "net_minor", "settled_on").withColumn("tolerance", tolerance)
    rows = rows.withColumn("peers", F.count("*").over(Window.partitionBy("utr")))
    keyed = rows.join(credits.select("utr", "txn_id", "value_date", "credit_minor"), "utr").withColumn("fits", fits)
    own = Window.partitionBy("settlement_id")
    keyed = keyed.withColumns({"n_keyed": F.count("*").over(own), "n_fit": F.sum(F.col("fits").cast("int")).over(own)}).where("fits")
    colliding = keyed.where("peers > 1").select("settlement_id", "txn_id", (1.0 / F.col("peers")).alias("p"), F.lit("COLLISION").alias("outcome"))
    clear = keyed.where("peers = 1 and not (n_keyed > 1 and n_fit <= 1)")
    short = clear.where("n_fit = 1 and net_minor > credit_minor").select("settlement_id", "txn_id", (F.col("net_minor") - F.col("credit_minor")).alias("credit_minor"))
    made_up = short.join(credits.select("credit_minor", F.col("txn_id").alias("_other")), "credit_minor").where("_other != txn_id").select("settlement_id").distinct()
    clear = clear.join(made_up, "settlement_id", "left_anti")
    bare = credits.where("utr is null").select(F.col("txn_id").alias("rival_id"), "value_date", "credit_minor")
    targets = clear.select("settlement_id", "net_minor", "settled_on", "tolerance").distinct()
    rivals = near_amount(targets, bare, "net_minor", "credit_minor", fits, days) if floor_minor or bps else targets.join(bare, F.col("credit_minor") == F.col("net_minor")).where(fits)
    counts = rivals.groupBy("settlement_id").agg(F.count("*").alias("n_rivals"))
    out = clear.join(counts, "settlement_id", "left").withColumn("field", F.col("n_fit") + F.coalesce("n_rivals", F.lit(0)))
    linked = out.select("settlement_id", "txn_id", (1.0 / F.col("field")).alias("p"), F.when(F.col("field") == 1, "LINKED").otherwise("RIVALS").alias("outcome"))
    return colliding.unionAll(linked).select("settlement_id", "txn_id", F.lit(tier).alias("tier"), "p", "outcome")


def tier0(settlements: DataFrame, credits: DataFrame) -> DataFrame:
    return bank_leg(settlements, credits, 0)


def tier1(settlements: DataFrame, credits: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    return bank_leg(settlements, credits, 1, floor_minor=config.band_floor_minor, bps=config.band_bps, days=config.band_days)


def own_batches(settlements: DataFrame, payments: DataFrame) -> DataFrame:
    """(settlement_id, payment_id, amount_minor, reconciles, doubtful) of the settlements' payments, without the one that a
    negative adjustment has taken out. reconciles: all payments come to the gross; doubtful: several have the amount taken out.

    Payments meet their settlement once, and all else is said of its rows where they are.
    """
    figures = settlements.groupBy("settlement_id").agg(F.min("gross_minor").alias("gross_minor"), F.min("adjustments_minor").alias("adjustments_minor"))
    rows = payments.select("settlement_id", "payment_id", "amount_minor").join(figures, "settlement_id")
    own, owed = Window.partitionBy("settlement_id"), F.coalesce((F.col("adjustments_minor") < 0) & (F.col("amount_minor") == -F.col("adjustments_minor")), F.lit(False))
    rows = rows.withColumns({"_paid": F.sum("amount_minor").over(own), "_owed": owed}).withColumn("_hits", F.sum(F.col("_owed").cast("int")).over(own))
    kept = rows.where(~(F.col("_owed") & (F.col("_hits") == 1)))
    return kept.select("settlement_id", "payment_id", "amount_minor", (F.col("_paid") == F.col("gross_minor")).alias("reconciles"), (F.col("_hits") > 1).alias("doubtful"))


def spread_batches(links: DataFrame, payments: DataFrame, credits: DataFrame, settlements: DataFrame) -> DataFrame:
    """What spread says of links, and in the same pass over the payments what they leave: rows with open and amount_minor.

    links settle or refuse a settlement as one. A row without a txn_id is a payment that no link has; open rows, one of each
    payment of a settlement that is not LINKED, bear its amount, the others what spread has.
    """
    paid = links.join(credits.select("txn_id", "credit_minor"), "txn_id").withColumn("_first", F.row_number().over(Window.partitionBy("settlement_id").orderBy("txn_id")) == 1)
    figures = settlements.groupBy("settlement_id").agg(F.min("gross_minor").alias("gross_minor"), F.min("adjustments_minor").alias("adjustments_minor")).join(paid, "settlement_id", "left")
    own, owed = Window.partitionBy("settlement_id", "txn_id"), F.coalesce((F.col("adjustments_minor") < 0) & (F.col("amount_minor") == -F.col("adjustments_minor")), F.lit(False))
    rows = payments.select("settlement_id", "payment_id", "amount_minor").join(figures, "settlement_id")
    rows = rows.withColumns({"_paid": F.sum("amount_minor").over(own), "_owed": owed}).withColumn("_hits", F.sum(F.col("_owed").cast("int")).over(own))
    out = F.col("_owed") & (F.col("_hits") == 1)
    rows = allocate(rows.withColumn("_weight", F.when(out, 0).otherwise(F.col("amount_minor"))), ["settlement_id", "txn_id"], "credit_minor", "_weight", "payment_id")
    open_ = F.coalesce(F.col("outcome") != "LINKED", F.lit(True)) & F.coalesce("_first", F.lit(True))
    travels = F.col("txn_id").isNotNull() & ~out
    names = {"txn_id": F.when(travels, F.col("txn_id")), "share_minor": F.when(travels, F.col("share_minor")), "verified": (F.col("_paid") == F.col("gross_minor")) & ~(F.col("_hits") > 1)}
    rows = rows.withColumns(names | {"open": open_, "amount_minor": F.when(open_, F.col("amount_minor"))}).where("open or txn_id is not null")
    return rows.select("payment_id", "txn_id", "settlement_id", "tier", "p", "outcome", "share_minor", "verified", "amount_minor", "open")


def spread(links: DataFrame, payments: DataFrame, credits: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settlement links as payment links, each with its share of the credit; verified where the gross reconciles."""
    paid = links.join(credits.select("txn_id", "credit_minor"), "txn_id")
    linked = settlements.select("settlement_id", "gross_minor", "adjustments_minor").join(links.select("settlement_id"), "settlement_id", "left_semi")
    rows = paid.join(own_batches(linked, payments), "settlement_id")
    rows = allocate(rows, ["settlement_id", "txn_id"], "credit_minor", "amount_minor", "payment_id")
    return rows.select("payment_id", "txn_id", "settlement_id", "tier", "p", "outcome", "share_minor", (F.col("reconciles") & ~F.col("doubtful")).alias("verified"))
