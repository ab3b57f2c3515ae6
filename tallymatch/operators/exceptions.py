"""The queue of what is left: typed by an ordered list of tests, priced, aged and ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import band
from ..schema import DEFAULTS, Config
from ..sources.sinks import stored
from .keyed import bucket, clawbacks, near_amount, settlement_view

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Classes that the documents' own arithmetic says, for certain.
DEDUCED = ("E_FEE_TAX_MISMATCH", "E_DUPLICATE_CREDIT", "E_CHARGEBACK_NETTED", "E_AMBIGUOUS_AGGREGATION", "UNMATCHABLE")
#: Pieces of evidence that a row of the queue shows, the first in order; n_evidence counts all.
SHOWN = 10
ROW = ("ref", "class", "impact_minor", "as_of", "counterpart", "day_gap", "n_evidence", "evidence", "hypotheses")


def severity(impact: Column, age_days: Column, config: Config = DEFAULTS) -> Column:
    """By impact, and one level up, to the highest at most, from escalate_days on."""
    critical, high, medium = config.severe_minor
    level = F.when(impact >= critical, 3).when(impact >= high, 2).when(impact >= medium, 1).otherwise(0)
    return F.get(F.array(*map(F.lit, LEVELS)), F.least(F.lit(3), level + (age_days >= config.escalate_days).cast("int")))


def settlement_class(config: Config = DEFAULTS) -> Column:
    """The first that holds for a residual settlement with the facts that residual_settlements adds."""
    return (
        F.when(F.col("ambiguous") & (F.size("hypotheses") >= 2), "E_AMBIGUOUS_AGGREGATION")
        .when(F.col("ambiguous"), "E_UNKNOWN_RESIDUAL")
        .when(F.col("net_delta") != 0, "E_FEE_TAX_MISMATCH")
        .when(F.col("clawback") == "NETTED_PAYMENT", "E_CHARGEBACK_NETTED")
        .when(F.col("clawback").isNotNull(), "E_POST_SETTLEMENT_REFUND")
        .when(F.col("n_keyed") > 1, "E_SPLIT_PAYOUT_INCOMPLETE")
        .when((F.col("n_keyed") == 1) & (F.col("keyed_minor") < F.col("net_minor")), "E_POST_SETTLEMENT_REFUND")
        .when((F.col("n_keyed") == 1) & (F.abs(F.col("keyed_gap")) > config.band_days), "E_TIMING_SHIFT")
        .when(F.col("n_keyed") == 1, "E_UNKNOWN_RESIDUAL")
        .when((F.col("n_near") > 0) & ~F.col("in_time"), "E_TIMING_SHIFT")
        .when(F.col("n_near") > 0, "E_MISSING_REFERENCE")
        .otherwise("E_LATE_ARRIVAL")
    )


def piece(kind: str, ref: Column, amount: Column) -> Column:
    """One piece of evidence."""
    return F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), amount.cast("bigint").alias("amount_minor"))


def first_pieces(df: DataFrame, key: str, order: list, made: Column, name: str) -> DataFrame:
    """(key, name, name_n): of each key the first SHOWN pieces in order, by rank and not as a free list, and how many there are."""
    ranked = df.withColumns({"_rank": F.row_number().over(Window.partitionBy(key).orderBy(*order)), "_n": F.count("*").over(Window.partitionBy(key))}).where(F.col("_rank") <= SHOWN)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", made.alias("piece")))), lambda x: x["piece"]).alias(name), F.max("_n").alias(f"{name}_n"))


def near_counts(left: DataFrame, low: Column, high: Column, amounts: DataFrame, name: str = "n_near") -> DataFrame:
    """left with how many of amounts (amount_minor) are in low..high, without a pair of rows.

    Amounts and bounds are counted by value first. In each bucket of amounts one sort puts both together, and a running sum
    says how many amounts a bound has below it; whole buckets between two bounds add their totals.
    """
    ends = left.withColumns({"_low": low.cast("bigint") - 1, "_high": high.cast("bigint")})
    counted = amounts.groupBy(F.col("amount_minor").alias("x")).agg(F.count("*").alias("n"))
    points = ends.select(F.explode(F.array("_low", "_high")).alias("x")).distinct().withColumn("n", F.lit(0).cast("bigint"))
    spot = lambda c: bucket(F.greatest(F.col(c), F.lit(0)))
    both = counted.unionAll(points).groupBy("x").agg(F.sum("n").alias("n")).withColumn("b", spot("x"))
    upto = both.withColumn("upto", F.sum("n").over(Window.partitionBy("b").orderBy("x"))).select("x", "upto")
    totals = both.groupBy("b").agg(F.sum("n").alias("total"))
    spans = ends.select("_low", "_high").distinct().withColumn("b", F.explode(F.filter(F.sequence(spot("_low"), spot("_high")), lambda b: b < spot("_high"))))
    between = spans.join(totals, "b").groupBy("_low", "_high").agg(F.sum("total").alias("_between"))
    out = ends.join(upto.select(F.col("x").alias("_low"), F.col("upto").alias("_before")), "_low").join(upto.select(F.col("x").alias("_high"), F.col("upto").alias("_upto")), "_high").join(between, ["_low", "_high"], "left")
    return out.withColumn(name, F.coalesce("_between", F.lit(0)) + F.col("_upto") - F.col("_before")).drop("_low", "_high", "_before", "_upto", "_between")


def rulings(links: DataFrame) -> DataFrame:
    """(settlement_id, txn_id, p): what a run has said of settlements and credits, once each."""
    return links.groupBy("settlement_id", "txn_id").agg(F.max("p").alias("p"))


def residual_settlements(settlements: DataFrame, payments: DataFrame, credits: DataFrame, links: DataFrame, config: Config = DEFAULTS, taken: DataFrame | None = None) -> DataFrame:
    """Rows of settlements that links (a run's) do not settle, and of settled ones whose net does not add up.

    Facts are of what no certain link has claimed: credits with the reference, and others of about the net's amount.
    Evidence in order: the net, what is missing, the payment taken out, keyed credits by day, what the run said.
    Hypotheses are the run's links by p where tier 2 found several sets; one alone is no competition, and then nothing is known.
    taken: the settlements' clawbacks, where they are at hand.
    """
    sure = links.where("decision = 'AUTO_MATCHED'")
    view = settlement_view(settlements, payments).join(sure.select("settlement_id").distinct().withColumn("credited", F.lit(True)), "settlement_id", "left").withColumn("credited", F.coalesce("credited", F.lit(False)))
    open_ = view.where("not credited or net_delta != 0")
    free = credits.where("credit_minor > 0").join(sure.select("txn_id").distinct(), "txn_id", "left_anti")
    wanting = open_.where("not credited")
    keyed = wanting.select("settlement_id", "utr", "settled_on").join(free.select("utr", "txn_id", "credit_minor", "value_date"), "utr")
    first = F.min(F.struct("value_date", "txn_id"))
    sums = keyed.groupBy("settlement_id").agg(F.count("*").alias("n_keyed"), F.sum("credit_minor").alias("keyed_minor"), F.date_diff(first["value_date"], F.min("settled_on")).alias("keyed_gap"), first["txn_id"].alias("keyed_id"))
    pieces = first_pieces(keyed, "settlement_id", ["value_date", "txn_id"], piece("EXACT_KEY", F.concat(F.lit("bank:"), "txn_id"), F.col("credit_minor")), "keyed")
    width = band(F.col("net_minor"), config.band_floor_minor, config.band_bps)
    near = near_counts(wanting.select("settlement_id", "net_minor"), F.col("net_minor") - width, F.col("net_minor") + width, free.select(F.col("credit_minor").alias("amount_minor"))).select("settlement_id", "n_near")
    fits = (F.abs(F.col("credit_minor") - F.col("net_minor")) <= width) & (F.abs(F.date_diff("value_date", "settled_on")) <= config.band_days)
    timely = near_amount(wanting.select("settlement_id", "net_minor", "settled_on"), free.select("credit_minor", "value_date").distinct(), "net_minor", "credit_minor", fits, config.band_days, how="left_semi").select("settlement_id", F.lit(True).alias("in_time")).distinct()
    said = rulings(links)
    spoken = first_pieces(said, "settlement_id", [F.desc("p"), "txn_id"], piece("RULING", F.concat(F.lit("bank:"), "txn_id"), F.round(F.col("p") * 1_000_000)), "said")
    doubtful = links.where("outcome = 'AMBIGUOUS'").select("settlement_id").distinct()
    rival = first_pieces(said.join(doubtful, "settlement_id", "left_semi"), "settlement_id", [F.desc("p"), "txn_id"], F.struct("p", "txn_id"), "hypotheses").drop("hypotheses_n")
    taken = (taken or clawbacks(settlements, payments)).select("settlement_id", F.col("kind").alias("clawback"), "excluded_payment_id", F.col("amount_minor").alias("owed"))
    facts = open_
    for more in (sums, pieces, near, timely, spoken, rival, doubtful.withColumn("ambiguous", F.lit(True)), taken):
        facts = facts.join(more, "settlement_id", "left")
    facts = facts.fillna({"n_keyed": 0, "n_near": 0, "in_time": False, "ambiguous": False, "keyed_n": 0, "said_n": 0})
    none = F.array().cast("array<struct<kind:string,ref:string,amount_minor:bigint>>")
    own = F.concat(F.lit("settlement:"), "settlement_id")
    excluded = F.col("excluded_payment_id").isNotNull()
    chain = F.concat(
        F.array(piece("ARITHMETIC_CHECK", own, F.col("net_minor")), piece("NEGATIVE_EVIDENCE", own, F.col("n_keyed") + F.col("n_near"))),
        F.when(excluded, F.array(piece("ARITHMETIC_CHECK", F.concat(F.lit("payment:"), "excluded_payment_id"), F.col("owed")))).otherwise(none), F.coalesce("keyed", none), F.coalesce("said", none),
    )
    kind = settlement_class(config)
    impact = F.when(kind == "E_FEE_TAX_MISMATCH", F.abs("net_delta")).otherwise(F.abs("net_minor"))
    counterpart = F.when(kind == "E_CHARGEBACK_NETTED", F.col("excluded_payment_id")).otherwise(F.col("keyed_id"))
    return facts.select(own.alias("ref"), kind.alias("class"), impact.alias("impact_minor"), F.col("settled_on").alias("as_of"), counterpart.alias("counterpart"), F.col("keyed_gap").alias("day_gap"), (2 + excluded.cast("int") + F.col("keyed_n") + F.col("said_n")).cast("bigint").alias("n_evidence"), F.slice(chain, 1, SHOWN).alias("evidence"), "hypotheses")


def _none_to_weigh() -> Column:
    return F.lit(None).cast("array<struct<p:double,txn_id:string>>").alias("hypotheses")


def residual_credits(credits: DataFrame, settlements: DataFrame, links: DataFrame, reposted: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows of credits that no certain link claims.

    Re-posted ones first; then those whose reference names a settlement, by whether others bear it too and one of them has
    the amount; then strange references; then by whether the merchant's name is on file. Evidence in order: itself, its
    narration, what it is a re-posting of, its twins, the settlements that its reference names, what the run said.
    """
    paid = credits.where("credit_minor > 0")
    sure = links.where("decision = 'AUTO_MATCHED'").select("txn_id").distinct()
    open_ = paid.join(sure, "txn_id", "left_anti")
    bearers = paid.where("utr is not null")
    counts = bearers.groupBy("utr").agg(F.count("*").alias("bearers"))
    alike = bearers.groupBy("utr", "credit_minor").agg(F.count("*").alias("alike"))
    named = settlements.where("utr is not null").groupBy("utr").agg(F.count("*").alias("named"))
    # a reference has as many twins for each bearer as it has bearers, so they are ranked once for the reference
    first = first_pieces(bearers, "utr", ["value_date", "txn_id"], piece("EXACT_KEY", F.concat(F.lit("bank:"), "txn_id"), F.col("credit_minor")), "twins").drop("twins_n")
    owners = first_pieces(settlements.where("utr is not null"), "utr", ["settlement_id"], piece("EXACT_KEY", F.concat(F.lit("settlement:"), "settlement_id"), F.col("net_minor")), "owners").drop("owners_n")
    originals = reposted.select("txn_id", "original_id").join(paid.select(F.col("txn_id").alias("original_id"), F.col("value_date").alias("first_day")), "original_id")
    spoken = first_pieces(rulings(links), "txn_id", [F.desc("p"), "settlement_id"], piece("RULING", F.concat(F.lit("settlement:"), "settlement_id"), F.round(F.col("p") * 1_000_000)), "said")
    out = open_.join(originals, "txn_id", "left").join(spoken, "txn_id", "left").join(alike, ["utr", "credit_minor"], "left")
    for more in (counts, named, first, owners):
        out = out.join(more, "utr", "left")
    out = out.join(profiles.select(F.col("spelling").alias("merchant"), F.lit(True).alias("on_file")).distinct(), "merchant", "left").fillna({"bearers": 1, "named": 0, "said_n": 0, "alike": 1})
    kind = (
        F.when(F.col("original_id").isNotNull(), "E_DUPLICATE_CREDIT")
        .when((F.col("named") > 0) & (F.col("alike") > 1), "E_DUPLICATE_CREDIT")
        .when((F.col("named") > 0) & (F.col("bearers") > 1), "E_SPLIT_PAYOUT_INCOMPLETE")
        .when(F.col("named") > 0, "E_UNKNOWN_RESIDUAL")
        .when(F.col("utr").isNotNull(), "E_ORPHAN_BANK_CREDIT")
        .when(F.col("on_file"), "E_MISSING_REFERENCE")
        .when(F.col("merchant").isNull(), "UNMATCHABLE")
        .otherwise("E_ORPHAN_BANK_CREDIT")
    )
    own, none = F.concat(F.lit("bank:"), "txn_id"), F.array().cast("array<struct<kind:string,ref:string,amount_minor:bigint>>")
    again = F.col("original_id").isNotNull()
    others = F.filter(F.coalesce("twins", none), lambda x: x["ref"] != own)
    chain = F.concat(
        F.array(piece("AMOUNT_MATCH", own, F.col("credit_minor")), piece("NEGATIVE_EVIDENCE", F.coalesce("utr", F.lit("")), F.lit(None))),
        F.when(again, F.array(piece("EXACT_KEY", F.concat(F.lit("bank:"), "original_id"), F.col("credit_minor")))).otherwise(none), others, F.coalesce("owners", none), F.coalesce("said", none),
    )
    n = 2 + again.cast("int") + F.col("bearers") - 1 + F.col("named") + F.col("said_n")
    counterpart = F.coalesce("original_id", F.substring(F.get(others, 0)["ref"], 6, 1_000), F.substring(F.get("owners", 0)["ref"], 12, 1_000))
    gap = F.when(again, F.date_diff("value_date", "first_day")).when(kind == "E_SPLIT_PAYOUT_INCOMPLETE", 0)
    return out.select(own.alias("ref"), kind.alias("class"), F.col("credit_minor").alias("impact_minor"), F.col("value_date").alias("as_of"), counterpart.alias("counterpart"), gap.alias("day_gap"), n.cast("bigint").alias("n_evidence"), F.slice(chain, 1, SHOWN).alias("evidence"), _none_to_weigh())


def residual_payments(settlements: DataFrame, payments: DataFrame, links: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Rows of payments without a certain link in settlements that have one: taken out by an adjustment of just their amount,
    or not accounted for. Payments meet the links first, as few are left to meet their settlement then."""
    sure = links.where("decision = 'AUTO_MATCHED'")
    credited = settlements.join(sure.select("settlement_id").distinct(), "settlement_id", "left_semi")
    rest = payments.select("payment_id", "settlement_id", "amount_minor").join(sure.select("payment_id"), "payment_id", "left_anti").join(credited.select("settlement_id", "settled_on"), "settlement_id")
    taken = taken.join(credited.select("settlement_id"), "settlement_id", "left_semi") if taken else clawbacks(credited, payments)
    taken = taken.where("excluded_payment_id is not null").select(F.col("excluded_payment_id").alias("payment_id"), F.lit(True).alias("taken"))
    out = rest.join(taken, "payment_id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    own, batch = F.concat(F.lit("payment:"), "payment_id"), F.concat(F.lit("settlement:"), "settlement_id")
    missing = piece("NEGATIVE_EVIDENCE", own, F.col("amount_minor"))
    chain = F.when(F.col("taken"), F.array(missing, piece("ARITHMETIC_CHECK", batch, F.col("amount_minor")))).otherwise(F.array(missing))
    kind = F.when(F.col("taken"), "E_CHARGEBACK_NETTED").otherwise("E_UNKNOWN_RESIDUAL")
    return out.select(own.alias("ref"), kind.alias("class"), F.col("amount_minor").alias("impact_minor"), F.col("settled_on").alias("as_of"), F.col("settlement_id").alias("counterpart"), F.lit(None).cast("int").alias("day_gap"), F.size(chain).cast("bigint").alias("n_evidence"), chain.alias("evidence"), _none_to_weigh())


def external_refunds(settlements: DataFrame, payments: DataFrame, ledger: DataFrame, links: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Rows of refunds taken out of a batch that did not pay the order: of every settlement, settled or not, whose negative
    adjustment is no payment of its own and has the amount of orders refunded, paid out by that day in another batch.

    One such order is the row's subject; where several have the amount, it names none, and the settlement is. Evidence in
    order: the adjustment, the orders, and the batches that paid them, where the run has credited those. Orders of an amount
    that nothing owes are dropped first, and then the payments of other orders.
    """
    owed = (taken or clawbacks(settlements, payments)).where("kind = 'EXTERNAL'").select("settlement_id", "amount_minor").join(settlements.select("settlement_id", "settled_on"), "settlement_id")
    refunded = ledger.where("status = 'REFUNDED'").select("order_id", "amount_minor").join(owed.select("amount_minor").distinct(), "amount_minor", "left_semi")
    paid = payments.where("order_ref is not null").select(F.col("order_ref").alias("order_id"), "settlement_id").join(refunded.select("order_id"), "order_id", "left_semi")
    paid = paid.groupBy("order_id").agg(F.max("settlement_id").alias("origin")).join(settlements.select(F.col("settlement_id").alias("origin"), F.col("settled_on").alias("paid_on")), "origin")
    refunded = refunded.join(paid, "order_id")
    sure = links.where("decision = 'AUTO_MATCHED'").select(F.col("settlement_id").alias("origin")).distinct().withColumn("credited", F.lit(True))
    # a settlement's hits are made in one task, by its amount: they are counted and ranked there, and only its first travel
    hits = owed.join(refunded.join(sure, "origin", "left"), "amount_minor").where("origin != settlement_id and paid_on <= settled_on")
    order = F.concat(F.lit("order:"), "order_id")
    counts = hits.groupBy("settlement_id").agg(F.count("*").alias("orders_n"), F.count("credited").alias("batches_n"))
    orders = first_pieces(hits, "settlement_id", ["order_id"], piece("AMOUNT_MATCH", order, F.col("amount_minor")), "orders").drop("orders_n").join(counts, "settlement_id")
    batches = first_pieces(hits.where("credited"), "settlement_id", ["order_id"], piece("EXACT_KEY", F.concat(F.lit("settlement:"), "origin"), F.col("amount_minor")), "batches").drop("batches_n")
    out = owed.join(orders, "settlement_id").join(batches, "settlement_id", "left")
    own, none = F.concat(F.lit("settlement:"), "settlement_id"), F.array().cast("array<struct<kind:string,ref:string,amount_minor:bigint>>")
    chain = F.concat(F.array(piece("ARITHMETIC_CHECK", own, -F.col("amount_minor"))), "orders", F.coalesce("batches", none))
    one = F.col("orders_n") == 1
    origin = F.substring(F.get("batches", 0)["ref"], 12, 1_000)
    return out.select(F.when(one, F.get("orders", 0)["ref"]).otherwise(own).alias("ref"), F.lit("E_POST_SETTLEMENT_REFUND").alias("class"), "amount_minor", F.col("settled_on").alias("as_of"), F.coalesce(origin, "settlement_id").alias("counterpart"), F.lit(None).cast("int").alias("day_gap"), (1 + F.col("orders_n") + F.col("batches_n")).cast("bigint").alias("n_evidence"), F.slice(chain, 1, SHOWN).alias("evidence"), _none_to_weigh()).withColumnRenamed("amount_minor", "impact_minor")


def exception_queue(rows: DataFrame, latest: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """rows with age, severity, confidence and whether a bounded rule may settle them. latest: one row (latest), the data's
    last day, so that ages don't depend on today."""
    age = F.greatest(F.lit(0), F.date_diff(F.col("latest"), "as_of"))
    confidence = F.when(F.col("class") == "E_UNKNOWN_RESIDUAL", 0.30).when(F.col("class").isin(*DEDUCED), 1.0).when(F.col("n_evidence") >= 3, 0.90).otherwise(0.75)
    day = latest.first()["latest"]
    out = rows.withColumn("latest", F.lit(day)).withColumn("age_days", age).drop("latest")
    return out.withColumns({"severity": severity(F.col("impact_minor"), F.col("age_days"), config), "confidence": confidence, "resolvable": F.col("class").isin("E_ROUNDING_DRIFT", "E_TIMING_SHIFT", "E_DUPLICATE_CREDIT")})


def classify_exceptions(settlements: DataFrame, payments: DataFrame, credits: DataFrame, ledger: DataFrame, links: DataFrame, reposted: DataFrame, profiles: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """The whole queue of a run: settlements, credits, payments and external refunds. payments has order_ref."""
    taken = stored(clawbacks(settlements, payments), "clawbacks")
    rows = residual_settlements(settlements, payments, credits, links, config, taken).unionByName(residual_credits(credits, settlements, links, reposted, profiles))
    rows = rows.unionByName(residual_payments(settlements, payments, links, taken)).unionByName(external_refunds(settlements, payments, ledger, links, taken))
    days = credits.select("value_date").unionAll(settlements.select("settled_on")).agg(F.max("value_date").alias("latest"))
    return exception_queue(rows, days, config)


def queue_order(rows: DataFrame) -> DataFrame:
    """The queue as it is read: by money, then by ref. A sort by ranges, so no task has all of it."""
    return rows.orderBy(F.desc("impact_minor"), "ref")


def resolve_bounded(queue: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(ref, class, rule, amount_minor, applied, refusal) of the rows that a bounded rule is for, in queue order as to money.

    Rounding: small drifts that the run's budget still pays for, passing over what it does not; timing: a keyed credit at
    most timing_days away; duplicates are flagged and linked, never deleted.
    """
    wanted = queue.where(F.col("class").isin("E_ROUNDING_DRIFT", "E_TIMING_SHIFT", "E_DUPLICATE_CREDIT"))
    drifts = rounding_budget(wanted.where("class = 'E_ROUNDING_DRIFT'").select("ref", "impact_minor"), config).select("ref", F.col("applied").alias("_paid"))
    out = wanted.join(drifts, "ref", "left")
    rounding, timing = F.col("class") == "E_ROUNDING_DRIFT", F.col("class") == "E_TIMING_SHIFT"
    gap = F.abs("day_gap")
    refusal = (
        F.when(rounding & (F.col("impact_minor") > config.rounding_each_minor), "OVER_RECORD_BOUND")
        .when(rounding & ~F.col("_paid"), "OVER_RUN_BUDGET")
        .when(timing & gap.isNull(), "NO_DAY_GAP")
        .when(timing & (gap > config.timing_days), "OVER_DAYS")
    )
    rule = F.when(rounding, "ROUNDING_ADJUSTMENT").when(timing, "REWINDOW_AND_REMATCH").otherwise("FLAG_AND_LINK")
    return out.select("ref", "class", rule.alias("rule"), F.when(timing, 0).otherwise(F.col("impact_minor")).alias("amount_minor"), refusal.isNull().alias("applied"), refusal.alias("refusal"))


def mark_resolvable(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The queue with resolvable true for just what a bounded rule has taken."""
    done = resolutions.where("applied").select("ref", F.lit(True).alias("_done"))
    return queue.join(done, "ref", "left").withColumn("resolvable", F.coalesce("_done", F.lit(False))).drop("_done")


def rounding_budget(rows: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(ref, impact_minor, applied): small drifts, largest first, that one run's budget pays for.

    A drift over what is left is passed over, and a later smaller one may fit, which no window can say. Drifts are whole
    minor units of at most rounding_each_minor, so their counts by amount, that many rows, settle how many of each amount
    are paid; which ones, their order within the amount says.
    """
    small = rows.where((F.col("impact_minor") > 0) & (F.col("impact_minor") <= config.rounding_each_minor))
    left, paid = config.rounding_run_minor, {}
    for r in sorted(small.groupBy("impact_minor").count().collect(), key=lambda r: -r.impact_minor):
        paid[r.impact_minor] = min(r["count"], left // r.impact_minor)
        left -= paid[r.impact_minor] * r.impact_minor
    place = F.row_number().over(Window.partitionBy("impact_minor").orderBy("ref"))
    quota = F.element_at(F.create_map(*(F.lit(x) for pair in paid.items() for x in pair)), F.col("impact_minor")) if paid else F.lit(0)
    return rows.join(small.select("ref", (place <= quota).alias("_paid")), "ref", "left").select("ref", "impact_minor", F.coalesce("_paid", F.lit(False)).alias("applied"))
