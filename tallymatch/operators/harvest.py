"""Contenders: the links that the residual tiers weighed, the losing ones too, with their features, to be labelled and fitted on."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import allocate, band, delta_ratio
from ..schema import DEFAULTS, Config
from .keyed import own_batches
from .lexical import ranked_credits
from .subset import expected, find_subsets, spread_out, travelled

KEY = ["payment_id", "txn_id", "tier"]
FEATURES = "amount_delta_minor bigint, tolerance_band_minor bigint, amount_delta_ratio double, date_delta_days int, lexical_score double, graph_support double, subset_size int"
CONTENDERS = f"settlement_id string, payment_id string, txn_id string, tier int, rank int, share_minor bigint, verified boolean, {FEATURES}"


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*(x.split()[0] for x in CONTENDERS.split(", ")))


def aggregation_contenders(settlements: DataFrame, credits: DataFrame, payments: DataFrame, top_k: int = 3, config: Config = DEFAULTS) -> DataFrame:
    """Tier 2's contenders before it takes anything: for each open settlement of two or more keyed open credits, and each of
    these, up to top_k sets of its payments that could be the credit; a row per payment of a set.

    Sets are of the whole batch, not of what earlier tranches leave, so a set that explains another tranche is there too.
    rank is a set's place in the search. A batch of more than subset_most payments is not searched and has none.
    """
    keyed = settlements.where("net_minor > 0").select("settlement_id", "utr").join(credits.where("utr is not null").select("utr", "txn_id", "credit_minor", "value_date"), "utr").drop("utr")
    several = keyed.groupBy("settlement_id").agg(F.count("*").alias("n")).where("n > 1").select("settlement_id")
    open_ = settlements.join(several, "settlement_id", "left_semi")
    own = travelled(open_, payments)
    gross = own.groupBy("settlement_id").agg(F.sum("amount_minor").alias("gross")).where("gross > 0")
    few = own.groupBy("settlement_id").agg(F.count("*").alias("n")).where(F.col("n") <= config.subset_most).select("settlement_id")
    gathered = own.join(few, "settlement_id", "left_semi").groupBy("settlement_id").agg(F.sort_array(F.collect_list(F.struct("payment_id", "amount_minor"))).alias("payments"))
    points = keyed.join(open_.select("settlement_id", "net_minor", "settled_on"), "settlement_id").join(gross, "settlement_id").join(gathered, "settlement_id")
    epsilon = config.subset_epsilon_minor

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sid, txn, credit, net, whole, own in frame.itertuples(index=False):
                amounts = [int(p["amount_minor"]) for p in own]
                near = max(0, (credit - epsilon - 1) * whole // net - 1), min(whole, (credit + epsilon + 1) * whole // net + 1)
                found, _ = find_subsets(amounts, *near, top_k, lambda sums: np.abs(expected(sums, whole, net) - credit) <= epsilon, config)  # noqa: B023
                for rank, mask in enumerate(found):
                    members = [i for i in range(len(own)) if mask >> i & 1]
                    part = sum(amounts[i] for i in members)
                    delta = int(credit) - int(expected([part], whole, net)[0])
                    out += [(sid, txn, rank, own[i]["payment_id"], amounts[i], len(members), delta) for i in members]
            yield pd.DataFrame(out, columns=["settlement_id", "txn_id", "rank", "payment_id", "amount_minor", "subset_size", "amount_delta_minor"])

    schema = "settlement_id string, txn_id string, rank int, payment_id string, amount_minor bigint, subset_size int, amount_delta_minor bigint"
    sets = spread_out(points).select("settlement_id", "txn_id", "credit_minor", "net_minor", "gross", "payments").mapInPandas(run, schema)
    rows = sets.join(points.select("settlement_id", "txn_id", "credit_minor", F.date_diff("value_date", "settled_on").alias("date_delta_days")), ["settlement_id", "txn_id"])
    rows = allocate(rows, ["settlement_id", "txn_id", "rank"], "credit_minor", "amount_minor", "payment_id")
    return _columns(
        rows.withColumns(
            {"tier": F.lit(2), "verified": F.lit(True), "tolerance_band_minor": F.lit(epsilon).cast("bigint"), "amount_delta_ratio": delta_ratio(F.col("amount_delta_minor"), F.col("credit_minor")), "lexical_score": F.lit(0.0), "graph_support": F.lit(0.0)}
        )
    )


def lexical_contenders(settlements: DataFrame, credits: DataFrame, payments: DataFrame, profiles: DataFrame, top_k: int = 3, config: Config = DEFAULTS) -> DataFrame:
    """Tier 3's contenders before it takes anything: for each open settlement the top_k credits near its net and day by name,
    however low their score; a row per payment that travelled. The credits that the tier's gate turns away are what a
    wrong link looks like."""
    best = ranked_credits(settlements, credits, profiles, config, gate=0.0).where(F.col("place") <= top_k)
    own = own_batches(settlements, payments).select("settlement_id", "payment_id", "amount_minor", F.col("reconciles").alias("verified"))
    dated = best.join(settlements.select("settlement_id", "settled_on"), "settlement_id").join(credits.select("txn_id", "value_date"), "txn_id")
    rows = dated.join(own, "settlement_id")
    rows = allocate(rows, ["settlement_id", "txn_id"], "credit_minor", "amount_minor", "payment_id")
    delta = F.col("credit_minor") - F.col("net_minor")
    return _columns(
        rows.withColumns(
            {
                "tier": F.lit(3), "rank": (F.col("place") - 1).cast("int"), "amount_delta_minor": delta, "tolerance_band_minor": band(F.col("net_minor"), config.band_floor_minor, config.band_bps),
                "amount_delta_ratio": delta_ratio(delta, F.col("net_minor")), "date_delta_days": F.date_diff("value_date", "settled_on"), "lexical_score": F.col("score"), "graph_support": F.lit(0.0), "subset_size": F.lit(0),
            }
        )
    )


def graph_contenders(inferred: DataFrame) -> DataFrame:
    """Tier 4's, which has no runners-up: what it inferred, at rank 0, with its support."""
    zero = {"amount_delta_minor": F.lit(0).cast("bigint"), "tolerance_band_minor": F.lit(0).cast("bigint"), "amount_delta_ratio": F.lit(0.0), "date_delta_days": F.lit(0), "lexical_score": F.lit(0.0), "graph_support": F.col("p"), "subset_size": F.lit(0)}
    return _columns(inferred.withColumns({"tier": F.lit(4), "rank": F.lit(0), "verified": F.lit(True), **zero}))


def labelled(contenders: list[DataFrame], links: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per (payment_id, txn_id, tier) with positive, accepted and asserted.

    A link seen in several turns counts once, at its best rank. positive: truth (payment_id, txn_id) has it; truth labels
    and selects nothing. accepted: the tier settled that settlement, as links, the run's own rows, say, and not its gates
    once more. asserted: this link is among what it settled it by.
    """
    rows = reduce(DataFrame.unionByName, contenders).repartition(*KEY[:2])  # as truth and the run's links come to them
    rest = [c for c in rows.columns if c not in KEY]
    once = rows.groupBy(*KEY).agg(F.min(F.struct("rank", *(c for c in rest if c != "rank"))).alias("x")).select(*KEY, *(F.col(f"x.{c}").alias(c) for c in rest))
    sure = links.where("outcome = 'LINKED' and verified and tier >= 2")
    marks = truth.select(*KEY[:2], F.lit(True).alias("positive"), F.lit(None).cast("int").alias("tier")).unionAll(sure.select(*KEY[:2], F.lit(None).cast("boolean"), "tier"))
    marks = marks.groupBy(*KEY[:2]).agg(F.max("positive").alias("positive"), F.collect_set("tier").alias("_by"))
    out = once.join(marks, KEY[:2], "left").withColumn("asserted", F.array_contains("_by", F.col("tier"))).drop("_by")
    out = out.join(sure.select("settlement_id", "tier").distinct().withColumn("accepted", F.lit(True)), ["settlement_id", "tier"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    marked = {"positive": yes("positive"), "accepted": yes("accepted"), "asserted": yes("accepted") & yes("asserted")}
    return out.select(*KEY, "settlement_id", *(c for c in rest if c != "settlement_id"), *(x.alias(c) for c, x in marked.items()))


def harvest_summary(rows: DataFrame) -> DataFrame:
    """(tier, rows, positives, fit_rows, fit_positives, asserted, points, resolved_points) by tier. A point is a decision: a
    settlement's credit in tier 2, a settlement in tier 3, a link in tier 4."""
    point = F.when(F.col("tier") == 2, F.concat_ws("\0", "settlement_id", "txn_id")).when(F.col("tier") == 3, F.col("settlement_id")).otherwise(F.concat_ws("\0", "payment_id", "txn_id"))
    return rows.withColumn("_point", point).groupBy("tier").agg(
        F.count("*").alias("rows"), F.count_if("positive").alias("positives"), F.count_if("accepted").alias("fit_rows"), F.count_if(F.col("accepted") & F.col("positive")).alias("fit_positives"),
        F.count_if("asserted").alias("asserted"), F.countDistinct("_point").alias("points"), F.countDistinct(F.when(F.col("accepted"), F.col("_point"))).alias("resolved_points"),
    )


def top_contenders(rows: DataFrame, k: int = 3) -> DataFrame:
    """rows with place, the k best of each payment over all its credits and tiers by (rank, tier, txn_id)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("payment_id").orderBy("rank", "tier", "txn_id"))).where(F.col("place") <= k)
