"""Aggregation: which payments make up which credit, proved unique by exhaustive search over bounded batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULTS, Config
from .keyed import own_batches


def _sums(amounts: np.ndarray) -> np.ndarray:
    """Sums of all subsets; bit i of a place stands for amount i."""
    out = np.zeros(1, np.int64)
    for a in amounts:
        out = np.concatenate((out, out + a))
    return out


def find_subsets(amounts: list[int], low: int, high: int, want: int = 2, accept=None, config: Config = DEFAULTS) -> tuple[list[int], bool]:
    """Masks of up to want non-empty subsets that sum to low..high and pass accept(sums), and whether the search was exhaustive.

    Two halves meet in the middle: the right half's sums are sorted, and each left sum looks up the range that completes
    it. With too many amounts, the largest that fit are added up instead, which proves nothing.
    """
    n = len(amounts)
    if n > config.subset_most or n - n // 2 > config.half_most:
        mask, total = 0, 0
        for i in sorted(range(n), key=lambda i: (-amounts[i], i)):
            if total + amounts[i] <= high:
                mask, total = mask | 1 << i, total + amounts[i]
        fits = mask and low <= total <= high and (accept is None or accept(np.array([total]))[0])
        return ([mask] if fits else []), False
    half = n // 2
    left, right = _sums(np.array(amounts[:half], np.int64)), _sums(np.array(amounts[half:], np.int64))
    order = np.argsort(right, kind="stable")
    ranked = right[order]
    begin, end = np.searchsorted(ranked, low - left, "left"), np.searchsorted(ranked, high - left, "right")
    found: list[int] = []
    for i in np.flatnonzero(end > begin):
        places = order[begin[i] : end[i]]
        sums = left[i] + right[places]
        keep = np.ones(len(places), bool) if accept is None else accept(sums)
        for j in places[keep]:
            if mask := int(i) | int(j) << half:
                found.append(mask)
                if len(found) >= want:
                    return found, False
    return found, True


def expected(part: np.ndarray, whole: int, net: int) -> np.ndarray:
    """Largest-remainder share of net for a part of whole, element by element."""
    part = np.asarray(part, object)
    low = part * abs(net) // whole
    rest, other = part * abs(net) - low * whole, (whole - part) * abs(net) % whole
    out = (low + ((rest > 0) & (rest >= other))) * (1 if net >= 0 else -1)
    return np.where(part >= whole, net, out).astype(np.int64)


def solve(payments: list[int], credits: list[int], net: int, epsilon: int, config: Config = DEFAULTS) -> tuple[str, list[int]]:
    """(verdict, a mask of payments for each credit that is settled). Credits come largest first; each but the last needs a
    unique subset of what is left, and the last takes the rest, which must bring it within epsilon too. The credit after the
    settled ones is what a refusal is about."""
    gross, left, masks = sum(payments), list(range(len(payments))), []
    if gross <= 0:
        return "FAILED", []
    for at, credit in enumerate(credits):
        amounts = [payments[i] for i in left]
        if at + 1 == len(credits):
            if not left or abs(int(expected([sum(amounts)], gross, net)[0]) - credit) > epsilon:
                return "FAILED", []
            masks.append(sum(1 << i for i in left))
            return "UNIQUE", masks
        if net <= 0:
            return "FAILED", []
        near = max(0, (credit - epsilon - 1) * gross // net - 1), min(gross, (credit + epsilon + 1) * gross // net + 1)
        found, exhaustive = find_subsets(amounts, *near, 2, lambda sums, credit=credit: np.abs(expected(sums, gross, net) - credit) <= epsilon, config)
        if len(found) > 1:
            return "AMBIGUOUS", masks
        if not found:
            return "FAILED", []
        if not exhaustive:
            return "UNPROVEN", masks
        taken = [left[i] for i in range(len(left)) if found[0] >> i & 1]
        masks.append(sum(1 << i for i in taken))
        left = [i for i in left if i not in set(taken)]
    return "FAILED", []


def spread_out(batches: DataFrame) -> DataFrame:
    """Batches dealt to as many tasks as a shuffle has: few bytes, but each a search, which small partitions would join up."""
    return batches.repartition(int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions")), "settlement_id")


def partition_batches(batches: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(settlement_id, verdict, payment_id, txn_id) over batches (settlement_id, net_minor, payments, credits).

    payments and credits are arrays of (id, amount), bounded by a batch; one row per settled payment, or one without
    a payment where there is no unique answer, with the credit that has several (AMBIGUOUS) or is not proved (UNPROVEN).
    """

    def run(frames):
        for frame in frames:
            out = []
            for sid, net, payments, credits in frame.itertuples(index=False):
                payments = sorted(((p["id"], int(p["amount"])) for p in payments))
                credits = sorted(((c["id"], int(c["amount"])) for c in credits), key=lambda c: (-c[1], c[0]))
                verdict, masks = solve([a for _, a in payments], [a for _, a in credits], int(net), config.subset_epsilon_minor, config)
                if verdict == "UNIQUE":
                    out += [(sid, verdict, payments[i][0], credits[k][0]) for k, mask in enumerate(masks) for i in range(len(payments)) if mask >> i & 1]
                else:
                    out.append((sid, verdict, None, None if verdict == "FAILED" else credits[len(masks)][0]))
            yield pd.DataFrame(out, columns=["settlement_id", "verdict", "payment_id", "txn_id"])

    return spread_out(batches).select("settlement_id", "net_minor", "payments", "credits").mapInPandas(run, "settlement_id string, verdict string, payment_id string, txn_id string")


def _of_batch(df: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    return df.groupBy("settlement_id").agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(amount).alias("amount"))).alias(name), F.sum(amount).alias(f"{name}_sum"), F.count("*").alias(f"n_{name}"))


def travelled(settlements: DataFrame, payments: DataFrame) -> DataFrame:
    """(settlement_id, payment_id, amount_minor) of what arrived of the settlements' payments: all but one that a negative
    adjustment has taken out. Shares of a net are of these, as the others are in no credit."""
    return own_batches(settlements, payments).select("settlement_id", "payment_id", "amount_minor")


def tier2(settlements: DataFrame, credits: DataFrame, payments: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """partition_batches of open settlements whose two or more open keyed credits come to their net, give or take epsilon."""
    keyed = settlements.select("settlement_id", "utr", "net_minor").join(credits.where("utr is not null").select("utr", "txn_id", "credit_minor"), "utr")
    sums = keyed.groupBy("settlement_id", "net_minor").agg(F.count("*").alias("n"), F.sum("credit_minor").alias("total"))
    split = sums.where((F.col("n") > 1) & (F.abs(F.col("total") - F.col("net_minor")) <= config.subset_epsilon_minor) & (F.col("net_minor") > 0)).select("settlement_id")
    batches = settlements.join(split, "settlement_id", "left_semi")
    return _partitioned(batches, keyed.join(split, "settlement_id", "left_semi"), travelled(batches, payments), config)


def _partitioned(batches: DataFrame, keyed: DataFrame, own: DataFrame, config: Config) -> DataFrame:
    """partition_batches of batches with their credits and payments. One of more than subset_most payments or credits is not
    gathered nor searched: it is UNPROVEN on its largest credit, by counts alone."""
    few = lambda df: df.groupBy("settlement_id").agg(F.count("*").alias("n")).where(F.col("n") <= config.subset_most).select("settlement_id")
    fit = few(own).join(few(keyed), "settlement_id")
    small = batches.select("settlement_id", "net_minor").join(fit, "settlement_id", "left_semi")
    small = small.join(_of_batch(own.join(fit, "settlement_id", "left_semi"), "payment_id", "amount_minor", "payments"), "settlement_id")
    small = small.join(_of_batch(keyed.join(fit, "settlement_id", "left_semi"), "txn_id", "credit_minor", "credits"), "settlement_id")
    large = own.select("settlement_id").distinct().join(fit, "settlement_id", "left_anti")
    first = keyed.join(large, "settlement_id", "left_semi").groupBy("settlement_id").agg(F.min_by("txn_id", F.struct(-F.col("credit_minor"), "txn_id")).alias("txn_id"))
    return partition_batches(small, config).unionAll(first.select("settlement_id", F.lit("UNPROVEN"), F.lit(None).cast("string"), "txn_id"))


def split_pools(settlements: DataFrame, credits: DataFrame, profiles: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(settlement_id, net_minor, credits) of settlements no credit bears the reference of: the unreferenced credits within
    name_days that bear a spelling of their merchant, two at least and subset_most at most."""
    bare = credits.where("utr is null and merchant is not null").select(F.col("merchant").alias("spelling"), "txn_id", "credit_minor", "value_date")
    keyless = settlements.where("net_minor > 0").join(credits.where("utr is not null").select("utr").distinct(), "utr", "left_anti")
    width = 2 * config.name_days + 1
    number = lambda c: F.unix_date(F.col(c))
    claims = keyless.select("settlement_id", "merchant_id", "net_minor", "settled_on").join(profiles, "merchant_id")
    claims = claims.withColumn("_days", F.explode(F.sequence(F.floor((number("settled_on") - config.name_days) / width), F.floor((number("settled_on") + config.name_days) / width))))
    own = claims.join(bare.withColumn("_days", F.floor(number("value_date") / width)), ["spelling", "_days"]).where((F.abs(F.date_diff("value_date", "settled_on")) <= config.name_days) & (F.col("credit_minor") <= F.col("net_minor")))
    own = own.select("settlement_id", "net_minor", "txn_id", "credit_minor").distinct()
    sizes = own.groupBy("settlement_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, config.subset_most)).select("settlement_id")
    return own.join(sizes, "settlement_id", "left_semi").groupBy("settlement_id", "net_minor").agg(F.collect_list(F.struct(F.col("txn_id").alias("id"), F.col("credit_minor").alias("amount"))).alias("credits"))


def split_completion(settlements: DataFrame, credits: DataFrame, payments: DataFrame, profiles: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """partition_batches of settlements whose credits have lost their reference: the only set of their merchant's credits
    that sums to the net is found first, then the payments are parted over it as in tier 2."""
    sets = tranche_sets(split_pools(settlements, credits, profiles, config), config).where("verdict = 'UNIQUE'").join(credits.select("txn_id", "credit_minor"), "txn_id")
    batches = settlements.join(sets.select("settlement_id").distinct(), "settlement_id", "left_semi")
    return _partitioned(batches, sets.select("settlement_id", "txn_id", "credit_minor"), travelled(batches, payments), config)


def tranche_sets(pools: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(settlement_id, verdict, txn_id) over pools (settlement_id, net_minor, credits): the only set of two or more credits
    that sums to the net exactly, if there is one."""

    def run(frames):
        for frame in frames:
            out = []
            for sid, net, credits in frame.itertuples(index=False):
                credits = sorted((c["id"], int(c["amount"])) for c in credits)
                found, exhaustive = find_subsets([a for _, a in credits], int(net), int(net), 3 + len(credits), None, config)
                found = [m for m in found if m & (m - 1)]
                verdict = "UNIQUE" if exhaustive and len(found) == 1 else "AMBIGUOUS" if len(found) > 1 else "NONE" if exhaustive else "UNPROVEN"
                out += [(sid, verdict, credits[i][0]) for i in range(len(credits)) if verdict == "UNIQUE" and found[0] >> i & 1] or [(sid, verdict, None)]
            yield pd.DataFrame(out, columns=["settlement_id", "verdict", "txn_id"])

    return spread_out(pools).select("settlement_id", "net_minor", "credits").mapInPandas(run, "settlement_id string, verdict string, txn_id string")
