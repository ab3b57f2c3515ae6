"""The whole run: each tier sees what the tiers before it left."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import allocate
from ..operators.duplicates import duplicate_postings
from ..operators.graph import tier4
from ..operators.harvest import aggregation_contenders, graph_contenders, labelled, lexical_contenders
from ..operators.keyed import spread, spread_batches, tier0, tier1
from ..operators.lexical import merchant_profiles, tier3
from ..operators.policy import decision
from ..operators.subset import split_completion, tier2, travelled
from ..operators.verify import verify_proposals
from ..schema import DEFAULTS, Config
from ..sources.sinks import stored

#: Called before a tier takes from the pools: tier, open settlements, open credits, the settlements' payments.
Watch = Callable[[int, DataFrame, DataFrame, DataFrame], None]
LINKS = "settlement_id string, txn_id string, tier int, p double, outcome string"


def harvest(settlements: DataFrame, payments: DataFrame, bank: DataFrame, truth: DataFrame, config: Config = DEFAULTS, top_k: int = 3) -> DataFrame:
    """Labelled contenders of tiers 2, 3 and 4 of one run, read off the pools before each tier takes from them.

    The run itself is reconcile's; nothing here decides or takes anything.
    """
    links, found = watched_run(settlements, payments, bank, config, top_k)
    return labelled(found, links, truth)


def watched_run(settlements: DataFrame, payments: DataFrame, bank: DataFrame, config: Config = DEFAULTS, top_k: int = 3) -> tuple[DataFrame, list[DataFrame]]:
    """A run's links, and the contenders that its residual tiers weighed."""
    credits = bank.where("credit_minor > 0")
    profiles = stored(merchant_profiles(settlements, credits), "profiles")
    found: list[DataFrame] = []

    def watch(tier: int, open_: DataFrame, pool: DataFrame, own: DataFrame) -> None:
        made = aggregation_contenders(open_, pool, own, top_k, config) if tier == 2 else lexical_contenders(open_, pool, own, profiles, top_k, config)
        found.append(stored(made, "contenders"))

    links = stored(reconcile(settlements, payments, bank, config, watch=watch), "run")
    return links, [*found, graph_contenders(links.where("tier = 4"))]


def verified_shares(rows: DataFrame, settlements: DataFrame, payments: DataFrame, credits: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """rows (payment_id, txn_id, settlement_id) with verified: whether the payments that travel in a credit are all of that
    settlement, once each, and come to it, give or take epsilon, by the sources' own figures."""
    key = F.concat_ws("\0", "settlement_id", "txn_id")
    checks = verify_proposals(rows.select(key.alias("proposal_id"), "txn_id", "settlement_id", "payment_id"), payments, settlements, credits, config)
    return rows.withColumn("proposal_id", key).join(checks.select("proposal_id", "verified"), "proposal_id").drop("proposal_id")


def without(rows: DataFrame, taken: list[DataFrame], key: str) -> DataFrame:
    """rows whose key is in none of the tables of what is taken."""
    return reduce(lambda out, t: out.join(t.select(key), key, "left_anti"), taken, rows)


def reconcile(settlements: DataFrame, payments: DataFrame, bank: DataFrame, config: Config = DEFAULTS, tiers: tuple[int, ...] = (0, 1, 2, 3, 4), watch: Watch | None = None) -> DataFrame:
    """Payment links (payment_id, txn_id, settlement_id, tier, p, outcome, share_minor, verified, decision) of all tiers.

    bank has utr and merchant read from its narrations. A refusal takes its settlement out of the pool, stays in the result
    with its share of the certainty and counts as a rival claimant; a settlement is matched once, by the first tier that
    can. tiers: those that take part.

    What the keyed tiers leave is written once; its payments are written with the keyed links' shares, in one pass. A link by key or name takes all that travelled of its batch,
    so tier 4 is asked of what is left only: of batches that splits have settled in part. After that a turn of tiers 2, 3 and 4 writes its own links and nothing
    else: pools are what was left, less the tables of what has been taken since. The first turn looks at all that is open,
    a later one only at what the last has freed. A taken credit can change the answer only for settlements that have it
    among their keyed credits: tier 3 refuses or links every settlement that any open credit fits, and a smaller pool
    gives the others none. So the next turn has the open settlements that share a reference with a taken credit, and
    the loop ends where there are none, residual_passes at the latest. Splits without a reference are completed last.
    """
    none = settlements.sparkSession.createDataFrame([], LINKS)
    credits = stored(bank.where("credit_minor > 0"), "credits")
    reposted = duplicate_postings(credits, config.duplicate_days)
    pool = stored(credits.join(reposted.select("txn_id"), "txn_id", "left_anti"), "pool")
    linked = lambda links: links.where("outcome = 'LINKED'")
    keyed = [none, none]
    if 0 in tiers:
        keyed[0] = stored(tier0(settlements, pool), "links")
    if 1 in tiers:
        keyed[1] = stored(tier1(without(settlements, keyed[:1], "settlement_id"), without(pool, [linked(keyed[0])], "txn_id"), config), "links")
    refused = reduce(DataFrame.unionAll, [k.where("outcome != 'LINKED'").select("settlement_id").distinct() for k in keyed]).distinct().withColumn("refused", F.lit(True))
    left = stored(without(settlements, [linked(k) for k in keyed], "settlement_id").join(refused, "settlement_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False))), "left")
    pool = stored(without(pool, [linked(k) for k in keyed], "txn_id"), "pool")
    dealt = stored(spread_batches(reduce(DataFrame.unionAll, keyed), payments, credits, settlements), "batches", "open")
    own = dealt.where("open").select("settlement_id", "payment_id", "amount_minor")
    profiles = stored(merchant_profiles(settlements, credits), "profiles")

    gone: list[DataFrame] = []  # settlements settled or refused since
    settled: list[DataFrame] = []
    taken: list[DataFrame] = []  # credits
    parts: list[DataFrame] = []
    open_ = left.where("not refused").drop("refused")
    opened = lambda rows: without(rows, gone, "settlement_id")

    def part(batches: DataFrame, refuse: bool = True) -> None:
        """Takes what a partition settles, and what it refuses if it may, out of the pools."""
        found = stored(batches.where("txn_id is not null" if refuse else "verdict = 'UNIQUE'"), "parts")
        unique = found.where("verdict = 'UNIQUE'")
        gone.append(found.select("settlement_id").distinct())
        settled.append(unique.select("settlement_id").distinct())
        taken.append(unique.select("txn_id").distinct())
        keyed.append(found.where("verdict != 'UNIQUE'").select("settlement_id", "txn_id", F.lit(2).alias("tier"), F.lit(0.5).alias("p"), F.col("verdict").alias("outcome")))
        parts.append(unique.select("payment_id", "txn_id", "settlement_id"))

    def shares(links: list[DataFrame], split: list[DataFrame]) -> DataFrame:
        rows = spread(reduce(DataFrame.unionByName, [k.select(none.columns) for k in links], none), own, credits, left)
        rows = rows.withColumn("verified", F.col("verified") & ((F.col("tier") < 2) | (F.col("outcome") == "LINKED")))  # a refusal of theirs proves nothing
        if split:
            whole = reduce(DataFrame.unionAll, split)
            covered = travelled(left.join(whole.select("settlement_id").distinct(), "settlement_id", "left_semi"), own)
            tranches = whole.join(covered.select("payment_id", "amount_minor"), "payment_id").join(credits.select("txn_id", "credit_minor"), "txn_id")
            tranches = verified_shares(allocate(tranches, ["settlement_id", "txn_id"], "credit_minor", "amount_minor", "payment_id"), left, covered, credits, config)
            rows = rows.unionAll(tranches.select("payment_id", "txn_id", "settlement_id", F.lit(2).alias("tier"), F.lit(1.0).alias("p"), F.lit("LINKED").alias("outcome"), "share_minor", "verified"))
        return rows

    fresh, done = open_, (len(keyed), 0)
    result = [dealt.where("txn_id is not null").drop("amount_minor", "open")]
    for _ in range(config.residual_passes if {2, 3, 4} & set(tiers) else 0):
        before = len(taken)
        if 2 in tiers:
            if watch:
                watch(2, opened(fresh), without(pool, taken, "txn_id"), own)
            part(tier2(opened(fresh), without(pool, taken, "txn_id"), own, config))
        if 3 in tiers:
            if watch:
                watch(3, opened(fresh), without(pool, taken, "txn_id"), own)
            keyed.append(stored(tier3(opened(fresh), without(pool, taken, "txn_id"), profiles, without(left, settled, "settlement_id").drop("refused"), credits, config), "links"))
            gone.append(keyed[-1].select("settlement_id").distinct())
            settled.append(linked(keyed[-1]).select("settlement_id").distinct())
            taken.append(linked(keyed[-1]).select("txn_id").distinct())
        rows = stored(shares(keyed[done[0] :], parts[done[1] :]), "rows")
        turn = [*result, rows] if done == (2, 0) else [rows]
        done = len(keyed), len(parts)
        result.append(rows)
        if 4 in tiers:
            certain = lambda rows: rows.where(F.col("verified") & (F.col("p") >= config.tau_high))
            premises = certain(rows)
            covered = travelled(left.join(premises.select("settlement_id"), "settlement_id", "left_semi"), own)
            wanting = stored(covered.join(premises.select("payment_id"), "payment_id", "left_anti").select("settlement_id").distinct(), "wanting")
            if not wanting.isEmpty():
                premises = premises.join(wanting, "settlement_id", "left_semi")
                drawn = reduce(DataFrame.unionAll, [certain(r) for r in turn]).join(premises.select("txn_id"), "txn_id", "left_semi")
                inferred = tier4(covered.join(wanting, "settlement_id", "left_semi"), premises.select("settlement_id", "txn_id"), drawn, credits, config).where("not blocked")
                result.append(inferred.select("payment_id", "txn_id", "settlement_id", F.lit(4).alias("tier"), "p", F.lit("LINKED").alias("outcome"), "share_minor", F.lit(True).alias("verified")))
        new = [t.join(pool.where("utr is not null").select("txn_id", "utr"), "txn_id").select("utr") for t in taken[before:]]
        if not new:
            break
        fresh = opened(open_).join(reduce(DataFrame.unionAll, new).distinct(), "utr", "left_semi").select(open_.columns)
        if fresh.isEmpty():
            break
    if {2, 3} <= set(tiers):
        part(split_completion(opened(open_), without(pool, taken, "txn_id"), own, profiles, config), refuse=False)
    if len(keyed) > done[0] or len(parts) > done[1]:
        result.append(shares(keyed[done[0] :], parts[done[1] :]))
    return reduce(DataFrame.unionAll, result).withColumn("decision", decision(F.col("p"), F.col("verified"), config))
