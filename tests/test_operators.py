import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallymatch.operators import calibration, duplicates, exceptions, graph, keyed, metrics, subset
from tallymatch.plans.queries import ORACLES, QUERIES
from tallymatch.sources import readers
from tallymatch.sources.sinks import running_balance

DAY = dt.date(2026, 3, 10)
SETTLEMENT = "settlement_id string, utr string, net_minor bigint, settled_on date"
CREDIT = "txn_id string, utr string, value_date date, credit_minor bigint"


def leg(spark, settlements, credits, tier=keyed.tier1):
    days = lambda rows, i: [(*r[:i], DAY + dt.timedelta(r[i]), *r[i + 1 :]) for r in rows]
    out = tier(spark.createDataFrame(days(settlements, 3), SETTLEMENT), spark.createDataFrame(days(credits, 2), CREDIT))
    return {(r.settlement_id, r.txn_id): (r.outcome, round(r.p, 3)) for r in out.collect()}


def test_exact_and_tolerance(spark):
    assert leg(spark, [("s", "u", 100_000, 0)], [("b", "u", 1, 100_000)], keyed.tier0) == {("s", "b"): ("LINKED", 1.0)}
    assert leg(spark, [("s", "u", 100_000, 0)], [("b", "u", 1, 100_400)], keyed.tier0) == {}
    assert leg(spark, [("s", "u", 100_000, 0)], [("b", "u", 3, 100_500)]) == {("s", "b"): ("LINKED", 1.0)}
    assert leg(spark, [("s", "u", 100_000, 0)], [("b", "u", 4, 100_000)]) == {}


def test_refusals(spark):
    assert leg(spark, [("s", "u", 100_000, 0), ("t", "u", 100_000, 0)], [("b", "u", 1, 100_000)]) == {("s", "b"): ("COLLISION", 0.5), ("t", "b"): ("COLLISION", 0.5)}
    assert leg(spark, [("s", "u", 100_000, 0)], [("b", "u", 1, 100_000), ("c", None, 1, 100_100)]) == {("s", "b"): ("RIVALS", 0.5)}
    assert leg(spark, [("s", "u", 100_000, 0)], [("b", "u", 1, 100_000), ("c", "u", 1, 60_000)]) == {}
    assert leg(spark, [("s", "u", 100_000, 0)], [("b", "u", 1, 99_700), ("c", "v", 1, 300)]) == {}


def test_near_amount_has_every_pair(spark):
    rng = random.Random(1)
    amounts = [rng.choice([rng.randint(1, 300), rng.randint(19_000, 21_000), rng.randint(10**6, 10**6 + 20_000)]) for _ in range(120)]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(amounts)], "i int, x bigint")
    b = a.select(F.col("i").alias("j"), F.col("x").alias("y"))
    got = {(r.i, r.j) for r in keyed.near_amount(a, b, "x", "y", F.abs(F.col("x") - F.col("y")) <= F.greatest(F.lit(100), F.ceil(F.col("x") * 50 / 10_000))).collect()}
    assert got == {(i, j) for i, x in enumerate(amounts) for j, y in enumerate(amounts) if abs(x - y) <= max(100, -(-x * 50 // 10_000))}


def test_duplicates(spark):
    rows = [("a", 0, 5, "n"), ("b", 1, 5, "n"), ("c", 0, 6, "n"), ("d", 0, 6, "n"), ("e", 0, 7, "n"), ("f", 9, 7, "n")]
    bank = spark.createDataFrame([(i, DAY + dt.timedelta(d), a, n) for i, d, a, n in rows], "txn_id string, value_date date, credit_minor bigint, narration string")
    assert [tuple(r) for r in duplicates.duplicate_postings(bank).collect()] == [("b", "a")]


def test_find_subsets_against_all_masks():
    rng = random.Random(7)
    for _ in range(60):
        amounts = [rng.randint(1, 40) for _ in range(rng.randint(0, 11))]
        low = rng.randint(0, 120)
        high = low + rng.randint(0, 4)
        every = [m for m in range(1, 1 << len(amounts)) if low <= sum(a for i, a in enumerate(amounts) if m >> i & 1) <= high]
        found, exhaustive = subset.find_subsets(amounts, low, high, want=10**6)
        assert exhaustive and sorted(found) == every
    assert subset.find_subsets([1] * 41, 5, 5)[1] is False


def test_solve():
    assert subset.solve([600, 400], [600, 400], 1000, 3)[0] == "UNIQUE"
    assert subset.solve([500, 500, 7], [500, 507], 1007, 3) == ("AMBIGUOUS", [])
    assert subset.solve([600, 400], [700, 300], 1000, 3) == ("FAILED", [])
    verdict, masks = subset.solve([100_000, 250_000, 470_000], [460_600, 245_000, 98_000], 803_600, 300)
    assert verdict == "UNIQUE" and masks == [4, 2, 1]


def test_tranche_sets(spark):
    pools = spark.createDataFrame([("s", 10, [("a", 4), ("b", 6), ("c", 9)]), ("t", 10, [("a", 4), ("b", 6), ("c", 6)])], "settlement_id string, net_minor bigint, credits array<struct<id:string,amount:bigint>>")
    got = {(r.settlement_id, r.verdict, r.txn_id) for r in subset.tranche_sets(pools).collect()}
    assert got == {("s", "UNIQUE", "a"), ("s", "UNIQUE", "b"), ("t", "AMBIGUOUS", None)}


def test_reachable_is_safe_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    got = {(r.source, r.node) for r in graph.reachable(edges, spark.createDataFrame([("a",), ("d",)], "node string")).collect()}
    assert got == {*itertools.product("a", "abc"), *itertools.product("d", "abcd")}


def test_rounding_budget_skips_and_goes_on(spark):
    rows = [(f"r{i:03d}", 500) for i in range(99)] + [("s0", 499), ("s1", 499), ("t", 1), ("u", 501)]
    got = {r.ref: r.applied for r in exceptions.rounding_budget(spark.createDataFrame(rows, "ref string, impact_minor bigint")).collect()}
    assert all(got[f"r{i:03d}"] for i in range(99)) and got["s0"] and not got["s1"] and got["t"] and not got["u"]


def test_calibration(spark):
    rng = random.Random(3)
    rows = [(p := round(rng.random(), 2), rng.random() < p) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, label boolean")
    steps = calibration.fit_isotonic(df, "p", "label")
    assert [v for _, v in steps] == sorted(v for _, v in steps)
    best = max((t for t in {p for p, _ in rows} if sum(y for p, y in rows if p >= t) >= 0.9 * sum(p >= t for p, _ in rows)), key=lambda t: -t)
    assert calibration.select_tau(df, "p", "label", 0.9).first().tau == best
    beta, converged = calibration.fit_logistic(df, ["p"], "label")
    assert converged and beta[1] > 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], CREDIT)
    assert keyed.tier0(spark.createDataFrame([], SETTLEMENT), none).count() == 0
    pairs = spark.createDataFrame([], "payment_id string, txn_id string, amount_minor bigint")
    assert tuple(metrics.link_metrics(pairs, pairs).first())[:3] == (0, 0, 0)


def test_readers(spark, tmp_path):
    (tmp_path / "l.csv").write_text("order_id,merchant_id,customer_ref,amount_gross_paise,booked_at,status\nA,M,C,100,2026-03-01T10:00:00,CAPTURED\nA,M,C,200,2026-03-01T10:00:00,CAPTURED\nB,M,C,1.5,2026-03-01T10:00:00,CAPTURED\nC,M,C,5,2026-03-01T10:00:00,LOST\nD,M,,5,2026-03-01T10:00:00,CAPTURED\nE,M,C,5,2026-03-01T10:00:00,CAPTURED,extra\n")
    good, bad = readers.read_ledger(spark, str(tmp_path / "l.csv"))
    assert [(r.order_id, r.amount_minor) for r in good.collect()] == [("A", 100)]
    assert sorted(r.code for r in bad.collect()) == ["DUPLICATE_ID", "MALFORMED_MONEY", "MALFORMED_STRUCTURE", "MISSING_FIELD", "UNKNOWN_ENUM_VALUE"]
    (tmp_path / "b.csv").write_text("txn_id,value_date,narration,credit_paise,debit_paise\nX,25/03/2026,NEFT CR-UTR2026031012345-ACME,5,0\nY,01/03/2026,N,5,5\nZ,99/03/2026,N,5,0\n")
    with pytest.raises(ValueError):
        (tmp_path / "c.csv").write_text("txn_id,value_date,narration,credit_paise,debit_paise\nX,25/03/2026,N,5,0\nY,03/25/2026,N,5,0\n")
        readers.read_bank(spark, str(tmp_path / "c.csv"))
    good, bad = readers.read_bank(spark, str(tmp_path / "b.csv"))
    assert [(r.txn_id, r.value_date, r.utr) for r in good.collect()] == [("X", dt.date(2026, 3, 25), "UTR2026031012345")] and bad.count() == 2
    batch = {"settlement_id": "S", "merchant_id": "M", "utr": "UTR 1", "settled_on": "2026-03-02", "gross_paise": 100, "fee_paise": 2, "net_paise": 98, "payments": [{"payment_id": "P", "order_ref": "ord‑2026 1", "amount_paise": 100, "captured_at": "2026-03-01T00:00:00"}, {"payment_id": "Q", "amount_paise": "x", "captured_at": "2026-03-01T00:00:00"}]}
    (tmp_path / "p.json").write_text(json.dumps({"settlements": [batch, batch | {"settlement_id": "T", "net_paise": "1.5"}, {**batch, "settlement_id": "U", "payments": None}]}))
    settlements, payments, bad = readers.read_settlements(spark, str(tmp_path / "p.json"))
    assert sorted(r.settlement_id for r in settlements.collect()) == ["S", "U"] and [(r.payment_id, r.order_ref) for r in payments.collect()] == [("P", "ORD-2026-1")] and bad.count() == 2


def test_running_balance(spark):
    rows = [("b", 1, 5, 0), ("a", 1, 0, 2), ("c", 0, 7, 0)]
    bank = spark.createDataFrame([(i, DAY + dt.timedelta(d), c, x) for i, d, c, x in rows], "txn_id string, value_date date, credit_minor bigint, debit_minor bigint")
    assert {r.txn_id: r.balance_minor for r in running_balance(bank, 10).collect()} == {"c": 17, "a": 15, "b": 20}


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 45


def test_run_asserts_nothing_false(spark):
    run = QUERIES["reconcile_end_to_end"](spark, "/root/testdata/sf0.001").where("decision = 'AUTO_MATCHED'").select("payment_id", "txn_id", "share_minor")
    truth = QUERIES["truth_links"](spark, "/root/testdata/sf0.001")
    got = {r.verdict: r["count"] for r in metrics.link_confusion(run, truth).groupBy("verdict").count().collect()}
    assert got.get("FP", 0) == 0 and got["TP"] > 20 * got.get("FN", 0)
    assert run.count() == run.select("payment_id").distinct().count()
