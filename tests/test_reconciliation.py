"""The parts of the ladder, what is fitted on it and what is left of it, against plain versions and planted cases."""

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymatch.operators import bundle, calibration, exceptions, harvest, studies, subset
from tallymatch.operators.verify import verify_proposals
from tallymatch.plans import ladder
from tallymatch.sources import dataset
from tallymatch.sources.sinks import list_runs, running_balance, save_run
from tallymatch.streaming import audit

DAY = dt.date(2026, 3, 10)
SETTLEMENT = "settlement_id string, merchant_id string, utr string, settled_on date, gross_minor bigint, fee_minor bigint, tax_minor bigint, adjustments_minor bigint, net_minor bigint"
PAYMENT = "payment_id string, settlement_id string, order_ref string, amount_minor bigint"
BANK = "txn_id string, value_date date, narration string, utr string, merchant string, credit_minor bigint, debit_minor bigint"


def day(n):
    return DAY + dt.timedelta(n)


def settled(sid, amounts, utr, taken=0, fee=0, merchant="M", on=0):
    gross = sum(amounts)
    return (sid, merchant, utr, day(on), gross, fee, 0, -taken, gross - fee - taken), [(f"{sid}-{i}", sid, f"ORD-{sid}-{i}", a) for i, a in enumerate(amounts)]


def credit(txn, minor, utr=None, merchant="ACME", on=1):
    return (txn, day(on), f"NEFT CR-{utr}-{merchant}-{txn}", utr, merchant, minor, 0)


def tables(spark, batches, bank):
    return spark.createDataFrame([b[0] for b in batches], SETTLEMENT), spark.createDataFrame([p for b in batches for p in b[1]], PAYMENT), spark.createDataFrame(bank, BANK)


def test_proposals_are_refused_for_the_first_fault(spark):
    s, p, b = tables(spark, [settled("A", [60_000, 40_000], "u"), settled("B", [5_000], "v")], [credit("C", 100_000), credit("D", 60_000), ("X", day(0), "ACH DR", None, None, 0, 7)])
    made = {
        "good": ("C", None, ["A-0", "A-1"], "VERIFIED"), "part": ("D", "A", ["A-0"], "VERIFIED"), "none": ("Q", None, ["A-0"], "NO_SUCH_CREDIT"), "out": ("X", None, ["A-0"], "OUTGOING"), "empty": ("C", None, [None], "NO_PAYMENTS"),
        "twice": ("C", None, ["A-0", "A-0"], "REPEATED_PAYMENT"), "strange": ("C", None, ["A-0", "Z"], "UNKNOWN_PAYMENT"), "mixed": ("C", None, ["A-0", "B-0"], "SEVERAL_SETTLEMENTS"), "other": ("C", "B", ["A-0", "A-1"], "OTHER_SETTLEMENT"), "short": ("C", None, ["A-0"], "DOES_NOT_ADD_UP"),
    }
    rows = [(k, txn, sid, pid) for k, (txn, sid, pids, _) in made.items() for pid in pids]
    got = {r.proposal_id: r for r in verify_proposals(spark.createDataFrame(rows, "proposal_id string, txn_id string, settlement_id string, payment_id string"), p, s, b).collect()}
    assert {k: r.reason for k, r in got.items()} == {k: m[3] for k, m in made.items()}
    assert all(r.verified == (r.reason == "VERIFIED") for r in got.values()) and got["short"].residual_minor == 40_000 and got["part"].expected_minor == 60_000


def partitioned(spark, batches, bank, config=None):
    s, p, b = tables(spark, batches, bank)
    return sorted((r.settlement_id, r.verdict, r.payment_id, r.txn_id) for r in subset.tier2(s, b, p, *([config] if config else [])).collect())


def test_split_batch_with_a_charge_back(spark):
    """Shares of the net are of the payments that travelled: 30,000 was taken out, and is in neither credit."""
    batch = settled("A", [60_000, 40_000, 30_000], "u", taken=30_000, fee=2_000)
    net = batch[0][-1]
    first = round(net * 60_000 / 100_000)
    assert partitioned(spark, [batch], [credit("C", first, "u"), credit("D", net - first, "u")]) == [("A", "UNIQUE", "A-0", "C"), ("A", "UNIQUE", "A-1", "D")]


def test_refused_splits_say_which_credit(spark):
    alike = settled("A", [50_000, 50_000, 7_000], "u")
    assert partitioned(spark, [alike], [credit("C", 57_000, "u"), credit("D", 50_000, "u")]) == [("A", "AMBIGUOUS", None, "C")]
    many = settled("B", [1_000 + i for i in range(60)], "v")
    total = many[0][-1]
    assert partitioned(spark, [many], [credit("E", total - 20_000, "v"), credit("F", 20_000, "v")]) == [("B", "UNPROVEN", None, "E")]


def test_refusals_reach_the_result(spark):
    batches = [settled("A", [50_000, 50_000, 7_000], "u"), settled("B", [9_000], "w")]
    s, p, b = tables(spark, batches, [credit("C", 57_000, "u"), credit("D", 50_000, "u"), credit("E", 9_000, "w")])
    got = ladder.reconcile(s, p, b).collect()
    assert {(r.settlement_id, r.txn_id, r.outcome, r.p, r.decision) for r in got} == {("A", "C", "AMBIGUOUS", 0.5, "EXCEPTION"), ("B", "E", "LINKED", 1.0, "AUTO_MATCHED")}


def test_contenders_of_sets_against_brute_force(spark):
    rng = random.Random(4)
    batches, bank = [], []
    for k in range(25):
        amounts = [rng.choice((1_000, 2_000, 3_000, 5_000)) + 7 * rng.randint(0, 1) for _ in range(rng.randint(2, 7))]
        batches.append(settled(f"S{k}", amounts, f"u{k}", fee=rng.randint(0, 90)))
        half, net = rng.randint(1, len(amounts) - 1), batches[-1][0][-1]
        first = net * sum(amounts[:half]) // sum(amounts)
        bank += [credit(f"C{k}", first, f"u{k}"), credit(f"D{k}", net - first, f"u{k}")]
    s, p, b = tables(spark, batches, bank)
    top = 40
    found = {}
    for r in harvest.aggregation_contenders(s, b, p, top_k=top).collect():
        found.setdefault((r.settlement_id, r.txn_id, r.rank), []).append(r)
    got = {}
    for (sid, txn, _), rs in found.items():
        got.setdefault((sid, txn), set()).add(frozenset(r.payment_id for r in rs))
        assert {r.subset_size for r in rs} == {len(rs)} and sum(r.share_minor for r in rs) == next(c[5] for c in bank if c[0] == txn)
    for (row, own), (c, d) in zip(batches, itertools.batched(bank, 2), strict=True):
        whole, net = row[4], row[8]
        for txn in (c, d):
            want = set()
            for mask in range(1, 1 << len(own)):
                part = sum(x[3] for i, x in enumerate(own) if mask >> i & 1)
                low, rest, other = part * net // whole, part * net % whole, (whole - part) * net % whole
                expected = net if part >= whole else low + (rest > 0 and rest >= other)
                if abs(expected - txn[5]) <= 300:
                    want.add(frozenset(x[0] for i, x in enumerate(own) if mask >> i & 1))
            have = got.get((row[0], txn[0]), set())
            assert have <= want and len(have) == min(top, len(want))


ROW = "settlement_id string, payment_id string, txn_id string, tier int, rank int, share_minor bigint, verified boolean, amount_delta_minor bigint, tolerance_band_minor bigint, amount_delta_ratio double, date_delta_days int, lexical_score double, graph_support double, subset_size int, positive boolean, accepted boolean, asserted boolean"


def contenders(spark, seed, n=300):
    rng, rows = random.Random(seed), []
    for i in range(n):
        tier = rng.choice((2, 3))
        score = round(rng.random(), 3) if tier == 3 else 0.0
        delta = rng.randint(0, 900)
        good = rng.random() < 1 / (1 + math.exp(-(6 * score - delta / 200 + (2 if tier == 2 else -1))))
        rows.append((f"S{seed}-{i}", f"P{seed}-{i}", f"B{seed}-{i}", tier, 0, 5, True, delta, 300, delta / 10_000, rng.randint(0, 6), score, 0.0, 3 if tier == 2 else 0, good, i % 10 > 0, good))
    return spark.createDataFrame(rows, ROW)


def test_bundle_is_kept_and_applied_whole(spark, tmp_path):
    train, other, path = contenders(spark, 1), contenders(spark, 2), str(tmp_path / "bundles")
    made = bundle.fit_bundle(train, other)
    assert made.tiers == (2, 3) and made.converged and made.train_rows == 270 and made.weights[1 + 1 + bundle.BASE.index("lexical_score")] > 0
    assert bundle.list_bundles(spark, path) == []
    assert [bundle.save_bundle(spark, made, path) for _ in "ab"] == [made.version] * 2
    second = bundle.fit_bundle(other, train)
    bundle.save_bundle(spark, second, path)
    assert bundle.list_bundles(spark, path) == sorted([made.version, second.version])
    assert bundle.load_bundle(spark, path, made.version) == made and bundle.load_bundle(spark, path, second.version) == second
    with pytest.raises(ValueError):
        bundle.load_bundle(spark, path, "0" * 16)
    rows = contenders(spark, 3, 60).withColumn("p", F.lit(0.25))
    mixed = rows.withColumns({"tier": F.when(F.col("rank") + F.crc32("payment_id") % 5 == 0, 0).when(F.crc32("payment_id") % 5 == 1, 4).otherwise(F.col("tier")), "verified": F.crc32("txn_id") % 3 > 0})
    got = bundle.apply_bundle(mixed, made).collect()
    assert {r.blend for r in got} == {"BYPASSED", "REFUSAL", "UNCOVERED", "SCORED"}
    values = {v for _, v in made.steps}
    for r in got:
        assert r.blend == ("BYPASSED" if r.tier < 2 else "REFUSAL" if not r.verified else "UNCOVERED" if r.tier == 4 else "SCORED")
        assert (r.p in values and 0 < r.raw_score < 1) if r.blend == "SCORED" else (r.p == 0.25 and r.raw_score is None)
    tuned = bundle.configured(made)
    assert tuned.tau_high == made.tau and tuned.tau_low <= tuned.tau_high and tuned.digest != made.config_digest


def test_bundle_refuses_its_own_homework(spark):
    one = contenders(spark, 1)
    with pytest.raises(ValueError):
        bundle.fit_bundle(one, one)
    with pytest.raises(ValueError):
        bundle.fit_bundle(one, contenders(spark, 2).unionAll(one.limit(20)))


def test_logistic_against_numpy_and_weights(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] + 0.3)))
    df = spark.createDataFrame([(float(a), float(b), bool(c), 2) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y boolean, n int")
    beta, one = np.zeros(3), np.column_stack([np.ones(400), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-one @ beta))
        beta = beta + np.linalg.solve(one.T @ (one * (p * (1 - p))[:, None]) + 2 * np.diag([0, 1, 1]), one.T @ (y - p) - 2 * np.array([0, 1, 1]) * beta)
    got, converged = calibration.fit_logistic(df, ["a", "b"], "y")
    assert converged and np.allclose(got, beta, atol=1e-8)
    twice, _ = calibration.fit_logistic(df, ["a", "b"], "y", l2=2.0, weight="n")
    assert np.allclose(twice, beta, atol=1e-8)


def test_threshold_and_steps_against_plain_versions(spark):
    rng = random.Random(6)
    rows = [(p := rng.random() ** 2, rng.random() < p) for _ in range(3_000)] + [(0.5, True)] * 30 + [(1.0, True), (0.0, False)]
    df = spark.createDataFrame(rows, "p double, label boolean")
    for target in (0.5, 0.8, 0.95):
        good = [t for t in {p for p, _ in rows} if sum(y for p, y in rows if p >= t) >= target * sum(p >= t for p, _ in rows)]
        got = calibration.select_tau(df, "p", "label", target).first()
        assert got.tau == min(good) and got.attained and got.support == sum(p >= got.tau for p, _ in rows)
    none = calibration.select_tau(df.where("not label"), "p", "label", 0.9).first()
    assert (none.tau, none.attained, none.support) == (1.0, False, 0)
    steps = calibration.fit_isotonic(df, "p", "label")
    for r in df.select("p", calibration.predict_isotonic(F.col("p"), steps).alias("v")).distinct().collect():
        assert r.v == max((s, v) for s, v in steps if s <= round(r.p, 4) + 1e-9)[1] if round(r.p, 4) >= steps[0][0] else steps[0][1]


def test_near_counts_against_brute_force(spark):
    rng = random.Random(7)
    amounts = [rng.choice((rng.randint(1, 30_000), 5_000, rng.randint(10**6, 10**7))) for _ in range(500)]
    left = [(i, rng.choice(amounts) + rng.randint(-60, 60)) for i in range(200)] + [(200, 0), (201, 10**9), (202, -5)]
    df = exceptions.near_counts(spark.createDataFrame(left, "id int, x bigint"), F.col("x") - 50, F.col("x") + F.floor(F.abs("x") / 200) + 100, spark.createDataFrame([(a,) for a in amounts], "amount_minor bigint"))
    assert {r.id: r.n_near for r in df.collect()} == {i: sum(x - 50 <= a <= x + abs(x) // 200 + 100 for a in amounts) for i, x in left}


def test_external_refunds_name_an_order_only_if_it_is_the_one(spark):
    batches = [settled("A", [60_000, 40_000], "u"), settled("B", [90_000], "v", taken=40_000, on=5), settled("C", [1_000, 7_000], "w"), settled("D", [7_000, 80_000], "x"), settled("E", [99_000], "y", taken=7_000, on=6), settled("F", [50_000], "z", taken=12_345)]
    s, p, b = tables(spark, batches, [credit("1", 100_000, "u"), credit("2", 50_000, "v", on=6)])
    orders = [(f"ORD-{sid}-{i}", a, "REFUNDED" if a in (40_000, 7_000) else "CAPTURED") for sid, i, a in [(x[1], x[0][-1], x[3]) for row in batches for x in row[1]]]
    ledger = spark.createDataFrame(orders, "order_id string, amount_minor bigint, status string")
    links = ladder.reconcile(s, p, b)
    got = {r.ref: r for r in exceptions.external_refunds(s, p, ledger, links).collect()}
    assert set(got) == {"order:ORD-A-1", "settlement:E"}
    assert got["order:ORD-A-1"].counterpart == "A" and [e.kind for e in got["order:ORD-A-1"].evidence] == ["ARITHMETIC_CHECK", "AMOUNT_MATCH", "EXACT_KEY"]
    assert [e.ref for e in got["settlement:E"].evidence] == ["settlement:E", "order:ORD-C-1", "order:ORD-D-0"] and got["settlement:E"].impact_minor == 7_000


def test_queue_has_payments_and_is_in_order(spark):
    batches = [settled("A", [60_000, 40_000], "u", taken=40_000), settled("B", [9_000], "w"), settled("C", [70_000], "q")]
    s, p, b = tables(spark, batches, [credit("1", 60_000, "u"), credit("2", 4_444, None, None), credit("3", 4_445, "zz")])
    links, ledger = ladder.reconcile(s, p, b), spark.createDataFrame([], "order_id string, amount_minor bigint, status string")
    reposted, profiles = spark.createDataFrame([], "txn_id string, original_id string"), spark.createDataFrame([], "merchant_id string, spelling string")
    queue = exceptions.queue_order(exceptions.classify_exceptions(s, p, b, ledger, links, reposted, profiles)).collect()
    assert [(r.ref, r["class"], r.severity) for r in queue] == [("settlement:C", "E_LATE_ARRIVAL", "LOW"), ("payment:A-1", "E_CHARGEBACK_NETTED", "LOW"), ("settlement:B", "E_LATE_ARRIVAL", "LOW"), ("bank:3", "E_ORPHAN_BANK_CREDIT", "LOW"), ("bank:2", "UNMATCHABLE", "LOW")]
    assert queue[1].confidence == 1.0 and queue[0].confidence == 0.75


def test_bounded_rules(spark):
    rows = [("a", "E_ROUNDING_DRIFT", 500, None)] * 0 + [(f"r{i:03d}", "E_ROUNDING_DRIFT", 500, None) for i in range(101)] + [("big", "E_ROUNDING_DRIFT", 501, None), ("t1", "E_TIMING_SHIFT", 9, -5), ("t2", "E_TIMING_SHIFT", 9, 6), ("t3", "E_TIMING_SHIFT", 9, None), ("d", "E_DUPLICATE_CREDIT", 9, None), ("x", "E_LATE_ARRIVAL", 9, None)]
    queue = spark.createDataFrame(rows, "ref string, class string, impact_minor bigint, day_gap int").withColumn("resolvable", F.lit(True))
    done = exceptions.resolve_bounded(queue)
    got = {r.ref: (r.applied, r.refusal) for r in done.collect()}
    assert sum(got[f"r{i:03d}"][0] for i in range(101)) == 100 and got["r100"] == (False, "OVER_RUN_BUDGET") and "x" not in got
    assert [got[k] for k in ("big", "t1", "t2", "t3", "d")] == [(False, "OVER_RECORD_BOUND"), (True, None), (False, "OVER_DAYS"), (False, "NO_DAY_GAP"), (True, None)]
    marked = {r.ref: r.resolvable for r in exceptions.mark_resolvable(queue, done).collect()}
    assert marked["t1"] and not marked["x"] and not marked["t2"]


def test_links_count_under_every_class(spark):
    truth = spark.createDataFrame([("p", "b", 5), ("q", "c", 6), ("r", "d", 7)], "payment_id string, txn_id string, amount_minor bigint")
    records = spark.createDataFrame([("payment:p", "MATCHED", "X", 1), ("bank:b", "MATCHED", "Y", 1), ("payment:q", "MATCHED", "X", 1), ("bank:c", "MATCHED", "CLEAN", 1)], "ref string, verdict string, anomaly string, impact_minor bigint")
    got = {r.anomaly: (r.n, r.found) for r in studies.recall_by_classes(truth.where("payment_id = 'q'"), truth, records).collect()}
    assert got == {"X": (2, 1), "Y": (1, 0), "CLEAN": (1, 0)}


def test_dataset_and_truth(spark, tmp_path):
    (tmp_path / "ledger_orders.csv").write_text("order_id,merchant_id,customer_ref,amount_gross_paise,booked_at,status\nA,M,C,-5,2026-03-01T10:00:00,CAPTURED\nB,M,C,5,2026-03-01T10:00:00,CAPTURED\n")
    (tmp_path / "bank_statement.csv").write_text("txn_id,value_date,narration,credit_paise,debit_paise\nX,25/03/2026,NEFT CR-UTR2026031012345-ACME,5,0\nY,25/03/2026,N,-5,0\n")
    got = dataset.ingest_available(spark, str(tmp_path))
    assert got.present == ("ledger_orders.csv", "bank_statement.csv") and got.payments.count() == 0
    assert {(r.source, r.code): r.n for r in got.counts().collect()} == {("ledger", "SOUND"): 1, ("ledger", "NEGATIVE_AMOUNT"): 1, ("psp", "SOUND"): 0, ("psp_payment", "SOUND"): 0, ("bank", "SOUND"): 1, ("bank", "NEGATIVE_AMOUNT"): 1}
    assert [r.source for r in got.ordered_problems().collect()] == ["ledger", "bank"]
    with pytest.raises(dataset.IngestError):
        dataset.ingest_dataset(spark, str(tmp_path))
    with pytest.raises(dataset.IngestError):
        dataset.ingest_available(spark, str(tmp_path), strict=True)
    (tmp_path / "manifest.json").write_text(json.dumps({"split": "dev", "difficulty": "easy", "seed": 1, "generator_version": "1", "counts": {"orders": 2}, "scenario_draws": {"A01": 1, "A09": 0}, "money": {"m": 5}}, indent=1))
    (tmp_path / "ground_truth_links.csv").write_text("link_type,source_ref,target_ref,amount_paise,anomaly_class\nPAYMENT_CREDITED_AS,payment:P,bank_txn:X,5,A01\nORDER_PAID_BY,order:B,payment:P,5,A01\n")
    (tmp_path / "ground_truth_records.csv").write_text("record_ref,expected_status,anomaly_class,impact_paise,note\npayment:P,EXCEPTION,A02,7,\nbank_txn:X,UNMATCHABLE,A01,3,why\npayment:P,MATCHED,A01,5,\n")
    truth = dataset.load_ground_truth(spark, str(tmp_path))
    assert [tuple(r) for r in truth.evaluation_pairs().collect()] == [("P", "X", 5)] and truth.manifest.first().scenario_draws == {"A01": 1, "A09": 0}
    assert {r.ref for r in truth.reconcilable_refs().collect()} == {"payment:P"} and {r.ref for r in truth.unmatchable_refs().collect()} == {"bank_txn:X"}
    assert {r.anomaly: (r.n, r.share) for r in truth.anomaly_counts().collect()} == {"A01": (2, 1.0), "A02": (0, 0.0), "A09": (0, 0.0)}
    (tmp_path / "ground_truth_records.csv").write_text("record_ref,expected_status,anomaly_class,impact_paise,note\npayment:P,PERHAPS,A02,7,\n")
    with pytest.raises(dataset.IngestError):
        dataset.load_ground_truth(spark, str(tmp_path))


def test_audit_log_counts_a_batch_once(spark, tmp_path):
    events = lambda k: spark.createDataFrame([("r", f"tier{k}", "AUTO_MATCHED", ["a"], "{}")] * 3, audit.EVENTS)
    source, log, checkpoint = (str(tmp_path / x) for x in ("events", "log", "checkpoint"))
    for k in (0, 1):
        events(k).write.mode("append").parquet(source)
        for _ in "ab":  # the second time there is nothing new
            audit.append_events(audit.event_stream(spark, source), log, checkpoint).awaitTermination()
    assert {(r.node, r.n) for r in audit.by_node(audit.read_log(spark, log), "r").collect()} == {("tier0", 3), ("tier1", 3)}
    assert audit.of_type(audit.read_log(spark, log), "EXCEPTION").count() == 0


def test_runs_are_listed(spark, tmp_path):
    folder = str(tmp_path / "runs")
    assert list_runs(spark, folder).count() == 0
    for run in ("one", "two"):
        save_run(folder, run, links=spark.range(3), queue=spark.range(2))
    assert sorted(r.run_id for r in list_runs(spark, folder).collect()) == ["one", "two"]


def test_balance_of_one_busy_day(spark):
    rng = random.Random(8)
    rows = [(f"t{i:04d}", DAY, rng.randint(0, 9), rng.randint(0, 9)) for i in range(2_000)]
    got = {r.txn_id: r.balance_minor for r in running_balance(spark.createDataFrame(rows, "txn_id string, value_date date, credit_minor bigint, debit_minor bigint").repartition(5), 100).collect()}
    assert got == {r[0]: b for r, b in zip(rows, itertools.accumulate((c - d for _, _, c, d in rows), initial=100), strict=False) for b in [b + r[2] - r[3]]}
