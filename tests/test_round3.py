"""What the third round's review found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymatch.llm import html_extraction, substring_dedup
from tallymatch.operators import exceptions, harvest, keyed, lexical, metrics, studies
from tallymatch.plans import ladder, queries
from tallymatch.sources.corpus import Corpus
from tallymatch.sources.readers import check_ledger, read_narrations


def test_classes_count_a_settlement_with_two_rows_twice(spark):
    """A settlement's own residue and a refund that it has taken out are of one class and cost different sums."""
    rows = [("settlement:s", "E_POST_SETTLEMENT_REFUND", 500), ("settlement:s", "E_POST_SETTLEMENT_REFUND", 70), ("settlement:s", "E_POST_SETTLEMENT_REFUND", 70), ("bank:b", "UNMATCHABLE", 9)]
    out = metrics.exceptions_by_class(spark.createDataFrame(rows, "ref string, class string, impact_minor bigint"))
    assert {tuple(r) for r in out.collect()} == {("E_POST_SETTLEMENT_REFUND", 2, 570), ("UNMATCHABLE", 1, 9)}


def test_the_tree_is_asked_of_pages_with_an_article_too(spark):
    """A passage that all of a site's articles have goes, although it lies in an article element."""
    site = [(i, f"http://h/{i}", f"<article><div class=body><p>story {i} of its own</p></div><div class=tail><p>all rights are ours</p></div></article>") for i in range(10)]
    out = html_extraction.main_texts(spark.createDataFrame(site, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == {i: f"story {i} of its own" for i in range(10)}


def test_shares_read_payments_once(spark, tmp_path):
    """One pass over the payments says what a batch comes to, what it lost and what each payment's share is."""
    spark.createDataFrame([("s", "p", 60), ("s", "q", 40), ("s", "r", 30)], "settlement_id string, payment_id string, amount_minor bigint").write.parquet(f"{tmp_path}/payments")
    settlements = spark.createDataFrame([("s", 130, -30)], "settlement_id string, gross_minor bigint, adjustments_minor bigint")
    links = spark.createDataFrame([("s", "b", 0, 1.0, "LINKED")], "settlement_id string, txn_id string, tier int, p double, outcome string")
    out = keyed.spread(links, spark.read.parquet(f"{tmp_path}/payments"), spark.createDataFrame([("b", 99)], "txn_id string, credit_minor bigint"), settlements)
    assert {(r.payment_id, r.share_minor, r.verified) for r in out.collect()} == {("p", 59, True), ("q", 40, True)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_rows_with_a_near_amount_without_pairs(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, rng.randrange(1, 300_000)) for i in range(80)], "i int, a bigint")
    right = spark.createDataFrame([(j, rng.randrange(1, 300_000)) for j in range(400)], "j int, b bigint")
    keep = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(100), F.ceil(F.col("a") / 200))
    pairs = keyed.near_amount(left, right, "a", "b", keep)
    semi = keyed.near_amount(left, right, "a", "b", keep, how="left_semi")
    assert {r.i for r in pairs.collect()} == {r.i for r in semi.collect()}
    assert {(r.i, r.j) for r in pairs.collect()} == {(r.i, r.j) for r in left.join(right, keep).collect()}


def test_contenders_and_run_are_one_run(spark, monkeypatch):
    made = []
    reconcile = ladder.reconcile
    for module in (ladder, queries):
        monkeypatch.setattr(module, "reconcile", lambda *a, **k: made.append(1) or reconcile(*a, **k))
    c = Corpus(spark, "/root/testdata/sf0.001")
    queries.candidates_of(c)
    queries.run_once(c)
    assert len(made) == 1


def test_texts_that_share_a_run_have_one_group(spark):
    """Two texts share a passage whose seeds have other partners, and each has it within a longer passage with a text that lacks it."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lines = [some(20) for _ in range(3)]
    shared = [w for line in lines for w in line]
    stock = [some(5) + line + some(40) for line in (*lines, lines[0][8:] + lines[1][:12], lines[1][8:] + lines[2][:12]) for _ in range(25)]
    made = stock
    for _ in range(2):
        head, tail = some(150), some(150)
        made = [*made, head + shared + tail, head + some(60) + tail]
    made.append(made[-2])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(made)], "doc_id long, text string").repartition(3)
    got = substring_dedup.repeated_passages(df).collect()
    group = {r.doc_id: r.group_id for r in got}
    assert {i: group.get(i) for i in range(125, 130)} == dict.fromkeys(range(125, 130), 125)
    root = list(range(len(made)))  # what the rows connect
    for _ in made:
        for r in got:
            root[r.doc_id] = root[r.other_id] = min(root[r.doc_id], root[r.other_id])
    assert {r.doc_id: root[r.doc_id] for r in got} == group


def test_runs_of_seeds_across_batches(spark):
    """Pairs of a seed's run are those of a plain walk along it, however batches cut the run."""
    rng = random.Random(9)
    lists = [(n, sorted(rng.sample(range(40), 6))) for n in range(30)]
    seeds = {(n, x): rng.randrange(6) for n, at in lists for x in at}
    rows = [(n, np.array(at, "<i4").tobytes(), np.array([seeds[n, x] for x in at], "<u8").tobytes()) for n, at in lists]
    wanted = set()
    for seed in range(6):
        run = sorted(k for k, s in seeds.items() if s == seed)
        for n, x in run[1:]:
            wanted.add((n, x, *run[0]))
            befores = [k for k in run if k[0] < n]
            if befores and befores[-1][0] != run[0][0]:
                wanted.add((n, x, *min(k for k in befores if k[0] == befores[-1][0])))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = substring_dedup.seed_pairs(spark.createDataFrame(rows, "node long, at binary, seeds binary"), np.zeros(substring_dedup.COUNTERS, np.uint32))
            assert sorted(map(tuple, found.collect())) == sorted(wanted)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_statement_and_truth_shuffle_few_payments(spark):
    """Narrations are read in place, and of the payments only those of split or netted settlements are shuffled for the truth."""
    bank = spark.createDataFrame([("a", "NEFT CR-UTR20000101000001-BACEX PVT LTD"), ("b", None)], "txn_id string, narration string")
    read = read_narrations(bank)
    assert [(r.txn_id, r.utr) for r in read.collect()] == [("a", "UTR20000101000001")]
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    c = Corpus(spark, "/root/testdata/sf0.001")
    split = "anomaly IN ('SPLIT', 'SPLIT_BARE', 'SPLIT_CHARGEBACK', 'CHARGEBACK')"
    sides = c.truth_links.where(f"NOT {split}")
    assert c.truth_links.where(split).count() + sides.count() == c.truth_links.count()
    own = spark.sql("SELECT p.payment_id, s.anomaly FROM {p} p JOIN {s} s ON p.settlement_id = s.settlement_id", p=c.payments, s=c.settlements)
    assert sides.select("payment_id", "anomaly").exceptAll(own).isEmpty()
    refunds = c._planned("refunds")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in refunds


def test_re_postings_are_sought_once_in_a_run(spark, monkeypatch):
    """The pool that the keyed tiers get is a table, and not the search for re-postings once more for each of them."""

    class Seen(Exception):
        pass

    def tier0(settlements, pool):
        raise Seen(pool._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(ladder, "tier0", tier0)
    c = Corpus(spark, "/root/testdata/sf0.001")
    with pytest.raises(Seen) as seen:
        ladder.reconcile(c.settlements, c.payments, c.statement)
    assert "Aggregate" not in str(seen.value)


def test_one_pass_gives_keyed_shares_and_what_they_leave(spark, tmp_path):
    """A settled batch, one refused over two credits with a payment taken out, and one that no link has."""
    rows = [("s", "p", 60), ("s", "q", 40), ("r", "t", 70), ("r", "u", 31), ("r", "v", 30), ("o", "w", 5)]
    spark.createDataFrame(rows, "settlement_id string, payment_id string, amount_minor bigint").write.parquet(f"{tmp_path}/payments")
    payments = spark.read.parquet(f"{tmp_path}/payments")
    settlements = spark.createDataFrame([("s", 100, 0), ("r", 131, -30), ("o", 6, 0)], "settlement_id string, gross_minor bigint, adjustments_minor bigint")
    links = spark.createDataFrame([("s", "b", 0, 1.0, "LINKED"), ("r", "c", 1, 0.5, "RIVALS"), ("r", "d", 1, 0.5, "RIVALS")], "settlement_id string, txn_id string, tier int, p double, outcome string")
    credits = spark.createDataFrame([("b", 99), ("c", 100), ("d", 101)], "txn_id string, credit_minor bigint")
    out = keyed.spread_batches(links, payments, credits, settlements)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    plain = keyed.spread(links, payments, credits, settlements)
    assert sorted(map(tuple, out.where("txn_id is not null").select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, out.where("open").select("settlement_id", "payment_id", "amount_minor").collect())) == sorted(rows[2:])


def test_the_queue_asks_for_clawbacks_once(spark, monkeypatch):
    made, clawbacks = [], exceptions.clawbacks
    monkeypatch.setattr(exceptions, "clawbacks", lambda *a: made.append(1) or clawbacks(*a))
    c = Corpus(spark, "/root/testdata/sf0.001")
    links = spark.createDataFrame([], "payment_id string, txn_id string, settlement_id string, tier int, p double, outcome string, share_minor bigint, verified boolean, decision string")
    credits = queries.credits_of(c)
    exceptions.classify_exceptions(c.settlements, queries.payments_of(c), credits, c.ledger, links, spark.createDataFrame([], "txn_id string, original_id string"), lexical.merchant_profiles(c.settlements, credits))
    assert len(made) == 1


def test_contenders_travel_twice_to_be_labelled(spark, monkeypatch):
    """Once to truth and to the run's links alike, once to what was settled."""
    row = "settlement_id string, payment_id string, txn_id string, tier int, rank int, share_minor bigint, verified boolean"
    seen = spark.createDataFrame([("s", "p", "b", 3, 1, 9, True), ("s", "p", "b", 3, 0, 9, True), ("s", "p", "c", 3, 2, 9, True), ("r", "q", "c", 2, 0, 5, True)], row)
    links = spark.createDataFrame([("s", "p", "b", 3, "LINKED", True), ("r", "q", "d", 3, "LINKED", True)], "settlement_id string, payment_id string, txn_id string, tier int, outcome string, verified boolean")
    truth = spark.createDataFrame([("p", "c"), ("p", "c"), ("q", "c")], "payment_id string, txn_id string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = harvest.labelled([seen], links, truth)
        got = {(r.payment_id, r.txn_id, r.tier, r["rank"], r.positive, r.accepted, r.asserted) for r in out.collect()}
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert got == {("p", "b", 3, 0, False, True, True), ("p", "c", 3, 2, True, True, False), ("q", "c", 2, 0, True, False, False)}
        assert plan.count("Join") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_candidates_are_a_table(spark, monkeypatch):
    """Queries over the candidates read them; before, each joined them with truth again."""
    c = Corpus(spark, "/root/testdata/sf0.001")
    run = spark.createDataFrame([("p", "b", 0, 1.0, True), ("q", "b", 1, 0.5, False)], "payment_id string, txn_id string, tier int, p double, verified boolean")
    weighed = spark.createDataFrame([("r", "c", 3, 0.9, True, True)], "payment_id string, txn_id string, tier int, lexical_score double, verified boolean, positive boolean")
    monkeypatch.setattr(queries, "run_once", lambda c: run)
    monkeypatch.setattr(queries, "harvest_once", lambda c: weighed)
    c.keep("truth_links", spark.createDataFrame([("q", "b"), ("q", "b")], "payment_id string, txn_id string"))
    out = queries.candidates_of(c)
    assert {tuple(r) for r in out.collect()} == {("p|b|0", 0, 1.0, True, False), ("q|b|1", 1, 0.5, False, True), ("r|c|3", 3, 0.9, True, True)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_link_of_two_systems_meets_truth_once(spark):
    arms = spark.createDataFrame([(["a", "b"], "p", "x", 5), (["b"], "q", "x", 7)], "arm array<string>, payment_id string, txn_id string, share_minor bigint")
    truth = spark.createDataFrame([("p", "x"), ("p", "x"), ("r", "x")], "payment_id string, txn_id string")
    assert {tuple(r) for r in studies.comparison(arms, truth).collect()} == {("a", 1, 0, 1, 1.0, 0.5, 0), ("b", 1, 1, 1, 0.5, 0.5, 7)}


def test_sound_rows_travel_only_where_keys_repeat(spark):
    """Of sound rows with one id the first stays, and an unsound one does not count; without repeated ids nothing is ranked."""
    row = lambda i, id, amount="5", day="2024-01-01": (i, id, "m", "c", amount, day, "CAPTURED", None)
    schema = "ord long, order_id string, merchant_id string, customer_ref string, amount_gross_paise string, booked_at string, status string, currency string"
    rows = [row(0, "a", "x"), row(1, "a"), row(2, "b", day="no"), row(3, "a", "6"), row(4, "c"), row(5, ""), row(6, ""), row(7, "a", "7")]
    good, bad = check_ledger(spark.createDataFrame(rows, schema))
    assert sorted((r.order_id, r.amount_minor) for r in good.collect()) == [("a", 5), ("c", 5)]
    assert sorted((r.ord, r.code, r.field) for r in bad.collect()) == [(0, "MALFORMED_MONEY", "amount_gross_paise"), (2, "MALFORMED_DATE", "booked_at"), (3, "DUPLICATE_ID", "order_id"), (5, "MISSING_FIELD", "order_id"), (6, "MISSING_FIELD", "order_id"), (7, "DUPLICATE_ID", "order_id")]
    good, bad = check_ledger(spark.createDataFrame([row(0, "a"), row(1, "b", "x")], schema))
    assert not any("Window" in df._jdf.queryExecution().optimizedPlan().toString() for df in (good, bad))
