"""A reconciliation corpus derived from the trade tables: ledger, settlements, payments, bank statement and truth.

Every line item is a payment, every supplier's month a settlement. What happens to a settlement follows from a number of
its key, so both engines derive the same rows, no row depends on another's order, and the corpus grows with the tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import fold_ascii
from .readers import read_narrations
from .sinks import stored

#: Digits of a merchant's number as syllables, so that names differ by more than a digit.
SYLLABLES = ("BA", "CEX", "DIM", "FOR", "GUN", "KAV", "LEP", "MIZ", "NOS", "PUT")
#: Anomalies by the settlement's number below 100: first number of each, in order; the rest are clean.
ANOMALIES = (("ROUNDING", 0, 5), ("FEE_MISMATCH", 5, 9), ("TIMING", 9, 14), ("DUPLICATE", 14, 16), ("NO_REFERENCE", 16, 22), ("CHARGEBACK", 22, 25), ("SPLIT", 25, 30), ("ORPHAN", 30, 32), ("LATE", 32, 33), ("SHARED_REFERENCE", 33, 36), ("SPLIT_BARE", 36, 38), ("SPLIT_CHARGEBACK", 38, 41), ("EXTERNAL_REFUND", 41, 44))

DIALECTS = {
    "spark": {"add": "date_add({0}, {1})", "div": "({0} div {1})", "ymd": "date_format({0}, 'yyyyMMdd')"},
    "duckdb": {"add": "({0} + CAST({1} AS INTEGER))", "div": "({0} // {1})", "ymd": "strftime({0}, '%Y%m%d')"},
}


def kind_of(no: str) -> str:
    """The anomaly by the settlement's number."""
    return "CASE " + " ".join(f"WHEN {no} < {end} AND {no} >= {begin} THEN '{name}'" for name, begin, end in ANOMALIES) + " ELSE 'CLEAN' END"


def spark_ctes() -> dict[str, str]:
    """The subqueries that Spark reads another way than corpus_ctes has them, with the same rows, and the ledger and
    the payments with their items' numbers.

    A payment's settlement follows from its merchant and month, and so does that settlement's anomaly. So payments of the few
    kinds that need more than that are picked before they are shuffled, and the others need no join.
    """
    no = "(p.merchant_no * 7 + p.month_no * 13) % 100"
    among = lambda no, *kinds: "(" + " OR ".join(f"{no} BETWEEN {begin} AND {end - 1}" for name, begin, end in ANOMALIES if name in kinds) + ")"
    split, netted = ("SPLIT", "SPLIT_BARE", "SPLIT_CHARGEBACK"), ("CHARGEBACK", "SPLIT_CHARGEBACK")
    whole = corpus_ctes("duckdb")
    picked = lambda name, kinds: whole[name].replace("FROM payments p ", f"FROM (SELECT * FROM payments p WHERE {among(no, *kinds)}) p ")
    parted = picked("truth_links", split + netted).replace("//", "div")
    records, *others = whole["truth_records"].split("UNION ALL")
    return {
        "batches": """
            SELECT concat('STL-', CAST(merchant_no AS VARCHAR(20)), '-', CAST(month_no AS VARCHAR(20))) AS settlement_id, concat('M', CAST(merchant_no AS VARCHAR(20))) AS merchant_id, merchant_no, month_no, (merchant_no * 7 + month_no * 13) % 100 AS no, n, gross, largest, last_day
            FROM (SELECT merchant_no, month_no, count(*) AS n, sum(amount_minor) AS gross, max(amount_minor) AS largest, max(captured_on) AS last_day FROM payments GROUP BY merchant_no, month_no)""",
        "refunds": f"""
            SELECT merchant_no, month_no + 1 AS month_no, min(refund) AS refund
            FROM (SELECT merchant_no, month_no, min(amount_minor) AS refund FROM items WHERE item IS NOT NULL AND {among("(merchant_no * 7 + (month_no + 1) * 13) % 100", "EXTERNAL_REFUND")} GROUP BY merchant_no, month_no, item HAVING max(CASE WHEN flag = 'R' AND no > 22 THEN 1 ELSE 0 END) = 1)
            GROUP BY merchant_no, month_no""",
        "numbered_payments": whole["payments"].replace("SELECT ", "SELECT no, ", 1),
        "numbered_ledger": whole["ledger"].replace("SELECT ", "SELECT no, ", 1),
        "tranche_items": picked("tranche_items", split),
        "truth_links": f"""
            SELECT p.payment_id, concat('BNK-', p.settlement_id, '-1') AS txn_id, p.amount_minor, {kind_of(no)} AS anomaly FROM payments p WHERE p.settlement_id IS NOT NULL AND NOT {among(no, *split, *netted)}
            UNION ALL {parted}""",
        "truth_records": f"""
            SELECT concat('payment:', p.payment_id) AS ref, 'MATCHED' AS verdict, CASE WHEN p.order_ref_raw IS NULL THEN 'NO_ORDER' ELSE 'CLEAN' END AS anomaly, p.amount_minor AS impact_minor FROM payments p WHERE p.settlement_id IS NOT NULL AND NOT {among(no, *netted)}
            UNION ALL {records.replace("FROM payments p ", f"FROM (SELECT * FROM payments p WHERE {among(no, *netted)}) p ")} UNION ALL {" UNION ALL ".join(others)}""",
        "proposed": f"""
            SELECT concat('PROP-', txn_id) AS proposal_id, txn_id, settlement_id, payment_id, kind, row_number() OVER (PARTITION BY txn_id ORDER BY payment_id) AS pos
            FROM (SELECT *, explode(array_repeat(0, CAST(rows AS INT))) AS again
                  FROM (SELECT *, count(*) OVER (PARTITION BY txn_id, payment_id) AS rows
                        FROM (SELECT /*+ REPARTITION(txn_id) */ concat('BNK-', p.settlement_id, '-1') AS txn_id, p.settlement_id, p.payment_id, p.month_no % 9 AS kind
                              FROM payments p WHERE p.settlement_id IS NOT NULL AND p.payment_id IS NOT NULL AND NOT {among(no, *split, *netted)})))
            UNION ALL
            SELECT concat('PROP-', t.txn_id) AS proposal_id, t.txn_id, p.settlement_id, t.payment_id, p.month_no % 9 AS kind, row_number() OVER (PARTITION BY t.txn_id ORDER BY t.payment_id) AS pos
            FROM ({parted}) t JOIN (SELECT * FROM payments p WHERE {among(no, *split, *netted)}) p ON p.payment_id = t.payment_id WHERE p.settlement_id IS NOT NULL""",
        "proposals": """
            SELECT proposal_id, CASE WHEN kind = 1 THEN concat(txn_id, '-X') WHEN kind = 2 THEN (SELECT min(txn_id) FROM bank WHERE debit_minor > 0) ELSE txn_id END AS txn_id, CASE WHEN kind = 6 THEN 'STL-0-0' WHEN kind >= 3 THEN settlement_id END AS settlement_id,
                   CASE WHEN copy = 2 AND kind = 5 THEN (SELECT min(payment_id) FROM payments) WHEN kind = 4 AND pos = 1 THEN concat(payment_id, '-X') WHEN kind = 8 THEN NULL ELSE payment_id END AS payment_id
            FROM (SELECT *, explode(sequence(1, CASE WHEN kind IN (3, 5) AND pos = 1 THEN 2 ELSE 1 END)) AS copy FROM proposed WHERE NOT (kind = 7 AND pos = 2) AND NOT (kind = 8 AND pos > 1))""",
    }


def corpus_ctes(dialect: str) -> dict[str, str]:
    """The corpus as named SQL subqueries over lineitem and orders, in either dialect."""
    add, div, ymd = (DIALECTS[dialect][k].format for k in ("add", "div", "ymd"))
    kind = kind_of("no")
    digits = "lpad(CAST(merchant_no AS VARCHAR(20)), 4, '0')"
    name = digits
    for i, syllable in enumerate(SYLLABLES):
        name = f"replace({name}, '{i}', '{syllable}')"
    ceil_bps = lambda x, bps: div(f"({x} * {bps} + 9999)", "10000")
    return {
        "items": f"""
            SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', {ymd("l_shipdate")}) AS item,
                   l_orderkey AS order_no, l_suppkey AS merchant_no, CAST(l_shipdate AS DATE) AS day, year(l_shipdate) * 12 + month(l_shipdate) AS month_no,
                   CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor, l_returnflag AS flag, (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7 + l_suppkey * 3) % 100 AS no
            FROM lineitem""",
        "payments": """
            SELECT concat('PAY-', item) AS payment_id, concat('STL-', CAST(merchant_no AS VARCHAR(20)), '-', CAST(month_no AS VARCHAR(20))) AS settlement_id, concat('M', CAST(merchant_no AS VARCHAR(20))) AS merchant_id,
                   CASE WHEN no < 7 THEN NULL WHEN no < 14 THEN lower(concat('ORD ', item)) WHEN no < 20 THEN replace(concat('ORD-', item), '-', '_') WHEN no < 22 THEN concat('ORD-', item, '-X') ELSE concat('ORD-', item) END AS order_ref_raw,
                   amount_minor, day AS captured_on, merchant_no, month_no
            FROM items""",
        "ledger": """
            SELECT concat('ORD-', item) AS order_id, concat('M', CAST(merchant_no AS VARCHAR(20))) AS merchant_id, concat('C', CAST(o_custkey AS VARCHAR(20))) AS customer_ref,
                   amount_minor + CASE WHEN no = 22 THEN 100 ELSE 0 END AS amount_minor, day AS booked_on, CASE WHEN flag = 'R' THEN 'REFUNDED' ELSE 'CAPTURED' END AS status
            FROM items JOIN orders ON o_orderkey = order_no""",
        "batches": f"""
            SELECT settlement_id, merchant_id, merchant_no, month_no, (merchant_no * 7 + month_no * 13) % 100 AS no, count(*) AS n, sum(amount_minor) AS gross, max(amount_minor) AS largest, max(captured_on) AS last_day
            FROM payments GROUP BY settlement_id, merchant_id, merchant_no, month_no""",
        "refunds": """
            SELECT p.merchant_no, p.month_no + 1 AS month_no, min(p.amount_minor) AS refund FROM payments p JOIN items i ON concat('PAY-', i.item) = p.payment_id WHERE i.flag = 'R' AND i.no > 22 GROUP BY p.merchant_no, p.month_no""",
        "priced": f"""
            SELECT b.*, CASE WHEN {kind} IN ('CHARGEBACK', 'SPLIT_CHARGEBACK') THEN -largest WHEN {kind} = 'EXTERNAL_REFUND' THEN -coalesce(r.refund, 0) ELSE 0 END AS adjusted, {kind} AS anomaly, CAST({ceil_bps("gross", 200)} AS BIGINT) AS fee, {add("last_day", "1")} AS settled_on FROM batches b LEFT JOIN refunds r ON r.merchant_no = b.merchant_no AND r.month_no = b.month_no""",
        "settlements": f"""
            SELECT settlement_id, merchant_id, merchant_no, month_no, no, n, anomaly, settled_on,
                   concat('UTR', CASE WHEN anomaly = 'SHARED_REFERENCE' THEN '20000101' ELSE {ymd("settled_on")} END, lpad(CAST(merchant_no % 1000000 AS VARCHAR(20)), 6, '0')) AS utr,
                   CAST(gross AS BIGINT) AS gross_minor, fee AS fee_minor, CAST({ceil_bps("fee", 1800)} AS BIGINT) AS tax_minor,
                   CAST(adjusted AS BIGINT) AS adjustments_minor,
                   CAST(gross - fee - {ceil_bps("fee", 1800)} + adjusted - CASE WHEN anomaly = 'FEE_MISMATCH' THEN 500 + no ELSE 0 END AS BIGINT) AS net_minor,
                   concat({name}, ' PVT LTD') AS merchant_name
            FROM priced""",
        "tranche_items": """
            SELECT p.*, row_number() OVER (PARTITION BY p.settlement_id ORDER BY p.payment_id) AS pos FROM payments p JOIN settlements s ON s.settlement_id = p.settlement_id
            WHERE s.anomaly IN ('SPLIT', 'SPLIT_BARE', 'SPLIT_CHARGEBACK') AND s.n > 1 AND NOT (s.anomaly = 'SPLIT_CHARGEBACK' AND p.amount_minor = -s.adjustments_minor)""",
        "tranches": f"""
            SELECT t.settlement_id, sum(t.amount_minor) AS part FROM tranche_items t JOIN settlements s ON s.settlement_id = t.settlement_id WHERE t.pos <= {div("s.n", "2")} GROUP BY t.settlement_id""",
        "split_nets": f"""
            SELECT s.settlement_id, CAST({div("s.net_minor * CAST(t.part AS BIGINT)", "(s.gross_minor + s.adjustments_minor)")} AS BIGINT) + CASE WHEN 2 * ((s.net_minor * CAST(t.part AS BIGINT)) % (s.gross_minor + s.adjustments_minor)) >= s.gross_minor + s.adjustments_minor THEN 1 ELSE 0 END AS first_minor
            FROM settlements s JOIN tranches t ON t.settlement_id = s.settlement_id WHERE s.gross_minor + s.adjustments_minor > 0 AND s.net_minor > 0""",
        "credits": f"""
            SELECT concat('BNK-', s.settlement_id, '-1') AS txn_id, {add("settled_on", "1 + CASE anomaly WHEN 'TIMING' THEN 2 WHEN 'LATE' THEN 7 ELSE 0 END")} AS value_date,
                   CASE WHEN anomaly IN ('NO_REFERENCE', 'SPLIT_BARE') THEN concat('NEFT CR/', merchant_name, '/SETTLEMENT') ELSE concat('NEFT CR-', utr, '-', merchant_name) END AS narration,
                   coalesce(first_minor, net_minor + CASE WHEN anomaly = 'ROUNDING' THEN 1 + no % 3 ELSE 0 END) AS credit_minor, s.settlement_id
            FROM settlements s LEFT JOIN split_nets x ON x.settlement_id = s.settlement_id
            UNION ALL
            SELECT concat('BNK-', s.settlement_id, '-2'), {add("settled_on", "2")}, CASE WHEN anomaly = 'SPLIT_BARE' THEN concat('NEFT CR/', merchant_name, '/SETTLEMENT') ELSE concat('NEFT CR-', utr, '-', merchant_name) END, net_minor - first_minor, s.settlement_id FROM settlements s JOIN split_nets x ON x.settlement_id = s.settlement_id
            UNION ALL
            SELECT concat('BNK-', settlement_id, '-3'), {add("settled_on", "2")}, concat('NEFT CR-', utr, '-', merchant_name), net_minor, settlement_id FROM settlements WHERE anomaly = 'DUPLICATE'
            UNION ALL
            SELECT concat('BNK-', settlement_id, '-4'), {add("settled_on", "3")}, concat('IMPS CR/UTR', lpad(CAST(merchant_no % 1000000 AS VARCHAR(20)), 7, '9'), lpad(CAST(month_no AS VARCHAR(20)), 7, '0'), '/SUNDRY'), gross_minor + 777, CAST(NULL AS VARCHAR(40)) FROM settlements WHERE anomaly = 'ORPHAN'""",
        "bank": """
            SELECT txn_id, value_date, narration, credit_minor, CAST(0 AS BIGINT) AS debit_minor, settlement_id FROM credits
            UNION ALL
            SELECT concat('DBT-', CAST(o_orderkey AS VARCHAR(20))), CAST(o_orderdate AS DATE), 'ACH DR-VENDOR FEE', CAST(0 AS BIGINT), CAST(round(o_totalprice * 100) AS BIGINT), CAST(NULL AS VARCHAR(40)) FROM orders WHERE o_orderkey % 20 = 0""",
        "truth_links": f"""
            SELECT p.payment_id, CASE WHEN s.anomaly IN ('SPLIT', 'SPLIT_BARE', 'SPLIT_CHARGEBACK') AND t.pos > {div("s.n", "2")} THEN concat('BNK-', p.settlement_id, '-2') ELSE concat('BNK-', p.settlement_id, '-1') END AS txn_id, p.amount_minor, s.anomaly
            FROM payments p JOIN settlements s ON s.settlement_id = p.settlement_id LEFT JOIN tranche_items t ON t.payment_id = p.payment_id
            WHERE NOT (s.anomaly IN ('CHARGEBACK', 'SPLIT_CHARGEBACK') AND p.amount_minor = -s.adjustments_minor)""",
        "truth_records": """
            SELECT concat('payment:', p.payment_id) AS ref, CASE WHEN p.amount_minor = -s.adjustments_minor AND s.anomaly IN ('CHARGEBACK', 'SPLIT_CHARGEBACK') THEN 'EXCEPTION' ELSE 'MATCHED' END AS verdict,
                   CASE WHEN p.amount_minor = -s.adjustments_minor AND s.anomaly IN ('CHARGEBACK', 'SPLIT_CHARGEBACK') THEN 'CHARGEBACK' WHEN p.order_ref_raw IS NULL THEN 'NO_ORDER' ELSE 'CLEAN' END AS anomaly, p.amount_minor AS impact_minor
            FROM payments p JOIN settlements s ON s.settlement_id = p.settlement_id
            UNION ALL
            SELECT concat('settlement:', settlement_id), CASE WHEN anomaly = 'FEE_MISMATCH' OR anomaly = 'EXTERNAL_REFUND' AND adjustments_minor < 0 THEN 'EXCEPTION' ELSE 'MATCHED' END, CASE WHEN anomaly = 'EXTERNAL_REFUND' AND adjustments_minor = 0 THEN 'CLEAN' ELSE anomaly END, abs(net_minor) FROM settlements
            UNION ALL
            SELECT concat('bank:', b.txn_id), CASE WHEN b.settlement_id IS NULL THEN 'UNMATCHABLE' WHEN b.txn_id LIKE '%-3' THEN 'EXCEPTION' ELSE 'MATCHED' END, CASE WHEN b.settlement_id IS NULL THEN 'ORPHAN' WHEN b.txn_id LIKE '%-3' THEN 'DUPLICATE' WHEN s.anomaly IN ('ROUNDING', 'TIMING', 'NO_REFERENCE', 'SPLIT', 'LATE', 'SHARED_REFERENCE', 'SPLIT_BARE', 'SPLIT_CHARGEBACK') THEN s.anomaly ELSE 'CLEAN' END, b.credit_minor
            FROM bank b LEFT JOIN settlements s ON s.settlement_id = b.settlement_id WHERE b.credit_minor > 0""",
        "difficulties": """
            SELECT settlement_id, CASE WHEN anomaly IN ('SPLIT_BARE', 'SPLIT_CHARGEBACK', 'SHARED_REFERENCE') THEN 'HARD' WHEN anomaly IN ('CLEAN', 'EXTERNAL_REFUND', 'FEE_MISMATCH', 'ORPHAN') THEN 'EASY' ELSE 'STANDARD' END AS difficulty, year(settled_on) AS corpus FROM settlements""",
        "proposed": """
            SELECT concat('PROP-', t.txn_id) AS proposal_id, t.txn_id, p.settlement_id, t.payment_id, s.month_no % 9 AS kind, row_number() OVER (PARTITION BY t.txn_id ORDER BY t.payment_id) AS pos
            FROM truth_links t JOIN payments p ON p.payment_id = t.payment_id JOIN settlements s ON s.settlement_id = p.settlement_id""",
        "proposals": """
            SELECT proposal_id, CASE WHEN kind = 1 THEN concat(txn_id, '-X') WHEN kind = 2 THEN (SELECT min(txn_id) FROM bank WHERE debit_minor > 0) ELSE txn_id END AS txn_id, CASE WHEN kind = 6 THEN 'STL-0-0' WHEN kind >= 3 THEN settlement_id END AS settlement_id,
                   CASE WHEN kind = 4 AND pos = 1 THEN concat(payment_id, '-X') WHEN kind = 8 THEN NULL ELSE payment_id END AS payment_id
            FROM proposed WHERE NOT (kind = 7 AND pos = 2) AND NOT (kind = 8 AND pos > 1)
            UNION ALL
            SELECT proposal_id, txn_id, settlement_id, payment_id FROM proposed WHERE kind = 3 AND pos = 1
            UNION ALL
            SELECT proposal_id, txn_id, settlement_id, (SELECT min(payment_id) FROM payments) FROM proposed WHERE kind = 5 AND pos = 1""",
    }


def with_ctes(dialect: str, select: str, **more: str) -> str:
    ctes = corpus_ctes(dialect) | more
    start = next((x for x in ("WITH RECURSIVE ", "WITH ") if select.startswith(x)), "")
    own = ",\n" + select.removeprefix(start) if start else "\n" + select
    return (start or "WITH ") + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items()) + own


#: Tables that are written when first asked for, as the files of a source would be.
STORED = ("settlements", "bank", "statement")


class Corpus:
    """The derived tables of a folder as DataFrames, each made only when it is asked for, once in a session."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._made, self._paths = spark, folder, {}, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _planned(self, name: str) -> DataFrame:
        ctes = corpus_ctes("spark") | spark_ctes()
        names, inputs = [name], {}
        for n in names:  # grows while it is read
            names += [k for k in ctes if k not in names and k not in STORED and re.search(rf"\b(FROM|JOIN) {k}\b", ctes[n])]

        def with_inputs(body: str) -> str:
            for k in ("lineitem", "orders", *STORED):
                if k != name and re.search(rf"\b(FROM|JOIN) {k}\b", body):
                    inputs[k] = self.table(k) if k in ("lineitem", "orders") else getattr(self, k)
                    body = re.sub(rf"\b(FROM|JOIN) {k}\b", rf"\1 {{{k}}}", body)
            return body

        parts = [f"{n} AS ({with_inputs(ctes[n])})" for n in ctes if n in names]
        return self.spark.sql("WITH " + ", ".join(parts) + f" SELECT * FROM {name}", **inputs)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several queries start from, written when first asked for."""
        if name not in self._made:
            self._made[name] = stored(make(), name)
        return self._made[name]

    def keep(self, name: str, table: DataFrame) -> None:
        """A table that making another has written as well, for those that ask for it later."""
        self._made.setdefault(name, table)

    def path_once(self, name: str, make: Callable[[], str]) -> str:
        """A folder of files, written when first asked for."""
        if name not in self._paths:
            self._paths[name] = make()
        return self._paths[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            made = read_narrations(self.bank.drop("settlement_id"), fold_ascii) if name == "statement" else self._planned(name)
            self._made[name] = stored(made, name) if name in STORED else made
        return self._made[name]


@lru_cache(maxsize=16)
def _corpus(application: str, folder: str) -> Corpus:
    return Corpus(SparkSession.active(), folder)


def corpus(spark: SparkSession, folder: str) -> Corpus:
    return _corpus(spark.sparkContext.applicationId, folder)
