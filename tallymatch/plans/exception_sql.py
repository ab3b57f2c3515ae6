"""The queue of exceptions said in DuckDB's SQL, over the ladder's subqueries."""

from __future__ import annotations

_PIECE = "concat_ws(':', '{}', {}, CAST({} AS BIGINT))".format
_KEYED = _PIECE("EXACT_KEY", "concat('bank:', txn_id)", "credit_minor")
_SAID = "list(concat_ws(':', 'RULING', concat('{0}:', {1}), CAST(round(p * 1000000) AS BIGINT)) ORDER BY p DESC, {1})".format

CTES = {
    "auto": "SELECT * FROM run WHERE decision = 'AUTO_MATCHED'",
    "free": "SELECT * FROM credit WHERE txn_id NOT IN (SELECT txn_id FROM auto)",
    "said": "SELECT settlement_id, txn_id, max(p) AS p FROM run GROUP BY ALL",
    "said_s": f"SELECT settlement_id, {_SAID('bank', 'txn_id')} AS said FROM said GROUP BY settlement_id",
    "said_c": f"SELECT txn_id, {_SAID('settlement', 'settlement_id')} AS said FROM said GROUP BY txn_id",
    "doubtful": "SELECT settlement_id, count(*) AS n_hypotheses FROM said WHERE settlement_id IN (SELECT settlement_id FROM run WHERE outcome = 'AMBIGUOUS') GROUP BY settlement_id",
    "unsettled": "SELECT *, greatest(100, (abs(net_minor) * 50 + 9999) // 10000) AS band FROM (SELECT *, settlement_id IN (SELECT settlement_id FROM auto) AS credited, net_minor - (gross_minor - fee_minor - tax_minor + adjustments_minor) AS net_delta FROM settlements) WHERE NOT credited OR net_delta <> 0",
    "bearing": f"SELECT u.settlement_id, count(*) AS n_keyed, CAST(sum(credit_minor) AS BIGINT) AS keyed_minor, CAST(min((value_date, txn_id))[1] - any_value(u.settled_on) AS INTEGER) AS keyed_gap, min((value_date, txn_id))[2] AS keyed_id, list({_KEYED} ORDER BY value_date, txn_id) AS keyed FROM unsettled u JOIN free c ON c.utr = u.utr WHERE NOT credited GROUP BY u.settlement_id",
    "about": "SELECT u.settlement_id, count(*) AS n_near, bool_or(abs(c.value_date - u.settled_on) <= 3) AS in_time FROM unsettled u JOIN free c ON c.credit_minor BETWEEN u.net_minor - u.band AND u.net_minor + u.band WHERE NOT credited GROUP BY u.settlement_id",
    "settlement_facts": """SELECT u.settlement_id, u.settled_on, u.net_minor, u.net_delta, w.hits, CASE WHEN w.hits = 1 THEN w.payment_id END AS excluded_id, -u.adjustments_minor AS owed, coalesce(n_keyed, 0) AS n_keyed, keyed_minor, keyed_gap, keyed_id, keyed, coalesce(n_near, 0) AS n_near, coalesce(in_time, false) AS in_time, said, n_hypotheses,
            CASE WHEN n_hypotheses >= 2 THEN 'E_AMBIGUOUS_AGGREGATION' WHEN n_hypotheses IS NOT NULL THEN 'E_UNKNOWN_RESIDUAL' WHEN net_delta <> 0 THEN 'E_FEE_TAX_MISMATCH' WHEN w.hits = 1 THEN 'E_CHARGEBACK_NETTED' WHEN w.hits IS NOT NULL THEN 'E_POST_SETTLEMENT_REFUND' WHEN n_keyed > 1 THEN 'E_SPLIT_PAYOUT_INCOMPLETE'
            WHEN n_keyed = 1 AND keyed_minor < net_minor THEN 'E_POST_SETTLEMENT_REFUND' WHEN n_keyed = 1 AND abs(keyed_gap) > 3 THEN 'E_TIMING_SHIFT' WHEN n_keyed = 1 THEN 'E_UNKNOWN_RESIDUAL' WHEN n_near > 0 AND NOT in_time THEN 'E_TIMING_SHIFT' WHEN n_near > 0 THEN 'E_MISSING_REFERENCE' ELSE 'E_LATE_ARRIVAL' END AS class
            FROM unsettled u LEFT JOIN claw w USING (settlement_id) LEFT JOIN bearing USING (settlement_id) LEFT JOIN about USING (settlement_id) LEFT JOIN said_s USING (settlement_id) LEFT JOIN doubtful USING (settlement_id)""",
    "queue_settlements": f"""SELECT concat('settlement:', settlement_id) AS ref, class, CASE WHEN class = 'E_FEE_TAX_MISMATCH' THEN abs(net_delta) ELSE abs(net_minor) END AS impact_minor, settled_on AS as_of, CASE WHEN class = 'E_CHARGEBACK_NETTED' THEN excluded_id ELSE keyed_id END AS counterpart, keyed_gap AS day_gap,
            CAST(2 + CASE WHEN excluded_id IS NULL THEN 0 ELSE 1 END + n_keyed + coalesce(len(said), 0) AS BIGINT) AS n_evidence,
            list_concat([{_PIECE('ARITHMETIC_CHECK', "concat('settlement:', settlement_id)", 'net_minor')}, {_PIECE('NEGATIVE_EVIDENCE', "concat('settlement:', settlement_id)", 'n_keyed + n_near')}], CASE WHEN excluded_id IS NULL THEN [] ELSE [{_PIECE('ARITHMETIC_CHECK', "concat('payment:', excluded_id)", 'owed')}] END, coalesce(keyed, []), coalesce(said, [])) AS evidence,
            n_hypotheses FROM settlement_facts""",
    "bearers": "SELECT * FROM credit WHERE utr IS NOT NULL",
    "twins": f"SELECT a.txn_id, list({_PIECE('EXACT_KEY', "concat('bank:', b.txn_id)", 'b.credit_minor')} ORDER BY b.value_date, b.txn_id) AS twins, list(b.txn_id ORDER BY b.value_date, b.txn_id) AS ids, bool_or(a.credit_minor = b.credit_minor) AS alike FROM bearers a JOIN bearers b ON a.utr = b.utr AND a.txn_id <> b.txn_id GROUP BY a.txn_id",
    "owners": f"SELECT utr, list({_PIECE('EXACT_KEY', "concat('settlement:', settlement_id)", 'net_minor')} ORDER BY settlement_id) AS owners, min(settlement_id) AS first_owner FROM settlements GROUP BY utr",
    "credit_facts": """SELECT c.*, r.original_id, CAST(c.value_date - o.value_date AS INTEGER) AS reposted_gap, t.twins, t.ids, w.owners, w.first_owner, s.said,
            CASE WHEN r.original_id IS NOT NULL THEN 'E_DUPLICATE_CREDIT' WHEN w.utr IS NOT NULL AND alike THEN 'E_DUPLICATE_CREDIT' WHEN w.utr IS NOT NULL AND t.txn_id IS NOT NULL THEN 'E_SPLIT_PAYOUT_INCOMPLETE' WHEN w.utr IS NOT NULL THEN 'E_UNKNOWN_RESIDUAL' WHEN c.utr IS NOT NULL THEN 'E_ORPHAN_BANK_CREDIT'
            WHEN c.merchant IN (SELECT spelling FROM profiles) THEN 'E_MISSING_REFERENCE' WHEN c.merchant IS NULL THEN 'UNMATCHABLE' ELSE 'E_ORPHAN_BANK_CREDIT' END AS class
            FROM free c LEFT JOIN reposted r ON r.txn_id = c.txn_id LEFT JOIN credit o ON o.txn_id = r.original_id LEFT JOIN twins t ON t.txn_id = c.txn_id LEFT JOIN owners w ON w.utr = c.utr LEFT JOIN said_c s ON s.txn_id = c.txn_id""",
    "queue_credits": f"""SELECT concat('bank:', txn_id) AS ref, class, credit_minor AS impact_minor, value_date AS as_of, coalesce(original_id, ids[1], first_owner) AS counterpart, CASE WHEN original_id IS NOT NULL THEN reposted_gap WHEN class = 'E_SPLIT_PAYOUT_INCOMPLETE' THEN 0 END AS day_gap,
            CAST(2 + CASE WHEN original_id IS NULL THEN 0 ELSE 1 END + coalesce(len(twins), 0) + coalesce(len(owners), 0) + coalesce(len(said), 0) AS BIGINT) AS n_evidence,
            list_concat([{_PIECE('AMOUNT_MATCH', "concat('bank:', txn_id)", 'credit_minor')}, concat_ws(':', 'NEGATIVE_EVIDENCE', coalesce(utr, ''))], CASE WHEN original_id IS NULL THEN [] ELSE [{_PIECE('EXACT_KEY', "concat('bank:', original_id)", 'credit_minor')}] END, coalesce(twins, []), coalesce(owners, []), coalesce(said, [])) AS evidence,
            CAST(NULL AS BIGINT) AS n_hypotheses FROM credit_facts""",
    "queue_payments": f"""SELECT concat('payment:', p.payment_id) AS ref, CASE WHEN w.payment_id IS NULL THEN 'E_UNKNOWN_RESIDUAL' ELSE 'E_CHARGEBACK_NETTED' END AS class, p.amount_minor AS impact_minor, s.settled_on AS as_of, p.settlement_id AS counterpart, CAST(NULL AS INTEGER) AS day_gap, CAST(CASE WHEN w.payment_id IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n_evidence,
            list_concat([{_PIECE('NEGATIVE_EVIDENCE', "concat('payment:', p.payment_id)", 'p.amount_minor')}], CASE WHEN w.payment_id IS NULL THEN [] ELSE [{_PIECE('ARITHMETIC_CHECK', "concat('settlement:', p.settlement_id)", 'p.amount_minor')}] END) AS evidence, CAST(NULL AS BIGINT) AS n_hypotheses
            FROM payments p JOIN settlements s ON s.settlement_id = p.settlement_id LEFT JOIN claw w ON w.hits = 1 AND w.payment_id = p.payment_id WHERE p.settlement_id IN (SELECT settlement_id FROM auto) AND p.payment_id NOT IN (SELECT payment_id FROM auto)""",
    "origins": "SELECT order_ref AS order_id, max(settlement_id) AS origin FROM refs WHERE order_ref IS NOT NULL GROUP BY order_ref",
    "returned": "SELECT s.settlement_id, s.settled_on, -s.adjustments_minor AS owed, l.order_id, o.origin FROM settlements s JOIN claw w ON w.settlement_id = s.settlement_id AND w.hits = 0 JOIN ledger l ON l.status = 'REFUNDED' AND l.amount_minor = -s.adjustments_minor JOIN origins o ON o.order_id = l.order_id JOIN settlements b ON b.settlement_id = o.origin WHERE o.origin <> s.settlement_id AND b.settled_on <= s.settled_on",
    "queue_refunds": f"""SELECT CASE WHEN count(*) = 1 THEN concat('order:', min(order_id)) ELSE concat('settlement:', settlement_id) END AS ref, 'E_POST_SETTLEMENT_REFUND' AS class, any_value(owed) AS impact_minor, any_value(settled_on) AS as_of,
            coalesce((list(origin ORDER BY order_id) FILTER (origin IN (SELECT settlement_id FROM auto)))[1], settlement_id) AS counterpart, CAST(NULL AS INTEGER) AS day_gap, CAST(1 + count(*) + count(*) FILTER (origin IN (SELECT settlement_id FROM auto)) AS BIGINT) AS n_evidence,
            list_concat([{_PIECE('ARITHMETIC_CHECK', "concat('settlement:', settlement_id)", '-any_value(owed)')}], list({_PIECE('AMOUNT_MATCH', "concat('order:', order_id)", 'owed')} ORDER BY order_id), coalesce(list({_PIECE('EXACT_KEY', "concat('settlement:', origin)", 'owed')} ORDER BY order_id) FILTER (origin IN (SELECT settlement_id FROM auto)), [])) AS evidence, CAST(NULL AS BIGINT) AS n_hypotheses
            FROM returned GROUP BY settlement_id""",
    "queue": """SELECT q.*, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + least(3, CASE WHEN impact_minor >= 10000000 THEN 3 WHEN impact_minor >= 1000000 THEN 2 WHEN impact_minor >= 100000 THEN 1 ELSE 0 END + CASE WHEN age_days >= 14 THEN 1 ELSE 0 END)] AS severity,
            CAST(CASE WHEN class = 'E_UNKNOWN_RESIDUAL' THEN 0.30 WHEN class IN ('E_FEE_TAX_MISMATCH', 'E_DUPLICATE_CREDIT', 'E_CHARGEBACK_NETTED', 'E_AMBIGUOUS_AGGREGATION', 'UNMATCHABLE') THEN 1.0 WHEN n_evidence >= 3 THEN 0.90 ELSE 0.75 END AS DOUBLE) AS confidence,
            class = 'E_DUPLICATE_CREDIT' OR class = 'E_TIMING_SHIFT' AND coalesce(abs(day_gap) <= 5, false) AS resolvable
            FROM (SELECT *, CAST(greatest(0, (SELECT greatest((SELECT max(value_date) FROM credit), (SELECT max(settled_on) FROM settlements))) - as_of) AS INTEGER) AS age_days FROM (SELECT * FROM queue_settlements UNION ALL SELECT * FROM queue_credits UNION ALL SELECT * FROM queue_payments UNION ALL SELECT * FROM queue_refunds)) q""",
}
