"""The ladder said in DuckDB's SQL, as named subqueries: tier by tier over what the tiers before it leave."""

from __future__ import annotations


def _common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts: a row of the table of prefixes for each letter of a."""
    start = f"list_transform(range(length({b}) + 1), lambda i: 0)"
    cells = f"list_transform(range(1, len(acc)), lambda j: [acc[j], acc[j + 1], CASE WHEN ord({b}[j]) = ch[1] THEN 1 ELSE 0 END])"
    row = f"list_reduce(list_prepend([0], {cells}), lambda r, x: list_append(r, greatest(x[2], r[len(r)], x[1] + x[3])))"
    return f"list_last(list_reduce(list_prepend({start}, list_transform(range(1, length({a}) + 1), lambda i: [ord({a}[i])])), lambda acc, ch: {row}))"


def _ratio(a: str, b: str) -> str:
    return f"2 * {_common(a, b)} / (length({a}) + length({b}))"


def name_score(name: str, pairs: str) -> dict[str, str]:
    """{name}: distinct pairs (a, b) of names of one word and the legal suffix, with score."""
    letters = lambda x: f"list_aggregate(list_transform(list_filter(range(1, length({x}) + 1), lambda i: i = 1 OR {x}[i] <> {x}[i - 1]), lambda i: {x}[i]), 'string_agg', '')"
    return {
        f"{name}_words": f"SELECT DISTINCT a, b, regexp_replace(a, ' PVT LTD$', '') AS wa, regexp_replace(b, ' PVT LTD$', '') AS wb FROM ({pairs})",
        f"{name}_bones": f"SELECT *, concat(wa[1], translate(wa[2:], 'AEIOU', '')) AS ca, concat(wb[1], translate(wb[2:], 'AEIOU', '')) AS cb FROM {name}_words",
        f"{name}_skeletons": f"SELECT a, b, wa, wb, {letters('ca')} AS sa, {letters('cb')} AS sb FROM {name}_bones",
        name: f"SELECT a, b, CAST(CASE WHEN wa = wb THEN 1 ELSE greatest({_ratio('sa', 'sb')}, {_ratio('wa', 'wb')}) END AS DOUBLE) AS score FROM {name}_skeletons",
    }


def partition(name: str, batch: str) -> dict[str, str]:
    """{name}: (settlement_id, verdict, payment_id, txn_id) of batches (settlement_id, net, txn_id, credit_minor) of two credits,
    by brute force: every set of a batch's payments against the larger credit."""
    share = lambda part: f"CAST({part} * net // whole + CASE WHEN {part} * net % whole > 0 AND {part} * net % whole >= (whole - {part}) * net % whole THEN 1 ELSE 0 END AS BIGINT)"
    return {
        f"{name}_keyed": f"SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY credit_minor DESC, txn_id) AS nth FROM ({batch})",
        f"{name}_batch": f"SELECT settlement_id, any_value(net) AS net, max(credit_minor) FILTER (nth = 1) AS first_minor, max(txn_id) FILTER (nth = 1) AS first_id, max(credit_minor) FILTER (nth = 2) AS second_minor, max(txn_id) FILTER (nth = 2) AS second_id FROM {name}_keyed GROUP BY settlement_id",
        f"{name}_own": "SELECT settlement_id, list(payment_id ORDER BY payment_id) AS ids, list(amount_minor ORDER BY payment_id) AS amounts, CAST(sum(amount_minor) AS BIGINT) AS whole FROM covered GROUP BY settlement_id",
        f"{name}_sets": f"SELECT b.*, ids, amounts, whole, unnest(range(1, 1 << len(ids))) AS mask FROM {name}_batch b JOIN {name}_own USING (settlement_id)",
        f"{name}_sums": f"SELECT *, CAST(list_sum(list_transform(range(len(ids)), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN amounts[i + 1] ELSE 0 END)) AS BIGINT) AS part FROM {name}_sets",
        f"{name}_valued": f"SELECT *, CASE WHEN part >= whole THEN net ELSE {share('part')} END AS expected, CASE WHEN part <= 0 THEN net ELSE {share('(whole - part)')} END AS rest FROM {name}_sums",
        f"{name}_fits": f"SELECT settlement_id, count(*) AS n, min(mask) AS mask, bool_and(part < whole AND abs(rest - second_minor) <= 300) AS closes FROM {name}_valued WHERE abs(expected - first_minor) <= 300 GROUP BY settlement_id",
        f"{name}_verdicts": f"SELECT b.*, ids, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 AND closes THEN 'UNIQUE' ELSE 'FAILED' END AS verdict, mask FROM {name}_batch b JOIN {name}_own USING (settlement_id) LEFT JOIN {name}_fits USING (settlement_id)",
        name: f"""SELECT settlement_id, verdict, ids[i + 1] AS payment_id, CASE WHEN (mask >> i) & 1 = 1 THEN first_id ELSE second_id END AS txn_id FROM (SELECT *, unnest(range(len(ids))) AS i FROM {name}_verdicts WHERE verdict = 'UNIQUE')
            UNION ALL SELECT settlement_id, verdict, NULL, CASE WHEN verdict = 'AMBIGUOUS' THEN first_id END FROM {name}_verdicts WHERE verdict <> 'UNIQUE'""",
    }


def split_batches(settlements: str, pool: str) -> str:
    """Settlements of two or more keyed credits that come to their net."""
    return f"SELECT * FROM (SELECT s.settlement_id, s.net_minor AS net, c.txn_id, c.credit_minor, count(*) OVER w AS n, sum(c.credit_minor) OVER w AS total FROM {settlements} s JOIN {pool} c ON c.utr = s.utr WINDOW w AS (PARTITION BY s.settlement_id)) WHERE n > 1 AND abs(total - net) <= 300 AND net > 0"


def assigned(name: str, settlements: str, claimants: str, pool: str) -> dict[str, str]:
    """{name}_near: every near pair by name, with score; {name}: tier 3's links and refusals."""
    return {
        f"{name}_pairs": f"""SELECT s.settlement_id, c.txn_id, s.net_minor, c.credit_minor, c.merchant AS a, p.spelling AS b FROM {claimants} s JOIN {pool} c ON c.utr IS NULL AND c.merchant IS NOT NULL AND abs(c.credit_minor - s.net_minor) <= greatest(100, (abs(s.net_minor) * 50 + 9999) // 10000) AND abs(c.value_date - s.settled_on) <= 7
            JOIN profiles p ON p.merchant_id = s.merchant_id WHERE s.net_minor > 0""",
        **name_score(f"{name}_scores", f"SELECT a, b FROM {name}_pairs"),
        f"{name}_near": f"SELECT settlement_id, txn_id, net_minor, credit_minor, max(score) AS score FROM {name}_pairs JOIN {name}_scores USING (a, b) GROUP BY ALL",
        f"{name}_every": f"SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY score DESC, txn_id) AS place, count(*) OVER (PARTITION BY txn_id) AS claims, row_number() OVER (PARTITION BY txn_id ORDER BY score DESC, settlement_id) AS nth FROM {name}_near WHERE score >= 0.9",
        f"{name}_best": f"""SELECT e.*, (SELECT max(o.score) FROM {name}_every o WHERE o.settlement_id = e.settlement_id AND o.place = 2) AS second, (SELECT max(o.score) FROM {name}_every o WHERE o.txn_id = e.txn_id AND o.nth = CASE WHEN e.nth = 1 THEN 2 ELSE 1 END) AS rival FROM {name}_every e WHERE place = 1""",
        name: f"""SELECT settlement_id, txn_id, 3 AS tier, CASE WHEN coalesce(score - second < 0.05, false) THEN score / 2 WHEN coalesce(score - rival < 0.05, false) THEN score / claims WHEN credit_minor <> net_minor THEN score / 2 ELSE score END AS p,
            CASE WHEN coalesce(score - second < 0.05, false) OR coalesce(score - rival < 0.05, false) THEN 'CONTESTED' WHEN credit_minor <> net_minor THEN 'INEXACT' ELSE 'LINKED' END AS outcome
            FROM {name}_best WHERE settlement_id IN (SELECT settlement_id FROM {settlements} WHERE utr NOT IN (SELECT utr FROM credit WHERE utr IS NOT NULL))""",
    }


def completed(name: str, settlements: str, pool: str) -> dict[str, str]:
    """{name}: the partition of settlements over the only set of their merchant's unreferenced credits that sums to the net."""
    return {
        f"{name}_offers": f"""SELECT DISTINCT s.settlement_id, s.net_minor, c.txn_id, c.credit_minor FROM {settlements} s JOIN profiles p ON p.merchant_id = s.merchant_id JOIN {pool} c ON c.utr IS NULL AND c.merchant = p.spelling AND abs(c.value_date - s.settled_on) <= 7 AND c.credit_minor <= s.net_minor
            WHERE s.net_minor > 0 AND s.utr NOT IN (SELECT utr FROM {pool} WHERE utr IS NOT NULL)""",
        f"{name}_pools": f"SELECT settlement_id, net_minor, list(txn_id ORDER BY txn_id) AS ids, list(credit_minor ORDER BY txn_id) AS amounts FROM {name}_offers GROUP BY settlement_id, net_minor HAVING count(*) BETWEEN 2 AND 40",
        f"{name}_masks": f"SELECT *, unnest(range(1, 1 << len(ids))) AS mask FROM {name}_pools",
        f"{name}_found": f"SELECT settlement_id, net_minor, ids, amounts, min(mask) AS mask FROM {name}_masks WHERE (mask & (mask - 1)) <> 0 AND list_sum(list_transform(range(len(ids)), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN amounts[i + 1] ELSE 0 END)) = net_minor GROUP BY ALL HAVING count(*) = 1",
        f"{name}_tranches": f"SELECT settlement_id, net_minor AS net, ids[i + 1] AS txn_id, amounts[i + 1] AS credit_minor FROM (SELECT *, unnest(range(len(ids))) AS i FROM {name}_found) WHERE (mask >> i) & 1 = 1",
        **partition(name, f"SELECT * FROM {name}_tranches"),
    }


CTES = {
    "claw": "SELECT s.settlement_id, count(p.payment_id) AS hits, min(p.payment_id) AS payment_id FROM settlements s LEFT JOIN payments p ON p.settlement_id = s.settlement_id AND p.amount_minor = -s.adjustments_minor WHERE s.adjustments_minor < 0 GROUP BY s.settlement_id",
    "covered": "SELECT settlement_id, payment_id, amount_minor FROM payments WHERE payment_id NOT IN (SELECT payment_id FROM claw WHERE hits = 1)",
    "profiles": "SELECT DISTINCT s.merchant_id, c.merchant AS spelling FROM settlements s JOIN credit c ON c.utr = s.utr WHERE c.merchant IS NOT NULL",
    "t1_keyed": "SELECT s.settlement_id, c.txn_id, s.net_minor, s.settled_on, c.credit_minor, count(DISTINCT s.settlement_id) OVER (PARTITION BY s.utr) AS peers, greatest(100, (abs(s.net_minor) * 50 + 9999) // 10000) AS band, c.value_date FROM left_settlements s JOIN left_pool c ON c.utr = s.utr",
    "t1_judged": "SELECT *, abs(credit_minor - net_minor) <= band AND abs(value_date - settled_on) <= 3 AS fits FROM t1_keyed",
    "t1_counted": "SELECT *, count(*) OVER (PARTITION BY settlement_id) AS n_keyed, count(*) FILTER (fits) OVER (PARTITION BY settlement_id) AS n_fit FROM t1_judged",
    "t1_clear": """SELECT *, (SELECT count(*) FROM left_pool r WHERE r.utr IS NULL AND abs(r.credit_minor - k.net_minor) <= k.band AND abs(r.value_date - k.settled_on) <= 3) AS rivals FROM t1_counted k WHERE fits AND (peers > 1 OR NOT (n_keyed > 1 AND n_fit <= 1)
            AND NOT (n_fit = 1 AND net_minor > credit_minor AND EXISTS (SELECT 1 FROM left_pool r WHERE r.credit_minor = k.net_minor - k.credit_minor AND r.txn_id <> k.txn_id)))""",
    "t1": "SELECT settlement_id, txn_id, 1 AS tier, 1.0 / CASE WHEN peers > 1 THEN peers ELSE n_fit + rivals END AS p, CASE WHEN peers > 1 THEN 'COLLISION' WHEN n_fit + rivals = 1 THEN 'LINKED' ELSE 'RIVALS' END AS outcome FROM t1_clear",
    "open1": "SELECT * FROM left_settlements WHERE settlement_id NOT IN (SELECT settlement_id FROM t1)",
    "pool1": "SELECT * FROM left_pool WHERE txn_id NOT IN (SELECT txn_id FROM t1 WHERE outcome = 'LINKED')",
    **partition("t2", split_batches("open1", "pool1")),
    "open2": "SELECT * FROM open1 WHERE settlement_id NOT IN (SELECT settlement_id FROM t2 WHERE verdict <> 'FAILED')",
    "pool2": "SELECT * FROM pool1 WHERE txn_id NOT IN (SELECT txn_id FROM t2 WHERE verdict = 'UNIQUE')",
    "claimants2": "SELECT * FROM settlements WHERE settlement_id NOT IN (SELECT settlement_id FROM t0 WHERE outcome = 'LINKED' UNION ALL SELECT settlement_id FROM t1 WHERE outcome = 'LINKED' UNION ALL SELECT settlement_id FROM t2 WHERE verdict = 'UNIQUE')",
    **assigned("t3", "open2", "claimants2", "pool2"),
    "open3": "SELECT * FROM open2 WHERE settlement_id NOT IN (SELECT settlement_id FROM t3)",
    "pool3": "SELECT * FROM pool2 WHERE txn_id NOT IN (SELECT txn_id FROM t3 WHERE outcome = 'LINKED')",
    **completed("sc", "open3", "pool3"),
    "gross": "SELECT settlement_id, sum(amount_minor) AS paid FROM payments GROUP BY settlement_id",
    "reconciled": "SELECT s.settlement_id, coalesce(g.paid = s.gross_minor, false) AND s.settlement_id NOT IN (SELECT settlement_id FROM claw WHERE hits > 1) AS verified FROM settlements s LEFT JOIN gross g USING (settlement_id)",
    "run_links": "SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t3 UNION ALL SELECT settlement_id, txn_id, 2, 0.5, verdict FROM t2 WHERE verdict = 'AMBIGUOUS'",
    "run_rows": """SELECT o.payment_id, o.amount_minor, l.txn_id, l.settlement_id, l.tier, l.p, l.outcome, r.verified AND (l.tier < 2 OR l.outcome = 'LINKED') AS verified FROM run_links l JOIN covered o USING (settlement_id) JOIN reconciled r USING (settlement_id)
            UNION ALL SELECT payment_id, amount_minor, txn_id, t.settlement_id, 2, 1.0, 'LINKED', true FROM (SELECT * FROM t2 UNION ALL SELECT * FROM sc) t JOIN covered o USING (payment_id) WHERE verdict = 'UNIQUE'""",
    "run_cells": "SELECT w.*, c.credit_minor, CAST(c.credit_minor AS HUGEINT) * amount_minor AS scaled, sum(amount_minor) OVER (PARTITION BY settlement_id, txn_id) AS whole FROM run_rows w JOIN credit c USING (txn_id)",
    "run_dealt": "SELECT *, scaled // whole AS part, row_number() OVER (PARTITION BY settlement_id, txn_id ORDER BY scaled % whole DESC, payment_id) AS place, sum(scaled // whole) OVER (PARTITION BY settlement_id, txn_id) AS given FROM run_cells",
    "run": "SELECT payment_id, txn_id, settlement_id, tier, CAST(p AS DOUBLE) AS p, outcome, CAST(part + CASE WHEN place <= credit_minor - given THEN 1 ELSE 0 END AS BIGINT) AS share_minor, verified, CASE WHEN p >= 0.95 AND verified THEN 'AUTO_MATCHED' WHEN p > 0.6 THEN 'NEEDS_REVIEW' ELSE 'EXCEPTION' END AS decision FROM run_dealt",
}
