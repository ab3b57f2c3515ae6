"""The same results in SQL, for the queries that SQL can express."""

from __future__ import annotations

from .mixing import SEED
from .quality_rules import GRID

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _number(text: str, n: str) -> str:
    return f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) % ({n})"


def _apportioned(name: str, parties: str, by: str, party: str, votes: str, house: str) -> str:
    """Tables that end in name: parties with seats, by the rank of each party's quotients."""
    of, rounded = f"PARTITION BY {by}", lambda h: f"CAST(floor({votes} * ({h}) / greatest(every, 1) + 0.5) AS BIGINT)"
    return f"""{name}_n AS (SELECT *, count(*) OVER ({of}) AS n, sum({votes}) OVER ({of}) AS every FROM {parties}),
{name}_asks AS (SELECT *, unnest(range(1, 1 + least(most, {rounded(f"{house} + n / 2")} + 1))) AS k FROM {name}_n),
{name}_seats AS (SELECT {by}, {party}, count(*) AS seats FROM (SELECT *, row_number() OVER ({of} ORDER BY {votes} / (2 * k - 1) DESC, {party}, k) AS place FROM {name}_asks) WHERE place <= {house} GROUP BY {by}, {party}),
{name} AS (SELECT p.*, coalesce(s.seats, 0) AS seats FROM {parties} p LEFT JOIN {name}_seats s ON s.{by} = p.{by} AND s.{party} = p.{party})"""


MIXING = f"""
WITH rows AS (SELECT doc_id, source, md5(coalesce(text, '')) AS content, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS whole FROM sources),
ordered AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights, sum(weight) OVER () AS all_weights FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, cap <= weight * ((whole - caps) / (all_weights - weights)) AS stops FROM ordered),
level AS (SELECT (any_value(whole) - coalesce(sum(cap) FILTER (stops), 0)) / sum(weight) FILTER (NOT stops) AS level FROM stopped),
targets AS (SELECT 1 AS mix, source, nth, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target, 3 * CAST(ceil(source_size / 32) AS BIGINT) AS most, CAST(floor(whole / 32 + 0.5) AS BIGINT) AS house FROM stopped, level),
{_apportioned("given", "targets", "mix", "nth", "target", "house")},
dealt AS (SELECT r.*, g.nth, g.source_size, g.target, g.seats AS source_seats, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', content)) AS digest FROM rows r JOIN given g ON g.source IS NOT DISTINCT FROM r.source),
placed AS (SELECT *, CAST(concat('0x', substr(digest, 1, 8)) AS BIGINT) % greatest(1, least(65536, CAST(ceil(source_size / 262144) AS BIGINT))) AS shard FROM dealt),
shards AS (SELECT nth, shard, any_value(source_seats) AS source_seats, CAST(sum(size) AS BIGINT) AS shard_size, 3 * CAST(ceil(sum(size) / 32) AS BIGINT) AS most FROM placed GROUP BY nth, shard),
{_apportioned("shared", "shards", "nth", "shard", "shard_size", "source_seats")},
summed AS (SELECT p.*, sum(size) OVER (PARTITION BY p.nth, p.shard ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place, s.seats, greatest(1, CAST(ceil(s.shard_size / 32) AS BIGINT)) AS n_blocks FROM placed p JOIN shared s ON s.nth = p.nth AND s.shard = p.shard),
chosen AS (SELECT *, seats // n_blocks AS repeats, seats % n_blocks AS extra, {_number(f"concat('{SEED}:', coalesce(source, chr(0)), ':', CAST(shard AS VARCHAR))", "n_blocks")} AS start FROM summed),
cuts AS (SELECT *, unnest([place, place + size]) AS x, unnest([-1, 1]) AS sign FROM chosen),
blocks AS (SELECT *, unnest([x // 32, x // 32 + 1]) AS b, unnest([0, 1]) AS side FROM cuts),
counted AS (SELECT *, CASE WHEN b + start <= n_blocks THEN (b + start) * extra // n_blocks - start * extra // n_blocks ELSE extra - start * extra // n_blocks + (b + start - n_blocks) * extra // n_blocks END AS c FROM blocks),
upto AS (SELECT doc_id, source, size, source_size, target, repeats, sign, 32 * min(c) FILTER (side = 0) + (x % 32) * CASE WHEN x // 32 < n_blocks THEN min(c) FILTER (side = 1) - min(c) FILTER (side = 0) ELSE 0 END AS words FROM counted GROUP BY doc_id, source, size, source_size, target, repeats, sign, x, n_blocks)
SELECT doc_id, source, size, source_size, target, CAST(any_value(repeats) * size + sum(sign * words) AS BIGINT) AS taken FROM upto GROUP BY doc_id, source, size, source_size, target"""

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id"""

_SCORES = {"symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "brevity": "1.0 / greatest(n_words, 1)"}
_TESTS = " UNION ALL ".join(f"SELECT lang, '{rule}' AS rule, {i} AS nth, {cut} AS cut, count(*) AS n, count(*) FILTER ({_SCORES[rule]} > {cut}) AS k FROM good GROUP BY lang" for rule, cuts in GRID.items() for i, cut in enumerate(cuts))
_RATE = 0.04 / len(GRID)

QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
facts AS (SELECT w.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
good AS (SELECT f.* FROM facts f JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) l USING (doc_id)),
tests AS ({_TESTS}),
judged AS (SELECT *, k <= n * {_RATE} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RATE}) + (n - j) * ln(1 - {_RATE}))) FROM range(k + 1) x(j)) <= 0.05 / ({len(GRID)} * (SELECT count(DISTINCT coalesce(lang, '')) FROM good)) AS passed FROM tests),
certified AS (SELECT lang, rule, min(cut) AS cut FROM (SELECT *, bool_and(passed) OVER (PARTITION BY lang, rule ORDER BY nth) AS so_far FROM judged) WHERE so_far GROUP BY lang, rule),
scored AS (SELECT doc_id, lang, unnest({list(_SCORES)!r}) AS rule, unnest([{", ".join(_SCORES.values())}]) AS score FROM facts),
rejected AS (SELECT DISTINCT doc_id FROM scored s JOIN certified c ON c.rule = s.rule AND c.lang IS NOT DISTINCT FROM s.lang WHERE score > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM facts"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2, CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES = {"op6_mixing": MIXING, "op8_ngram_join": NGRAM_JOIN, "op9_quality_rules": QUALITY, "op13_fill_in_middle": FILL_IN_MIDDLE}
