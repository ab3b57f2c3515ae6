"""Secrets in texts: patterns for known shapes, and a battery of randomness tests for what has no known shape."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. Letters of the keywords count in either case, spelt out as ASCII alone.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings to infer, the first that fits: name, pattern that the whole candidate must have, alphabet.
ENCODINGS = (
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", _UPPER + _UPPER.lower() + "0123456789"),
    ("base64", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", _UPPER + _UPPER.lower() + "0123456789+/"),
    ("base64url", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+$", _UPPER + _UPPER.lower() + "0123456789-_"),
)
#: Structure that the tests must rule out: letters' collisions so many times the uniform rate, half the uniform rate of
#: changes between the alphabet's halves (or as much above it), and this correlation of neighbours.
COLLISIONS, CHANGES, CORRELATION = 2.0, 0.5, 0.6
#: Lengths from which a band of candidates has its own control, and the steps of -log10 p that it counts in.
BANDS, STEPS = (20, 28, 40, 64), 20
#: Code points of a text that redact takes at once.
CHUNK = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What an aggregate has gathered after each item, an array of the SQL type kind.

    Items are taken in blocks of about the square root of their number: no array grows past a block, or past the number of
    blocks, while it is built item by item, so that hundreds of thousands of items cost little more than their count.
    """
    empty = F.array().cast(f"array<{kind}>")

    def inner(at: Column, block: Column) -> Column:
        grow = lambda acc, x: let(step(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), grow)

    def outer(items: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"), F.lit(1))
        starts = F.filter(F.sequence(F.lit(0), F.size(items), n), lambda i: i < F.size(items))
        grow = lambda acc, i: let(inner(acc["at"], F.slice(items, i + 1, n)), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.flatten(F.aggregate(starts, F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), grow, lambda acc: acc["out"]))

    return let(items, outer)


def _found(text: Column, pattern: str, kind: str, longest: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, kind, value>>, offsets in code points.

    Split and extract see the same matches, so each match starts where all pieces and matches before it end.
    longest: a group that must have six characters or more.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match)).alias("before"), match.alias("match"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(longest)) if longest else match).alias("value"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string>>")
    sized = F.transform(zipped, lambda x: F.struct(F.char_length(x["before"]).cast("long").alias("gap"), F.char_length(x["match"]).cast("long").alias("length"), x["value"].alias("value")))
    ends = scan(sized, F.lit(0).cast("long"), lambda at, x: at + x["gap"] + x["length"], "bigint")
    spans = F.zip_with(sized, ends, lambda x, end: F.struct((end - x["length"]).alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["value"].alias("value")))
    if longest:
        spans = F.filter(spans, lambda x: F.char_length(x["value"]) >= 6)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by the rational approximation 26.2.17 of Abramowitz and Stegun."""

    def value(x: Column) -> Column:
        poly = x["t"] * (0.319381530 + x["t"] * (-0.356563782 + x["t"] * (1.781477937 + x["t"] * (-1.821255978 + x["t"] * 1.330274429))))
        tail = F.exp(-x["z"] * x["z"] / 2) * 0.3989422804014327 * poly
        return F.when(x["z"] < 0, tail).otherwise(1 - tail)

    bound = F.transform(F.array(z.cast("double")), lambda z: F.struct(z.alias("z"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t")))
    return F.get(F.transform(bound, value), 0)


def _with(array: Column, **fields) -> Column:
    """An array of structs with more fields, each a function of the struct; one step, so that none is worked out twice."""
    return F.transform(array, lambda x: reduce(lambda out, f: out.withField(f[0], f[1](x)), fields.items(), x))


def battery(spans: Column) -> Column:
    """Spans with a value, of which those that fit an encoding stay, with encoding, n, p_uniform, p_runs, p_serial and p.

    Each p-value is for the hypothesis that the value has structure as large as COLLISIONS, CHANGES or CORRELATION, so a
    small one is evidence of randomness, and longer values can give more. p is the largest: all three must be ruled out.
    p_uniform rests on the chi-squared statistic m/n * sum(c^2) - n, as the number of pairs of equal symbols in it.
    """
    names, alphabets = (F.array(*map(F.lit, x)) for x in (tuple(e[0] for e in ENCODINGS), tuple(e[2] for e in ENCODINGS)))
    fits = lambda x: reduce(lambda out, e: F.when(x["value"].rlike(e[1][1]), F.lit(e[0])).otherwise(out), reversed(list(enumerate(ENCODINGS))), F.lit(-1))
    total = lambda array, f: F.aggregate(F.transform(array, f), F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))
    half, after = lambda x: x["m"] / 2, lambda x, i: F.get(x["symbols"], i + 1)

    def runs(x: Column) -> Column:
        away = lambda r: (x["changes"] - (x["n"] - 1) * r) / F.sqrt(F.greatest((x["n"] - 1) * r * (1 - r), F.lit(1e-9)))
        return F.greatest(normal_cdf(-away(x["rate"] * CHANGES)), normal_cdf(away(F.least(x["rate"] * (2 - CHANGES), F.lit(0.999)))))

    out = F.filter(_with(spans, e=fits), lambda x: x["e"] >= 0)
    out = _with(out, encoding=lambda x: F.get(names, x["e"]), alphabet=lambda x: F.get(alphabets, x["e"]), n=lambda x: F.char_length(x["value"]).cast("long"))
    out = _with(
        out,
        m=lambda x: F.char_length(x["alphabet"]),
        symbols=lambda x: F.transform(F.split(x["value"], ""), lambda c: F.instr(x["alphabet"], c) - 1),
        squares=lambda x: F.aggregate(F.sequence(F.lit(1), F.char_length(x["alphabet"])), F.lit(0.0), lambda a, i: a + F.pow((x["n"] - F.char_length(F.replace(x["value"], F.substr(x["alphabet"], i, F.lit(1)), F.lit("")))).cast("double"), F.lit(2.0))),
    )
    out = _with(
        out,
        pairs=lambda x: (x["squares"] - x["n"]) / 2,
        expected=lambda x: x["n"] * (x["n"] - 1.0) / 2 * COLLISIONS / x["m"],
        mean=lambda x: total(x["symbols"], lambda v: v) / x["n"],
        high=lambda x: total(x["symbols"], lambda v: v >= half(x)),
        changes=lambda x: total(x["symbols"], lambda v, i: (v >= half(x)) != (after(x, i) >= half(x))),
    )
    out = _with(
        out,
        rate=lambda x: 2 * x["high"] * (x["n"] - x["high"]) / (x["n"] * (x["n"] - 1.0)),
        spread=lambda x: total(x["symbols"], lambda v: F.pow(v - x["mean"], F.lit(2.0))),
        together=lambda x: total(x["symbols"], lambda v, i: (v - x["mean"]) * (after(x, i) - x["mean"])),
    )
    out = _with(
        out,
        p_uniform=lambda x: normal_cdf((x["pairs"] - x["expected"]) / F.sqrt(x["expected"] * (1 - COLLISIONS / x["m"]))),
        p_runs=runs,
        p_serial=lambda x: F.when(x["spread"] > 0, normal_cdf((F.abs(x["together"] / F.greatest(x["spread"], F.lit(1e-9))) - CORRELATION) * F.sqrt(x["n"].cast("double")))).otherwise(1.0),
    )
    return F.transform(out, lambda x: F.struct(*(x[f].alias(f) for f in ("start", "end", "kind", "value", "encoding", "n", "p_uniform", "p_runs", "p_serial")), F.greatest(x["p_uniform"], x["p_runs"], x["p_serial"]).alias("p")))


def _band(length: Column) -> Column:
    return reduce(lambda out, b: out + (length >= b).cast("int"), BANDS[1:], F.lit(0))


def randomness_limits(df: DataFrame, text_col: str = "text", discovery: float = 0.05) -> dict[int, float]:
    """For each band of lengths, the p-value up to which candidates of all texts pass at this false discovery rate.

    Benjamini and Hochberg's step-up over p-values rounded up to a step of -log10 p. Only counts per band and step leave
    the executors, at most 4 * 401 of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tests = df.where(text.rlike(CANDIDATE)).select(F.explode(battery(_found(text, CANDIDATE, "random"))).alias("x")).select(_band(F.col("x.n")).alias("band"), F.least(F.floor(-F.log10(F.greatest(F.col("x.p"), F.lit(1e-21))) * STEPS), F.lit(20 * STEPS)).alias("step"))
    limits: dict[int, float] = {}
    counts = tests.groupBy("band", "step").count().collect()
    for band in {r.band for r in counts}:
        own = sorted((r.step, r["count"]) for r in counts if r.band == band)
        total, found = sum(n for _, n in own), 0
        for step, n in reversed(own):
            found += n
            if 10 ** (-step / STEPS) * total <= discovery * found:
                limits[band] = 10 ** (-step / STEPS)
    return limits


def find_secrets(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", discovery: float = 0.05) -> DataFrame:
    """id_cols and secrets, an array<struct<start, end, kind>> by start, then kind, for each row of df.

    Base kinds stay as their patterns find them; a random one is added where the battery passes and no base one holds it
    already. Offsets are code points. Null and empty texts have none; repeated rows are kept; an empty table gives no rows.
    The rows are read twice: once for the counts that set the limits, once for the spans.
    """
    limits = randomness_limits(df, text_col, discovery)
    text = F.col("_text")
    out = df.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = out.withColumn("_base", F.concat(_found(text, ASSIGN, "assign", 2), _found(text, ACCESS, "access"), _found(text, HEX, "hex")))
    short = "array<struct<start:bigint,end:bigint,kind:int>>"
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    random = F.array().cast(short)
    if limits:
        passes = lambda x: reduce(or_, ((_band(x["n"]) == b) & (x["p"] <= p) for b, p in limits.items()))
        random = plain(F.filter(battery(_found(text, CANDIDATE, "random")), lambda x: passes(x) & ~F.exists("_base", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))))
    return out.select(*id_cols, F.array_sort(F.concat(plain("_base"), random).cast(short), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"])).alias("secrets"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with what any of its spans (by start) covers replaced by mask, once for spans that overlap.

    The text is cut into chunks of 1,024 code points once, and each part between spans is put together from its chunks, so
    that a text of many spans is not walked from its start for each.
    """
    before = F.concat(F.array(F.lit(0).cast("long")), scan(spans, F.lit(0).cast("long"), lambda at, x: F.greatest(at, x["end"]), "bigint"))
    pairs = F.zip_with(F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.char_length(text).cast("long"))), before, lambda start, at: F.struct(at.alias("at"), start.alias("to")))
    fresh = F.filter(pairs, lambda x: x["to"] >= x["at"])

    def part(chunks: Column, x: Column) -> Column:
        first, last = (F.floor(x[k] / CHUNK).cast("int") for k in ("at", "to"))
        piece = lambda i, at, to: F.substr(F.coalesce(F.get(chunks, i), F.lit("")), (at + 1).cast("int"), (to - at).cast("int"))
        inside = piece(first, x["at"] % CHUNK, x["at"] % CHUNK + x["to"] - x["at"])
        across = F.concat(piece(first, x["at"] % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), piece(last, F.lit(0), x["to"] % CHUNK))
        return F.when(first == last, inside).otherwise(across)

    whole = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda chunks: F.array_join(F.transform(fresh, lambda x: part(chunks, x)), mask))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
