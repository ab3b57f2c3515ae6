"""Identifiers, narrations and merchant names as column expressions; Arrow UDFs only for Unicode folding and similarity."""


import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are a legal form, no name.
LEGAL_SUFFIXES = ("PRIVATE", "PVT", "PVTLTD", "LIMITED", "LTD", "LLP", "LLC", "INC", "PLC", "CORP", "CORPORATION", "CO", "P", "L")
#: Words of a narration that name a rail or a direction.
RAILS = ("NEFT", "IMPS", "RTGS", "UPI", "ACH", "NACH", "ECS", "SWIFT", "FT")
DIRECTIONS = ("CR", "DR")
#: Words of purpose, and words that stand for no one.
PURPOSE = ("SETTLEMENT", "SETTLEMENTS", "PAYOUT", "PAYOUTS", "MERCHANT", "BULK", "BATCH", "INWARD", "OUTWARD", "TRANSFER", "REMITTANCE", "PAYMENT", "CREDIT", "DEBIT", "TXN", "REF")
GENERIC = ("DIRECT", "SELF", "FUND", "FUNDS", "ACCOUNT", "AC", "MISC", "SUNDRY", "OTHERS", "THIRD")
#: Dashes that count as a hyphen.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"


def _each(function: Callable, kind: str, *columns: Column | str) -> Column:
    """function over the columns' values, a batch at a time; null where the first is null."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else function(*row) for row in zip(*series, strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return run(a, b, c, d)

    return F.pandas_udf({1: one, 2: two, 4: four}[len(columns)], kind)(*columns)


def _fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(dict.fromkeys(map(ord, DASHES), "-"))
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return " ".join(text.split()).upper()


def fold_text(raw: Column | str) -> Column:
    """Any Unicode text made comparable: compatibility forms, dashes, accents, case and white space."""
    return _each(_fold, "string", raw)


def fold_ascii(raw: Column) -> Column:
    """fold_text for text that needs no Unicode rules but the dashes; stays in the JVM."""
    return F.upper(F.trim(F.regexp_replace(F.translate(raw, DASHES, "-" * len(DASHES)), r"\s+", " ")))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def normalize_identifier(folded: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(folded, "[^0-9A-Z]+", "-"), "^-+|-+$", ""), F.lit(""))


def is_order_ref(text: Column) -> Column:
    return text.rlike(r"^ORD-[0-9]{4}-[0-9]{6}$")


def normalize_utr(folded: Column) -> Column:
    return F.nullif(F.regexp_replace(folded, "[^0-9A-Z]", ""), F.lit(""))


def normalize_narration(folded: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[^0-9A-Z ]+", " "), " +", " "))


def normalize_merchant(folded: Column) -> Column:
    """Without the legal words at its end, as many as there are, but never without a word."""
    return F.regexp_replace(normalize_narration(folded), rf"(?<=[0-9A-Z])( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")


def merchant_skeleton(folded: Column) -> Column:
    """Each word's first letter and its consonants after, joined, with repeated letters once."""
    words = F.transform(F.split(normalize_merchant(folded), " "), lambda w: F.concat(F.left(w, F.lit(1)), F.translate(F.substr(w, F.lit(2)), "AEIOU", "")))
    return F.regexp_replace(F.array_join(words, ""), r"(.)\1+", "$1")


def narration_utr(normalized: Column) -> Column:
    """The reference of a normalised narration, UTR and 13 to 20 digits; shorter ones are truncated and don't count."""
    digits = F.regexp_extract(normalized, r"\bUTR\s?([0-9]{6,20})\b", 1)
    return F.when(F.length(digits) >= 13, F.concat(F.lit("UTR"), digits))


def narration_rail(normalized: Column) -> Column:
    return F.get(F.filter(F.split(normalized, " "), lambda w: w.isin(*RAILS)), 0)


def _name_in(folded: str) -> str | None:
    known, best, run = False, [], []
    for segment in re.split(r"[-/|,]+", folded):
        words = re.sub(r"[^0-9A-Z ]+", " ", segment).split()
        known |= any(w in RAILS or re.fullmatch(r"UTR[0-9]{6,20}", w) for w in words)
        words = [w for w in words if not re.fullmatch(r"[0-9]+|UTR[0-9]*", w)]
        while words and words[0] in RAILS + DIRECTIONS + PURPOSE:
            words = words[1:]
        while words and words[-1] in PURPOSE + DIRECTIONS:
            words = words[:-1]
        run = run + words if set(words) - set(GENERIC + PURPOSE) else []
        best = max(best, run, key=len)
    return " ".join(best) if known and best else None


def narration_merchant(folded: Column | str) -> Column:
    """The longest run of neighbouring segments that could be a name, the first on ties; null without a rail or reference.

    Segments part at dashes, slashes, bars and commas; noise words go from their ends, references and numbers altogether;
    what only has generic or purpose words is no name. Meant for distinct narrations.
    """
    return _each(_name_in, "string", folded)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def indel_ratio(a: str, b: str) -> float:
    """1 less the share of letters to insert or delete; two empty texts are alike."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words, and those with what either text has besides; 1 if one's words are all shared."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    one, two = (" ".join(filter(None, (both, " ".join(sorted(x))))) for x in (left - right, right - left))
    if both and (not left - right or not right - left):
        return 1.0
    return max(indel_ratio(one, two), *((indel_ratio(both, one), indel_ratio(both, two)) if both else (0.0,)))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one as long as it, or cut short at an end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    return max(indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)) if long[max(0, i) : i + n])


def _score(skeleton_a: str, skeleton_b: str, a: str, b: str) -> float:
    return max(indel_ratio(skeleton_a, skeleton_b) if skeleton_a and skeleton_b else 0.0, token_set_ratio(a, b))


def score_names(skeleton_a: Column | str, skeleton_b: Column | str, name_a: Column | str, name_b: Column | str) -> Column:
    """The better of the skeletons' ratio and the names' token-set ratio."""
    return _each(_score, "double", skeleton_a, skeleton_b, name_a, name_b)


def _best_score(skeleton: str, name: str, skeletons: list[str], names: list[str]) -> float:
    return max(_score(skeleton, s, name, n) for s, n in zip(skeletons, names, strict=True))


def score_spellings(skeleton: Column | str, name: Column | str, skeletons: Column | str, names: Column | str) -> Column:
    """The best score of a name against several, which come as two arrays."""
    return _each(_best_score, "double", skeleton, name, skeletons, names)


def score_partial(a: Column | str, b: Column | str) -> Column:
    return _each(partial_ratio, "double", a, b)
