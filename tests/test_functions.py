import random

import pytest
from pyspark.sql import functions as F

from tallymatch.functions import money, text
from tallymatch.functions.stats import wilson


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_parse_and_format(spark):
    rows = [("1,234",), ("-5",), ("1.5",), ("",), (None,), ("+7_000",), ("x",)]
    assert [r[0] for r in values(spark, rows, "a string", money.parse_minor(F.col("a")))] == [1234, -5, None, None, None, 7000, None]
    rows = [("12.34",), ("12.345",), ("-0.5",), ("7",), ("a",)]
    assert [r[0] for r in values(spark, rows, "a string", money.parse_major(F.col("a")))] == [1234, None, -50, 700, None]
    rows = [(123456700,), (-5,), (99999,), (100000,), (12345678901,)]
    assert [r[0] for r in values(spark, rows, "a bigint", money.format_minor(F.col("a")))] == ["₹12,34,567.00", "-₹0.05", "₹999.99", "₹1,000.00", "₹12,34,56,789.01"]


def test_band(spark):
    rows = [(0,), (20_000,), (20_001,), (-1_000_000,)]
    assert [r[0] for r in values(spark, rows, "a bigint", money.band(F.col("a"), 100, 50))] == [100, 100, 101, 5000]


@pytest.mark.parametrize("sign", [1, -1])
def test_allocate_sums_exactly(spark, sign):
    rng = random.Random(4)
    rows = [(g, p, sign * (g * 997 + 13), rng.choice([0, 1, 3, 10**12])) for g in range(8) for p in range(rng.randint(1, 9))]
    got = money.allocate(spark.createDataFrame(rows, "g int, p int, total bigint, w bigint"), ["g"], "total", "w", "p").collect()
    for g in range(8):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.p)
        total, whole = abs(own[0].total), sum(r.w for r in own)
        floors = [total * r.w // whole if whole else 0 for r in own]
        order = sorted(range(len(own)), key=lambda i: (-(total * own[i].w % whole) if whole else 0, i))
        for i in order[: total - sum(floors)] if whole else []:
            floors[i] += 1
        assert [r.share_minor for r in own] == [sign * f for f in floors]
        assert not whole or sum(r.share_minor for r in own) == own[0].total


def test_text(spark):
    rows = [("ord 2026‑004821",), ("  --  ",), (None,), ("Café Ａ",)]
    assert [r[0] for r in values(spark, rows, "a string", text.normalize_identifier(text.fold_text("a")))] == ["ORD-2026-004821", None, None, "CAFE-A"]
    rows = [("RZRPAY SFTWR P L",), ("URBAN COMPANY TECH LTD",), ("LTD",)]
    assert [r[0] for r in values(spark, rows, "a string", text.merchant_skeleton(F.col("a")))] == ["RZRPYSFTWR", "URBNCMPNYTCH", "LTD"]
    rows = [("NEFT CR-UTR2026031012345-ACME TRADERS PVT LTD",), ("IMPS CR/UTR123456/SUNDRY",), ("ACME TRADERS",), ("UPI/ACME/SETTLEMENT",)]
    got = values(spark, rows, "a string", text.narration_utr(text.normalize_narration(F.col("a"))), text.narration_merchant("a"))
    assert got == [("UTR2026031012345", "ACME TRADERS PVT LTD"), (None, None), (None, None), (None, "ACME")]


def test_similarity():
    assert text.indel_ratio("abc", "abc") == 1.0
    assert text.indel_ratio("abc", "axc") == pytest.approx(4 / 6)
    assert text.token_set_ratio("ACME TRADERS", "ACME") == 1.0
    assert text.token_set_ratio("", "ACME") == 0.0
    assert text.partial_ratio("bcd", "abcde") == 1.0


def test_wilson(spark):
    rows = [(0, 0), (0, 10), (10, 10), (5, 10)]
    low, high = wilson(F.col("k"), F.col("n"))
    got = values(spark, rows, "k bigint, n bigint", low, high)
    assert got[0] == (0.0, 1.0) and got[1][0] == 0.0 and got[2][1] == 1.0
    assert got[3] == (pytest.approx(0.2366, abs=1e-4), pytest.approx(0.7634, abs=1e-4))
