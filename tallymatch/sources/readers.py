"""Readers of the three source files: a typed table of what is sound, and a quarantine row for what is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.money import parse_minor
from ..functions.text import blank_to_null, fold_text, narration_merchant, narration_utr, normalize_identifier, normalize_narration, normalize_utr
from ..schema import STATUSES
from .sinks import stored

#: Hashes of repeated keys that go to all workers; more are joined.
REPEATED = 100_000
PSP = "settlements array<struct<settlement_id:string,merchant_id:string,utr:string,settled_on:string,gross_paise:string,fee_paise:string,tax_paise:string,adjustments_paise:string,net_paise:string,payments:array<struct<payment_id:string,order_ref:string,amount_paise:string,captured_at:string>>>>"


def _text_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file as strings by its header, with a row's place among them as ord, and rows of too many fields in _broken.

    The place follows the file's own order of splits, whose offsets rise within a file.
    """
    found = spark.read.option("header", True).csv(path).columns
    lacking = [c for c in columns if c not in found]
    if lacking:
        raise ValueError(f"MISSING_COLUMN: {', '.join(lacking)}")
    schema = ", ".join(f"`{c}` string" for c in found) + ", _broken string"
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", False).schema(schema).csv(path)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def _split(rows: DataFrame, source: str, tests: list[tuple[str, str, Column]], key: str | None) -> tuple[DataFrame, DataFrame]:
    """Sound rows and the quarantine. tests: (code, field, what is wrong); the first that holds names the fault.

    Of sound rows with one key the first stays; others are DUPLICATE_ID. Hashes of their keys are counted first, and those
    of several rows written: only such rows are ranked, and no row travels where there are none.
    """
    code, field = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, f, wrong in reversed(tests):
        wrong = F.coalesce(wrong, F.lit(True))
        code, field = F.when(wrong, c).otherwise(code), F.when(wrong, f).otherwise(field)
    judged = rows.withColumns({"_code": code, "_field": field})
    sound, bad = judged.where("_code is null").drop("_code", "_field"), judged.where("_code is not null")
    raw = F.to_json(F.struct(*(c for c in rows.columns if c != "ord" and not c.startswith("_"))))
    problem = lambda df, code, field: df.select(F.lit(source).alias("source"), "ord", code.alias("code"), field.alias("field"), raw.alias("raw"))
    bad = problem(bad, F.col("_code"), F.col("_field"))
    if not key:
        return sound, bad
    met = stored(sound.groupBy(F.xxhash64(key).alias("_met")).agg(F.count("*").alias("n")).where("n > 1").select("_met"), "repeated")
    few = met.limit(REPEATED + 1).count()
    if not few:
        return sound, bad
    met = F.broadcast(met) if few <= REPEATED else met
    turn = F.row_number().over(Window.partitionBy(key).orderBy("ord", *(c for c in ("pos",) if c in rows.columns)))
    hashed = sound.withColumn("_met", F.xxhash64(key))
    ranked = hashed.join(met, "_met", "left_semi").withColumn("_turn", turn)
    once = hashed.join(met, "_met", "left_anti").select(*sound.columns).unionAll(ranked.where("_turn = 1").select(*sound.columns))
    return once, bad.unionAll(problem(ranked.where("_turn > 1"), F.lit("DUPLICATE_ID"), F.lit(key)))


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """ledger_orders.csv: (orders, quarantine)."""
    needed = ["order_id", "merchant_id", "customer_ref", "amount_gross_paise", "booked_at", "status"]
    rows = _text_rows(spark, path, needed)
    if "currency" not in rows.columns:
        rows = rows.withColumn("currency", F.lit(None).cast("string"))
    return check_ledger(rows)


def check_ledger(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders and quarantine from rows of strings with ord (and _broken, where a file was read)."""
    if "_broken" not in rows.columns:
        rows = rows.withColumn("_broken", F.lit(None).cast("string"))
    currency = F.coalesce(blank_to_null(F.col("currency")), F.lit("INR"))
    rows = rows.withColumns({"_amount": parse_minor(F.col("amount_gross_paise")), "_booked": F.col("booked_at").try_cast("timestamp_ntz"), "_currency": currency})
    tests = [
        ("MALFORMED_STRUCTURE", "row", F.col("_broken").isNotNull()),
        *(("MISSING_FIELD", c, blank_to_null(F.col(c)).isNull()) for c in ("order_id", "merchant_id", "customer_ref", "amount_gross_paise", "booked_at", "status")),
        ("MALFORMED_MONEY", "amount_gross_paise", F.col("_amount").isNull()),
        ("NEGATIVE_AMOUNT", "amount_gross_paise", F.col("_amount") < 0),
        ("MALFORMED_DATE", "booked_at", F.col("_booked").isNull()),
        ("UNKNOWN_ENUM_VALUE", "currency", F.col("_currency") != "INR"),
        ("UNKNOWN_ENUM_VALUE", "status", ~F.trim("status").isin(*STATUSES)),
    ]
    good, bad = _split(rows, "ledger", tests, "order_id")
    return good.select(*(F.trim(c).alias(c) for c in ("order_id", "merchant_id", "customer_ref")), F.col("_amount").alias("amount_minor"), F.col("_currency").alias("currency"), F.col("_booked").alias("booked_at"), F.trim("status").alias("status"), "ord"), bad


def _line_schema() -> StructType:
    """A settlement of the document, as a line's own schema."""
    return StructType.fromDDL(PSP)["settlements"].dataType.elementType


def read_settlements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """psp_settlements.json: (settlements, payments, quarantine). A bad batch takes its payments with it; bad payments don't.

    One document of all settlements, or, where files are large, lines with a settlement each, which are read in parts.
    """
    whole = spark.read.text(path).where("trim(value) != ''").select(F.ltrim("value").alias("value")).first()
    if whole and whole.value.startswith("{") and '"settlement_id"' in whole.value.split('"settlements"')[0]:
        rows = spark.read.schema(_line_schema()).json(path).withColumn("ord", F.monotonically_increasing_id())
    else:
        nested = spark.read.option("multiLine", True).schema(PSP).json(path)
        rows = nested.select(F.posexplode("settlements").alias("pos", "s")).select(F.col("pos").cast("bigint").alias("ord"), "s.*")
    money = {f"_{c}": parse_minor(F.coalesce(F.col(f"{c}_paise"), F.lit("0"))) if c in ("tax", "adjustments") else parse_minor(F.col(f"{c}_paise")) for c in ("gross", "fee", "tax", "adjustments", "net")}
    rows = rows.withColumns(money | {"_day": F.col("settled_on").try_cast("date")})
    tests = [
        ("EMPTY_IDENTIFIER", "settlement_id", blank_to_null(F.col("settlement_id")).isNull()),
        *(("MALFORMED_MONEY", f"{c}_paise", F.col(f"_{c}").isNull()) for c in ("gross", "fee", "tax", "adjustments", "net")),
        *(("NEGATIVE_AMOUNT", f"{c}_paise", F.col(f"_{c}") < 0) for c in ("gross", "fee", "tax")),
        ("MALFORMED_DATE", "settled_on", F.col("_day").isNull()),
    ]
    good, bad = _split(rows, "psp", tests, "settlement_id")
    settlements = good.select(F.trim("settlement_id").alias("settlement_id"), "merchant_id", normalize_utr(fold_text("utr")).alias("utr"), F.col("_day").alias("settled_on"), *(F.col(f"_{c}").alias(f"{c}_minor") for c in ("gross", "fee", "tax", "adjustments", "net")), "ord")
    nested_payments = good.select("settlement_id", F.col("ord").alias("batch"), F.posexplode(F.coalesce("payments", F.array().cast("array<struct<payment_id:string,order_ref:string,amount_paise:string,captured_at:string>>"))).alias("pos", "p"))
    flat = nested_payments.select("settlement_id", "pos", F.col("batch").alias("ord"), "p.*").withColumns({"_amount": parse_minor(F.col("amount_paise")), "_at": F.col("captured_at").try_cast("timestamp_ntz")})
    good_payments, bad_payments = _split(flat, "psp_payment", [("EMPTY_IDENTIFIER", "payment_id", blank_to_null(F.col("payment_id")).isNull()), ("MALFORMED_MONEY", "amount_paise", F.col("_amount").isNull()), ("NEGATIVE_AMOUNT", "amount_paise", F.col("_amount") < 0), ("MALFORMED_DATE", "captured_at", F.col("_at").isNull())], "payment_id")
    payments = good_payments.select("payment_id", "settlement_id", F.col("order_ref").alias("order_ref_raw"), normalize_identifier(fold_text("order_ref")).alias("order_ref"), F.col("_amount").alias("amount_minor"), F.col("_at").alias("captured_at"), F.col("pos").cast("int"), "ord")
    return settlements, payments, bad.unionAll(bad_payments)


def date_order(rows: DataFrame, column: str) -> DataFrame:
    """One row of evidence over a whole column of slash dates: day_first, month_first, impossible (counts) and order.

    A part over 12 is a witness. Witnesses of both kinds, or a date with both parts over 12, make the order an ERROR; none
    leaves it at day first, UNPROVEN.
    """
    part = lambda i: F.regexp_extract(F.trim(column), r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-][0-9]{4}$", i).try_cast("int")
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    a, b = part(1), part(2)
    out = rows.agg(n((a > 12) & (b <= 12), "day_first"), n((b > 12) & (a <= 12), "month_first"), n((a > 12) & (b > 12), "impossible"))
    order = F.when((F.col("impossible") > 0) | ((F.col("day_first") > 0) & (F.col("month_first") > 0)), "ERROR").when(F.col("day_first") > 0, "DMY").when(F.col("month_first") > 0, "MDY").otherwise("UNPROVEN")
    return out.withColumn("order", order)


def slash_date(text: Column, order: str) -> Column:
    """A date of 1 or 2 digit parts and a year, in the order decided; null if it is none."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$", i)
    day, month = (2, 1) if order == "MDY" else (1, 2)
    return F.concat_ws("-", part(3), F.lpad(part(month), 2, "0"), F.lpad(part(day), 2, "0")).try_cast("date")


def read_narrations(bank: DataFrame, fold=fold_text) -> DataFrame:
    """bank, narration first, with narration_normalized, utr and merchant, folded by fold; rows without a narration have nothing to read.

    Nearly each narration is its row's own, so each is read where it is, without a shuffle.
    """
    folded = bank.where(F.col("narration").isNotNull()).withColumn("_folded", fold(F.col("narration"))).withColumn("narration_normalized", normalize_narration(F.col("_folded")))
    return folded.select("narration", *(c for c in bank.columns if c != "narration"), "narration_normalized", narration_utr(F.col("narration_normalized")).alias("utr"), narration_merchant("_folded").alias("merchant"))


def read_bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """bank_statement.csv: (bank, quarantine). The order of day and month is one decision over the whole column."""
    rows = _text_rows(spark, path, ["txn_id", "value_date", "narration", "credit_paise", "debit_paise"])
    if "balance_paise" not in rows.columns:
        rows = rows.withColumn("balance_paise", F.lit(None).cast("string"))
    order = date_order(rows, "value_date").first()["order"]
    if order == "ERROR":
        raise ValueError("value_date has both orders of day and month")
    rows = rows.withColumns({"_date": slash_date(F.col("value_date"), order), "_credit": parse_minor(F.col("credit_paise")), "_debit": parse_minor(F.col("debit_paise"))})
    tests = [
        ("MALFORMED_STRUCTURE", "row", F.col("_broken").isNotNull()),
        *(("MISSING_FIELD", c, blank_to_null(F.col(c)).isNull()) for c in ("txn_id", "value_date", "narration", "credit_paise", "debit_paise")),
        ("MALFORMED_DATE", "value_date", F.col("_date").isNull()),
        *(("MALFORMED_MONEY", f"{c}_paise", F.col(f"_{c}").isNull()) for c in ("credit", "debit")),
        *(("NEGATIVE_AMOUNT", f"{c}_paise", F.col(f"_{c}") < 0) for c in ("credit", "debit")),
        ("MALFORMED_MONEY", "debit_paise", (F.col("_credit") > 0) & (F.col("_debit") > 0)),
    ]
    good, bad = _split(rows, "bank", tests, "txn_id")
    out = good.select(F.trim("txn_id").alias("txn_id"), F.col("_date").alias("value_date"), "narration", F.col("_credit").alias("credit_minor"), F.col("_debit").alias("debit_minor"), parse_minor(F.col("balance_paise")).alias("balance_minor"), "ord")
    return read_narrations(out), bad
