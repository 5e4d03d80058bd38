"""Printed values: what is read from them, and what is left alone."""

import datetime

import pytest
from pyspark.sql import functions as F

from auditlake.functions import parse
from auditlake.operators import documents


#: Tokens as documents.line_texts() takes them.
TOKEN = "doc_id long, page int, text string, source string, confidence double, x0 double, y0 double, x1 double, y1 double"


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_lines_and_labels(spark):
    assert one(spark, parse.line, "  a \t b ", "١٬٢٣٤٫٥٠", "مـبلغ", "ﬁ‏ x", None) == ["a b", "1,234.50", "مبلغ", "fi x", None]
    assert one(spark, parse.label_key, "Invoice #: ", "أإآ:", ". Total .") == ["invoice", "ااا", "total"]


@pytest.mark.parametrize("text,value", [("1,234.50", "1234.50"), ("1234.5", "1234.5"), ("12,34", None), ("SAR 007.10", "7.10"), ("1.23456", None), ("-1", None), ("5%", None), ("", None), ("0", "0"), ("1,234,567", "1234567"), ("1e4", None)])
def test_amounts(spark, text, value):
    assert one(spark, parse.amount, text) == [value]


def test_percentages(spark):
    assert one(spark, lambda c: parse.amount(c, True), "15%", "100", "100.01", "٪5") == ["15", "100", None, "5"]


def test_dates(spark):
    d = datetime.date
    got = one(spark, parse.day, "2024-02-29", "2023-02-29", "31/01/2024", "01/31/2024", "5/5/2024", "05/06/2024", "31/31/2024", "2024-01-02T10:11:12", "x", None)
    assert got == [d(2024, 2, 29), None, d(2024, 1, 31), d(2024, 1, 31), d(2024, 5, 5), None, None, d(2024, 1, 2), None, None]


def test_clean(spark):
    assert one(spark, lambda c: parse.clean(c, 4), " a\x00 \n b c", "", None, "   ") == ["a b ", None, None, None]


def test_lines_of_tokens(spark):
    token = lambda text, x, y, source="OCR": (1, 1, text, source, 0.9, x, y, x + 0.05, y + 0.02)
    rows = [token("Total", 0.1, 0.500), token("due:", 0.2, 0.503), token("5.00", 0.5, 0.497), token("رقم", 0.9, 0.1), token("الفاتورة", 0.8, 0.1), token("A-1", 0.6, 0.1), token("next", 0.1, 0.53), token("total", 0.1, 0.7), token("due", 0.2, 0.7), token("6.00", 0.3, 0.7)]
    tokens = spark.createDataFrame(rows, TOKEN)
    assert sorted(r.text for r in documents.line_texts(tokens).collect()) == sorted(["رقم الفاتورة A-1", "Total due: 5.00", "next", "total due 6.00"])
    got = {r.field: (r.value, r.warning) for r in documents.parsed_fields(tokens).collect()}
    assert got == {"invoice_number": ("A-1", None), "grand_total": (None, "AMBIGUOUS_GRAND_TOTAL")}


def test_one_letter_of_a_long_arabic_label_may_be_wrong_on_scans_only(spark):
    for source, want in (("OCR", {"invoice_number": "APPROXIMATE_LABEL_INVOICE_NUMBER"}), ("PDF_TEXT", {})):
        rows = [(1, 1, w, source, 0.9, 0.9 - 0.1 * i, 0.1, 0.95 - 0.1 * i, 0.12) for i, w in enumerate(["رقم", "الفاتور", "A-1"])]
        assert {r.field: r.warning for r in documents.parsed_fields(spark.createDataFrame(rows, TOKEN)).collect()} == want


def test_rows_add_up(spark):
    df = spark.range(1).selectExpr("cast(2 as decimal(14,4)) q", "cast(10 as decimal(22,4)) p", "cast(1 as decimal(22,2)) d", "cast(15 as decimal(7,4)) t")
    ok = lambda total: df.select(parse.row_is_consistent(F.col("q"), F.col("p"), F.col("d"), F.col("t"), F.lit(total).cast("decimal(22,2)")).alias("x")).first().x
    assert ok("21.85") and ok("21.87") and not ok("21.88")
