"""Folded texts, keys of numbers and units, and the fuzzy price history against a brute force."""

import difflib
from datetime import date
from decimal import ROUND_HALF_UP, Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators import prices


def one(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_phrases(spark):
    got = one(spark, text.phrase, ["Cable CAT-6, 2m", "كَابِل ـ أحمر ٦", "ﬁne Ｆｕｌｌ", "", None, "a-1 b - 2 x_3", "قطعة", "É"])
    assert got == ["cable cat6 2m", "كابل احمر 6", "fine full", "", "", "a1 b 2 x3", "قطعه", ""]


def test_number_keys(spark):
    assert one(spark, text.number_key, ["INV-٠١/۲", "inv 01 2", "Ｉｎｖ－０１２", "--", None, "Straße 1"]) == ["inv012", "inv012", "inv012", None, None, "strasse1"]


@pytest.mark.parametrize("spelling,unit", [("قطعة", "piece"), ("PCS", "piece"), ("كيلو", "kg"), ("جم", "g"), ("each", "each"), ("Litre", "l"), ("كرتون", "box"), ("", None), (None, None)])
def test_units(spark, spelling, unit):
    assert one(spark, text.unit_key, [spelling]) == [unit]


def comparable(a, b):
    digits = lambda s: [w for w in s.split() if w.isdigit()]
    if min(len(a), len(b)) < 6 or digits(a) != digits(b):
        return None
    x, y = set(a.split()), set(b.split())
    score = max(difflib.SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y))
    return score if score >= 0.88 else None


def test_fuzzy_history_against_brute_force(spark, monkeypatch):
    names = ["cable cat6 blue 2", "cable cat6a blue 2", "cable cat6 blue 3", "copper pipe 15", "copper pipes 15", "tap", "oil filter element", "oil filter elements"]
    rows = [(i, 1 + k, names[(3 * i + 5 * k * k) % 8], ["piece", "kg"][(i // 3) % 2], Decimal(100 + 7 * i % 90 + 11 * k).quantize(Decimal("0.0001")) if (i + k) % 13 else None, Decimal(2), 1, i % 2, "SAR", date(2020, 1 + i % 12, 1 + i % 27), i, ["APPROVED", "DRAFT", "FINANCE_REVIEW"][i % 3]) for i in range(60) for k in range(3)]
    schema = "invoice_id long, position int, phrase string, unit string, effective_price decimal(22,4), quantity decimal(14,4), company_id long, supplier_id long, currency string, day date, created_at long, status string"
    monkeypatch.setattr(prices, "_lines", lambda d: spark.createDataFrame(rows, schema))
    got = {(r.invoice_id, r.position): (r.samples, r.median, r.status) for r in prices.price_history_fuzzy(None).collect()}
    assert len(got) == len(rows)
    checked = 0
    for i, pos, name, unit, price, _, _, supplier, _, day, made, _ in rows:
        best = {}
        for j, q, other, u, p, _, _, s, _, then, before, state in rows:
            score = comparable(name, other)
            if score is not None and j != i and s == supplier and u == unit and state != "DRAFT" and 0 <= (day - then).days <= 365 and before < made:
                best[j] = min(best.get(j, (9, 9, None)), (-score, q, p), key=lambda t: t[:2])
        values = [p for *_, p in best.values() if p is not None]
        assert got[i, pos][0] == len(values)
        if price is None or len(values) < 3:
            assert got[i, pos][1:] == (None, "NOT_CHECKED")
        else:
            checked += 1
            assert got[i, pos][1] == Decimal(median(values)).quantize(Decimal("0.0001"), ROUND_HALF_UP) and got[i, pos][2] != "NOT_CHECKED"
    assert checked > 40
