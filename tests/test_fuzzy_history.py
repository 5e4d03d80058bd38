"""Fuzzy price history against all pairs of lines in Python, on descriptions with words of letters and digits."""

import random
import time
from datetime import date, timedelta
from decimal import Decimal
from difflib import SequenceMatcher
from statistics import median

import pytest

from auditlake.functions.text import similar_phrases
from auditlake.operators import prices

WORDS = ["cable cat6 blue 2", "cable cat6a blue 2", "cable cat6 blue 3", "cable cat6 blue", "steel pipe dn50 6", "steel pipe dn55 6"]


def alike(a, b):
    x, y = a.split(), b.split()
    if [w for w in x if w.isdigit()] != [w for w in y if w.isdigit()]:
        return 0
    return max(SequenceMatcher(None, a, b).ratio(), len({*x} & {*y}) / len({*x} | {*y}))


def test_fuzzy_history_in_small_parts_and_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(prices, "TOGETHER", 1)
    monkeypatch.setattr(prices, "FEW_PAIRS", -1)
    test_fuzzy_history(spark, monkeypatch)


def test_fuzzy_history(spark, monkeypatch):
    lines = [(i, 1 + k, WORDS[(i * 5 + k * 2) % 6], 100 + 7 * i + k, date(2024, 1, 1) + timedelta(days=20 * i), i) for i in range(1, 25) for k in range(2)]
    sql = "invoice_id long, position int, phrase string, p int, day date, created_at long"
    frame = spark.createDataFrame(lines, sql).selectExpr("*", "cast(p as decimal(22,4)) as effective_price", "'piece' as unit", "cast(1 as decimal(14,4)) as quantity", "1L as company_id", "1L as supplier_id", "'SAR' as currency", "'APPROVED' as status").drop("p")
    monkeypatch.setattr(prices, "_lines", lambda d: frame)
    want = {}
    for i, position, words, _, day, made in lines:
        best = {}
        for j, at, other, price, past, before in lines:
            if j != i and before < made and timedelta(0) <= day - past <= timedelta(days=365) and alike(words, other) >= 0.88:
                best[j] = min(best.get(j, (0, 0, 0)), (-alike(words, other), at, price))
        if len(best) >= 3:
            want[i, position] = len(best), float(median(x[2] for x in best.values()))
    got = {(r.invoice_id, r.position): (r.samples, float(r["median"])) for r in prices.price_history_fuzzy(None).filter("status <> 'NOT_CHECKED'").collect()}
    assert alike(WORDS[0], WORDS[1]) >= 0.88 and alike(WORDS[0], WORDS[2]) == 0
    assert got == want


def test_many_documents_of_descriptions_alike(spark, monkeypatch):
    n = 40_000
    frame = spark.range(n).selectExpr(
        "id as invoice_id", "1 as position", "if(id % 2 = 0, 'steel pipes long', 'steel pipe long') as phrase", "'kg' as unit", "cast(id + 1000000000000000 as decimal(22,4)) as effective_price", "cast(1 as decimal(14,4)) as quantity",
        "1L as company_id", "1L as supplier_id", "'SAR' as currency", "date_add(date'2020-01-01', cast(id % 300 as int)) as day", "id as created_at", "'APPROVED' as status",
    )
    monkeypatch.setattr(prices, "_lines", lambda d: frame)
    start = time.time()
    rows = prices.price_history_fuzzy(None).filter("invoice_id = 39899").collect()  # a day with number 299, so all before it
    assert [(r.samples, r["median"], r.status) for r in rows] == [(39_899, Decimal(10**15 + 19_949), "PASS")]
    assert time.time() - start < 60


@pytest.mark.parametrize("least", [0.88, 0.7])
def test_similar_phrases_against_all_pairs(spark, least):
    r = random.Random(5)
    words = ["cable", "cables", "red", "blue", "steel", "pipe", "x1", "2", "30", "كابل", "احمر", "of", "aa", "aaa"]
    texts = {" ".join(r.choice(words) for _ in range(r.choice([2, 3, 4, 9, 10, 13]))) for _ in range(90)} | {"a" * 70, "a" * 72, "b" + "a" * 65, "a" * 64, "ab" * 120, "ab" * 119 + "c"}
    for x in sorted(texts):  # near copies: letters left out, put in, and words in another order
        i, j = sorted(r.choices(range(len(x)), k=2))
        texts |= {" ".join((x[:i] + x[i + 1 : j] + "e" + x[j:]).split()), " ".join(r.sample(x.split(), len(x.split())))}
    score = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()}))
    digits = lambda x: [w for w in x.split() if w.isdigit()]
    want = {(a, b): score(a, b) for a in texts for b in texts if a != b and digits(a) == digits(b) and score(a, b) >= least}
    got = {(x.phrase, x.other): x.similarity for x in similar_phrases(spark.createDataFrame([(x,) for x in texts], "phrase string"), least).collect()}
    assert got == want and len(want) > 100
