"""The register with all columns, its labels and times, pages with totals, keys of supplier names."""

import csv
import glob
import hashlib
import unicodedata
from datetime import UTC, datetime

from pyspark.sql import functions as F

from auditlake.functions.text import name_key
from auditlake.operators import reports
from auditlake.plans import ledger
from auditlake.sources.tables import Domain

SF = "/root/testdata/sf0.001"


def test_full_register_has_every_column_and_document(spark, tmp_path):
    rows = ledger.QUERIES["full_register"](spark, SF)
    assert rows.columns == ["id", *reports.HEADS] and len(reports.HEADS) == 20
    assert rows.count() == Domain(spark, SF).headers().filter("status <> 'DRAFT'").count()
    some = rows.collect()
    assert {r.level for r in some} == {None, *reports.RISK_LABELS.values()} and {r.status for r in some} < set(reports.STATUS_LABELS.values())
    assert all((r.score is None) == (r.level is None) == (r.warnings is None) for r in some) and any(r.submitted is None for r in some)
    reports.write_csv(rows.drop("id").withColumnsRenamed(reports.HEADS).coalesce(1), str(tmp_path / "register"))
    with open(glob.glob(f"{tmp_path}/register/*.csv")[0], encoding="utf-8-sig", newline="") as f:
        lines = list(csv.reader(f))
    assert lines[0] == list(reports.HEADS.values()) and len(lines) == len(some) + 1


def test_iso_is_that_of_utc(spark):
    times = [0, 1, 86399, 86400, 951782400, 1719792000 + 3723, -1, None]
    rows = spark.createDataFrame([(t,) for t in times], "t long").select("t", reports.iso(F.col("t")).alias("s")).collect()
    assert all(r.s == (None if r.t is None else datetime.fromtimestamp(r.t, UTC).isoformat()) for r in rows)


def test_the_last_decision_with_a_risk_counts(spark):
    log = [(4, "2024-01-01", "purchase", '{"k": 60}'), (5, "2024-01-01", "error", '{"k": 30}'), (6, "2024-01-02", "purchase", '{"k": 5}'), (7, "2024-01-03", "purchase", '{"x": 1}'), (8, "2024-01-01", "view", '{"k": 9}'), (10, "2024-01-01", "error", None)]
    events = spark.createDataFrame(log, "event_id long, ts string, event_type string, props string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(map(tuple, reports.decision_risks(events).collect())) == [(2, 30, "MEDIUM", 3), (3, 5, "LOW", 0)]


def test_pages_hold_the_total(spark):
    d = Domain(spark, SF)
    want = sorted(((-r.created_at, r.id) for r in d.headers().filter("status = 'APPROVED'").collect()))
    for number in (1, 2, 10_000):
        rows = reports.status_page(d, "APPROVED", number, 7).collect()
        assert [(-r.created_at, r.id) for r in rows] == want[(number - 1) * 7 : number * 7] and {r.total for r in rows} <= {len(want)}


def test_orders_come_latest_first(spark):
    rows = reports.order_list(Domain(spark, SF), 3).collect()
    dated = [r for r in rows if r.order_date is not None]
    assert dated == sorted(dated, key=lambda r: (r.order_date, r.created_at), reverse=True) and rows[: len(rows) - len(dated)] == [r for r in rows if r.order_date is None]


def test_name_key(spark):
    names = ["ACME  Ltd", " acme ltd\t", "Ａｃｍｅ Ltd", "شركة  النور", "شركة النور", "Straße", "STRASSE", "a b", "a b", "x\x1cy", "", None]
    got = [r.k for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", name_key(F.col("n")).alias("k")).orderBy("i").collect()]
    assert got == [None if n is None else hashlib.sha256(unicodedata.normalize("NFKC", " ".join(n.split())).casefold().encode()).hexdigest() for n in names]
