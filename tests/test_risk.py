"""Risk scores over all checks, against SQL that holds them too."""

import duckdb

from auditlake.operators import checks, reports, similar
from auditlake.plans import catalogue as c
from auditlake.sources.tables import Domain

SF = "/root/testdata/sf0.001"
SQL = f"{c.V}, {c.RISK}"
LEVELS = ", CASE WHEN evaluated >= 10 THEN 'HIGH' WHEN evaluated >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN warnings > 0 THEN 'NEEDS_REVIEW' WHEN open THEN 'INCOMPLETE' ELSE 'PASS' END AS summary"


def connected():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_risk_of_all_checks(spark):
    con, d = connected(), Domain(spark, SF)
    risk = checks.risk_scores(d).select("id", "score", "warnings", "evaluated", "level", "confidence", "summary")
    want = con.execute(f"{SQL} SELECT id, score, warnings, evaluated, {c.LEVEL}{LEVELS} FROM risk").fetchall()
    assert sorted(map(tuple, risk.collect())) == sorted(want)
    assert {r[5] for r in want} >= {"MEDIUM", "HIGH"} and {r[6] for r in want} >= {"NEEDS_REVIEW"}
    want = con.execute(f"{SQL} SELECT id, project_id, score, {c.LEVEL} FROM risk JOIN hd USING (id) WHERE score > 0 AND currency = 'SAR' AND status IN ('PROJECT_REVIEW', 'FINANCE_REVIEW') ORDER BY score DESC, id LIMIT 10").fetchall()
    assert [tuple(r) for r in reports.exception_queue(d, "SAR").select("id", "project_id", "score", "level").collect()] == want
    regional = c.QUERIES["regional_price_exact"](spark, SF)
    cols = sorted(regional.columns)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(regional.select(*cols).collect()) == text(con.execute(f"SELECT {', '.join(cols)} FROM ({c.ORACLE['regional_price_exact']})").fetchall())


def test_incomplete_without_a_warning(spark, monkeypatch):
    rows = [(i, code, checks.PASS) for i in (1, 2, 3) for code in checks.WEIGHTS if (i, code) not in {(2, "DOCUMENT_TAX_TOTAL"), (3, "SPLIT_INVOICE")}]
    rows += [(2, "DOCUMENT_TAX_TOTAL", checks.NOT_CHECKED), (3, "SPLIT_INVOICE", checks.NOT_CHECKED)]
    monkeypatch.setattr(checks, "all_checks", lambda d, approximate: spark.createDataFrame(rows, "id long, code string, status string"))
    got = {r.id: (r.evaluated, r.confidence, r.summary) for r in checks.risk_scores(None).collect()}
    assert got == {1: (18, "HIGH", "PASS"), 2: (17, "HIGH", "INCOMPLETE"), 3: (17, "HIGH", "PASS")}


def test_approximate_duplicates_add_to_the_risk(spark):
    d = Domain(spark, SF)
    weight = checks.WEIGHTS["APPROXIMATE_DUPLICATE"]
    plain = {r.id: r for r in checks.risk_scores(d).collect()}
    alike = {r.id: r.status for r in similar.approximate_duplicates(d).select("id", "status").collect()}
    full = {r.id: r for r in checks.risk_scores(d, approximate=True).collect()}
    assert full.keys() == plain.keys() and checks.WARNING in alike.values()
    for i, r in full.items():
        warned = alike.get(i) == checks.WARNING
        assert (r.score, r.warnings) == (min(100, plain[i].score + weight * warned), plain[i].warnings + warned)
        assert r.evaluated == plain[i].evaluated + (alike.get(i, checks.NOT_CHECKED) != checks.NOT_CHECKED)


def test_linked_lines_are_read_once_for_both_checks(spark):
    d = Domain(spark, SF)
    got = {(r.id, r.code): r.status for r in checks.linked_checks(d).collect()}
    want = {}
    for code, rows in (("PURCHASE_ORDER_LINES", checks.order_lines(d)), ("GOODS_RECEIPT_MATCH", checks.receipts(d))):
        for r in rows.select("id", "status").collect():
            want[r.id, code] = checks.WARNING if checks.WARNING in (want.get((r.id, code)), r.status) else checks.PASS
    assert got == want and set(want.values()) == {checks.WARNING, checks.PASS}
