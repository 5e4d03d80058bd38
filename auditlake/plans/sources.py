"""SQL of structured sources against confirmed documents, on top of the audit domain's views."""

from __future__ import annotations

#: Confirmed values of each document (c_), and what its XML (x_) and payload (q_) hold where it is accepted; amounts in cents.
VALUES = """cf AS (SELECT inv.id, inv.id % 2 = 0 AND total IS NOT NULL AS xml, s_name AS c_name, lpad(inv.supplier_id::VARCHAR, 15, '3') AS c_tax, number AS c_number, invoice_date::VARCHAR AS c_day, currency AS c_currency,
  CASE WHEN k % 13 = 0 OR k % 11 <> 0 THEN subtotal - discount ELSE subtotal - discount + 100 END AS c_net, tax AS c_vat, coalesce(printed, total) AS c_total, subtotal - discount AS net, tax AS vat, total,
  inv.id % 3 = 0 AND total IS NOT NULL AND inv.supplier_id IS NOT NULL AND invoice_date IS NOT NULL AND inv.id % 23 NOT BETWEEN 1 AND 7 AS qr FROM inv LEFT JOIN supplier ON s_suppkey = inv.supplier_id)"""


def _compared(name: str, held: str, pairs: list[tuple[str, str]]) -> str:
    """A named table of each document's comparisons; pairs of SQL for (given, confirmed), what is not given is null."""
    given = lambda g: f"({g}) IS NOT NULL"
    count = lambda f: " + ".join(f"CASE WHEN {f(g, c)} THEN 1 ELSE 0 END" for g, c in pairs)
    sums = {"compared": count(lambda g, c: f"{given(g)} AND ({c}) IS NOT NULL"), "mismatches": count(lambda g, c: f"({g}) <> ({c})"), "not_comparable": count(lambda g, c: f"{given(g)} AND ({c}) IS NULL")}
    columns = ", ".join(f"(CASE WHEN {held} THEN {v} ELSE 0 END)::BIGINT AS {a}" for a, v in sums.items())
    return f"{name}0 AS (SELECT id, {columns} FROM cf), {name} AS (SELECT *, CASE WHEN mismatches > 0 THEN 'WARNING' WHEN compared > 0 THEN 'PASS' ELSE 'NOT_CHECKED' END AS status FROM {name}0)"


XML_PAIRS = [("1", "1"), ("lower(CASE WHEN id % 19 = 8 THEN 'Other' ELSE c_name END)", "lower(c_name)"), ("c_tax", "c_tax"), ("c_number", "c_number"), ("CASE WHEN id % 19 <> 3 THEN c_day END", "c_day"), ("c_currency", "c_currency"),
    ("net", "c_net"), ("CASE WHEN id % 19 <> 4 THEN vat END", "c_vat"), ("CASE WHEN id % 19 = 5 THEN total + 500 ELSE total END", "c_total")]
QR_PAIRS = [("coalesce(c_name, 'Unknown')", "c_name"), ("c_tax", "c_tax"), ("c_day", "c_day"), ("vat", "c_vat"), ("CASE WHEN id % 9 = 0 THEN total + 500 ELSE total END", "c_total")]
COMPARISONS = f"{_compared('xc', 'xml', XML_PAIRS)}, {_compared('qc', 'qr', QR_PAIRS)}"
