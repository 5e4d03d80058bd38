"""Queries of intake and structured documents by name, and their SQL."""

from __future__ import annotations

from auditlake.operators import intake
from auditlake.plans.catalogue import SUB, V, m, p4, q4
from auditlake.sources import structured
from auditlake.sources.tables import Domain

COOL_DOWN = 3600


def _domain(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


QUERIES = {
    "po_header_match": _domain(intake.order_header_match),
    "submission_violations": _domain(intake.submission_violations),
    "extraction_scoreboard": _domain(intake.scoreboard),
    "admission_fold": _domain(lambda d: intake.admission(d.read("events"), COOL_DOWN)),
    "ubl_xml_lines": _domain(lambda d: structured.xml_lines(structured.xml_documents(d), "invoice_id", "xml")),
    "tlv_fields": _domain(lambda d: structured.payload_columns(structured.payloads(d), "id", "payload")),
}

ORACLE = {
    "po_header_match": V
    + """, om AS (SELECT id, po, CASE WHEN po IS NOT NULL THEN supplier_id = CASE WHEN k % 7 = 0 THEN supplier_id + 1 ELSE supplier_id END END AS s,
  CASE WHEN po IS NOT NULL THEN currency = CASE WHEN k % 9 = 0 THEN 'USD' ELSE currency END END AS c FROM hd)
SELECT id, po AS purchase_order_id, s AS supplier_match, c AS currency_match, CASE WHEN NOT s OR NOT c THEN 'WARNING' WHEN s AND c THEN 'PASS' ELSE 'NOT_CHECKED' END AS status FROM om""",
    "submission_violations": V
    + f""", sv AS (SELECT id, status, concat_ws(',', CASE WHEN number IS NULL THEN 'invoice_number' END, CASE WHEN invoice_date IS NULL THEN 'invoice_date' END,
  CASE WHEN supplier_id IS NULL THEN 'supplier_id' END, CASE WHEN total IS NULL THEN 'grand_total' END) AS missing FROM inv WHERE status IN {SUB})
SELECT * FROM sv WHERE missing <> ''""",
    "extraction_scoreboard": V
    + """, g AS (SELECT unnest(['all', currency, document_type, status, concat_ws('/', currency, document_type)]) AS grp, printed, total FROM inv)
SELECT grp, count(*) AS documents, count(printed) AS "read", count(*) FILTER (WHERE printed = total) AS correct FROM g GROUP BY 1""",
    "admission_fold": f"""WITH RECURSIVE n AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
f AS (SELECT user_id, i, t AS last, 1::BIGINT AS admitted, 0::BIGINT AS refused FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.i, CASE WHEN t - last < {COOL_DOWN}000000 THEN last ELSE t END, admitted + CASE WHEN t - last < {COOL_DOWN}000000 THEN 0 ELSE 1 END,
    refused + CASE WHEN t - last < {COOL_DOWN}000000 THEN 1 ELSE 0 END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, admitted, refused FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "ubl_xml_lines": V
    + f"""SELECT id AS invoice_id, lower(number) AS document_number, position::INTEGER AS position, 'Part ' || part AS description, 'PCE' AS unit_code, {q4('q', 'quantity')}, {p4('price', 'unit_price')}, tp::DECIMAL(7,4) AS tax_rate, {m('net', 'net_amount')},
  {m('CASE WHEN (id + position) % 31 <> 3 THEN disc END', 'discount_amount')} FROM it JOIN (SELECT id, number FROM hd) USING (id) WHERE (id + position) % 29 NOT IN (1, 2)""",
    "tlv_fields": V
    + """SELECT id, coalesce(s_name, 'Unknown') AS seller, lpad(inv.supplier_id::VARCHAR, 15, '3') AS tax_number, invoice_date::VARCHAR || 'T00:00:00Z' AS issued_at,
  ((total + CASE WHEN id % 9 = 0 THEN 500 ELSE 0 END)::DECIMAL(30,2) * 0.01::DECIMAL(3,2))::DECIMAL(22,2)::VARCHAR AS total, (tax::DECIMAL(30,2) * 0.01::DECIMAL(3,2))::DECIMAL(22,2)::VARCHAR AS tax_total
FROM inv LEFT JOIN supplier ON s_suppkey = inv.supplier_id WHERE invoice_date IS NOT NULL AND total IS NOT NULL AND inv.supplier_id IS NOT NULL AND id % 23 NOT BETWEEN 1 AND 7""",
}
