"""Queries of printed documents by name, and their SQL, which states what each of them prints and what is read from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import documents
from auditlake.plans.catalogue import V
from auditlake.plans.sources import COMPARISONS, VALUES
from auditlake.sources import structured
from auditlake.sources.tables import Domain


def _domain(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


def _fields(d: Domain):
    return documents.parsed_fields(documents.tokens_of(d))


QUERIES = {
    "document_lines": _domain(lambda d: documents.line_texts(documents.tokens_of(d)).select("doc_id", "line", "text", "rtl", "is_ocr", F.round("confidence", 2).alias("confidence"), F.round("y1", 3).alias("bottom"))),
    "parsed_fields": _domain(_fields),
    "totals_reconcile": _domain(lambda d: documents.totals_reconcile(_fields(d).filter("value is not null"))),
    "merged_fields": _domain(lambda d: documents.merged_fields(_fields(d).filter("value is not null"), documents.printed_sources(d))),
    "xml_source_comparison": _domain(structured.xml_comparison),
    "qr_source_comparison": _domain(structured.payload_comparison),
}

MONEY = "(({c})::DECIMAL(30,2) * 0.01::DECIMAL(3,2))::DECIMAL(22,2)::VARCHAR"
NUMBER = "replace(number, ' ', '-')"
PRINTED = f"""pt AS (SELECT id, supplier_id, {NUMBER} AS number, invoice_date AS d, currency, {MONEY.format(c='subtotal - discount')} AS net, {MONEY.format(c='tax')} AS vat, {MONEY.format(c='total')} AS total, {MONEY.format(c='total + 100')} AS more, total AS cents
  FROM inv WHERE invoice_date IS NOT NULL AND total IS NOT NULL AND number IS NOT NULL AND document_type = 'INVOICE')"""
COMMAS = "CASE WHEN id % 2 = 0 THEN format('{{:,}}', split_part({c}, '.', 1)::BIGINT) || '.' || split_part({c}, '.', 2) ELSE {c} END"
LINES = f"""pl0 AS (SELECT id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS line, unnest(['Supplier:', CASE WHEN id % 8 = 1 THEN 'رقم الفاتور' WHEN id % 4 = 1 THEN 'رقم الفاتورة' ELSE 'Invoice Number:' END, 'Invoice Date', 'Currency', 'Subtotal:', 'Total VAT', 'Grand Total:', 'Amount Due']) AS label,
  unnest(['Trader No ' || supplier_id, number, CASE WHEN id % 5 = 0 THEN strftime(d, '%d/%m/%Y') ELSE d::VARCHAR END, currency, {COMMAS.format(c='net')}, {COMMAS.format(c='vat')}, {COMMAS.format(c='total')}, CASE WHEN id % 7 = 0 THEN more ELSE {COMMAS.format(c='total')} END]) AS value FROM pt)"""
READ = """rd AS (SELECT id, 'supplier_name' AS field, 'Trader No ' || supplier_id AS value, 0.92 AS confidence, NULL AS warning FROM pt
  UNION ALL SELECT id, 'invoice_number', number, 0.93, CASE WHEN id % 8 = 1 THEN 'APPROXIMATE_LABEL_INVOICE_NUMBER' END FROM pt
  UNION ALL SELECT id, 'invoice_date', d::VARCHAR, 0.93, NULL FROM pt WHERE id % 5 <> 0 OR day(d) > 12 OR day(d) = month(d)
  UNION ALL SELECT id, 'currency', currency, 0.94, NULL FROM pt UNION ALL SELECT id, 'subtotal', net, 0.94, NULL FROM pt UNION ALL SELECT id, 'tax_total', vat, 0.93, NULL FROM pt
  UNION ALL SELECT id, 'grand_total', CASE WHEN id % 7 <> 0 THEN total END, CASE WHEN id % 7 <> 0 THEN 0.93 END, CASE WHEN id % 7 = 0 THEN 'AMBIGUOUS_GRAND_TOTAL' END FROM pt)"""
SOURCES = f"""so AS (SELECT id, 'XML' AS kind, 'invoice_number' AS field, lower(number) AS value FROM pt WHERE id % 2 = 0 UNION ALL SELECT id, 'XML', 'grand_total', total FROM pt WHERE id % 2 = 0
  UNION ALL SELECT id, 'QR', 'grand_total', {MONEY.format(c='cents + CASE WHEN id % 9 = 0 THEN 500 ELSE 0 END')} || '0' FROM pt WHERE id % 3 = 0)"""
KEY = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


ORACLE = {
    "document_lines": V + f", {PRINTED}, {LINES}, w AS (SELECT *, len(string_split(label || ' ' || value, ' ')) AS n FROM pl0) SELECT id AS doc_id, line::INTEGER AS line, label || ' ' || value AS text, regexp_matches(label, '[؀-ۿ]') AS rtl, true AS is_ocr, round(0.95 - 0.01 * (n - 1), 2)::DOUBLE AS confidence, round(0.05 + 0.06 * line + 0.001 * least(n - 1, 2) + 0.02, 3)::DOUBLE AS bottom FROM w",
    "parsed_fields": V + f", {PRINTED}, {READ} SELECT id AS doc_id, field, value, confidence::DOUBLE AS confidence, warning FROM rd",
    "totals_reconcile": V + f", {PRINTED} SELECT id AS doc_id, true AS reconciled FROM pt WHERE id % 7 <> 0",
    "merged_fields": V + f""", {PRINTED}, {READ}, {SOURCES}, t AS (SELECT id, field, count(DISTINCT CASE WHEN field = 'grand_total' THEN value::DECIMAL(22,4)::VARCHAR ELSE {KEY.format(c='value')} END) AS n, arg_min(value, CASE WHEN kind = 'XML' THEN 0 ELSE 1 END) AS taken FROM so GROUP BY ALL),
r AS (SELECT id, field, value FROM rd WHERE value IS NOT NULL), j AS (SELECT coalesce(r.id, t.id) AS id, coalesce(r.field, t.field) AS field, value, n, taken FROM r FULL JOIN t ON r.id = t.id AND r.field = t.field)
SELECT id AS doc_id, field, CASE WHEN n > 1 THEN NULL ELSE coalesce(taken, value) END AS value, CASE WHEN n > 1 THEN 'STRUCTURED_SOURCE_CONFLICT_' || upper(field) WHEN value <> taken THEN 'VISIBLE_TEXT_CONFLICT_' || upper(field) END AS warning FROM j""",
    "xml_source_comparison": V + f", {VALUES}, {COMPARISONS} SELECT * FROM xc",
    "qr_source_comparison": V + f", {VALUES}, {COMPARISONS} SELECT * FROM qc",
}
