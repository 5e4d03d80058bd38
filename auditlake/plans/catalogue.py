"""Queries by name, and the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import checks, events, prices, reports, scope
from auditlake.plans.sources import COMPARISONS, VALUES
from auditlake.sources.tables import Domain

CURRENCY, AS_OF = "SAR", "1998-06-15"


def _domain(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


def _events(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir).read("events"))


def _recipients(d: Domain):
    return d.spark.range(14).select((F.col("id") % 7).alias("sender"), (F.col("id") + 100).alias("recipient"))


QUERIES = {
    "line_calculation": _domain(checks.line_calculation),
    "invoice_totals": _domain(lambda d: d.invoices().select("id", "subtotal", "discount_total", "tax_total", "grand_total")),
    "document_total_checks": _domain(checks.document_totals),
    "exact_file_duplicates": _domain(lambda d: checks.file_duplicates(d.read("documents"), "source", F.sha2("text", 256))),
    "potential_duplicates": _domain(checks.potential_duplicates),
    "split_invoice": _domain(checks.split_invoices),
    "related_documents": _domain(checks.related_documents),
    "supplier_verification": _domain(checks.supplier_verification),
    "po_line_match": _domain(checks.order_lines),
    "receipt_match": _domain(checks.receipts),
    "budget_relevance": _domain(checks.budget_relevance),
    "budget_capacity": _domain(checks.budget_capacity),
    "budget_usage": _domain(checks.budget_usage),
    "price_history_exact": _domain(prices.price_history),
    "price_history_fuzzy": _domain(prices.price_history_fuzzy),
    "regional_price_exact": _domain(prices.regional_prices),
    "regional_price_report": _domain(prices.region_comparisons),
    "risk_scores": _domain(checks.risk_scores),
    "risk_scores_with_approximate": _domain(lambda d: checks.risk_scores(d, approximate=True)),
    "dashboard_summary": _domain(lambda d: reports.summary(d, CURRENCY)),
    "status_histogram": _domain(lambda d: reports.status_histogram(d, CURRENCY)),
    "monthly_trend": _domain(lambda d: reports.monthly_trend(d, CURRENCY, AS_OF)),
    "project_breakdown": _domain(lambda d: reports.project_breakdown(d, CURRENCY)),
    "supplier_top6": _domain(lambda d: reports.supplier_top(d, CURRENCY)),
    "exception_queue": _domain(lambda d: reports.exception_queue(d, CURRENCY)),
    "invoice_register": _domain(reports.register),
    "visible_invoices_finance": _domain(lambda d: scope.visible_to_finance(d, 1)),
    "visible_invoices_manager": _domain(lambda d: scope.visible_to_manager(d, 3)),
    "visible_invoices_employee": _domain(lambda d: scope.visible_to_employee(d, 2)),
    "approval_authority": _domain(scope.approval_authority),
    "approval_matrix": _domain(scope.approval_matrix),
    "uniqueness_violations": _domain(lambda d: reports.uniqueness_violations(d.read("lineitem"), "l_orderkey", "l_linenumber")),
    "offset_page": _domain(lambda d: reports.page(d, 3)),
    "latest_event_per_user": _events(events.latest),
    "sliding_failure_limiter": _events(lambda e: events.failure_limiter(e, 86_400, 2)),
    "workflow_fold": _events(events.fold_workflow),
    "tumbling_event_counts": _events(lambda e: events.tumbling(e, "1 hour")),
    "session_events": _events(lambda e: events.sessions(e, "30 minutes")),
    "json_props_extract": _events(events.properties),
    "notifications_fanout": _domain(lambda d: events.fan_out(d.read("events"), _recipients(d))),
}

SUB = "('PROJECT_REVIEW', 'FINANCE_REVIEW', 'APPROVED')"
CNT = "('PROJECT_REVIEW', 'FINANCE_REVIEW', 'APPROVED', 'CHANGES_REQUESTED')"
#: Amounts are whole cents, prices whole ten-thousandths; m() and p() turn them into decimals.
V = """WITH s AS (SELECT greatest(1, count(*) // 5) AS n FROM supplier),
h0 AS (SELECT o_orderkey AS id, o_orderkey AS k, o_custkey % n AS supplier_id, o_custkey % n % 2 AS company_id, o_custkey % n % 2 * 5 + o_custkey % 5 AS project_id,
  o_custkey % 7 AS created_by, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate::DATE END AS invoice_date, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 + o_orderkey AS created_at,
  CASE o_custkey % 4 WHEN 1 THEN 'AED' WHEN 2 THEN 'USD' ELSE 'SAR' END AS currency,
  CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PROJECT_REVIEW' ELSE 'FINANCE_REVIEW' END
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'CHANGES_REQUESTED' ELSE 'REJECTED' END END AS status,
  CASE o_orderkey % 20 WHEN 0 THEN 'CREDIT_NOTE' WHEN 1 THEN 'DEBIT_NOTE' ELSE 'INVOICE' END AS document_type,
  CASE WHEN o_orderkey % 20 < 2 THEN o_orderkey - o_orderkey % 20 + 2 END AS related, CASE WHEN o_orderkey % 103 <> 0 THEN 'INV-' || o_orderkey END AS number,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS po FROM orders, s),
hd AS (SELECT * FROM h0 UNION ALL SELECT * REPLACE (id + 1000000000 AS id, 'inv ' || id AS number, created_at + 1000000000 AS created_at) FROM h0 WHERE id % 50 = 2),
l0 AS (SELECT l_orderkey AS id, l_orderkey AS k, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS position,
  round(l_quantity)::BIGINT AS q, round(l_extendedprice * 100)::BIGINT AS gross, round(l_discount * 100)::BIGINT AS dp, round(l_tax * 100)::BIGINT AS tp FROM lineitem),
l1 AS (SELECT *, (gross * dp * 2 + 100) // 200 AS disc FROM l0),
l2 AS (SELECT *, gross - disc AS net, ((gross - disc) * tp * 2 + 100) // 200 AS tax, (gross * 200 + q) // (2 * q) AS price, ((gross - disc) * 200 + q) // (2 * q) AS eff FROM l1),
it AS (SELECT * FROM l2 UNION ALL SELECT * REPLACE (id + 1000000000 AS id) FROM l2 WHERE id % 50 = 2),
tt AS (SELECT id, sum(gross)::BIGINT AS subtotal, sum(disc)::BIGINT AS discount, sum(tax)::BIGINT AS tax, sum(net + tax)::BIGINT AS total FROM it GROUP BY id),
inv AS (SELECT hd.*, subtotal, discount, tax, total, CASE WHEN k % 13 <> 0 THEN total + CASE WHEN k % 11 = 0 THEN 100 ELSE 0 END END AS printed,
  CASE WHEN document_type = 'CREDIT_NOTE' THEN -coalesce(total, 0) ELSE coalesce(total, 0) END AS signed,
  nullif(regexp_replace(lower(number), '[^\\p{L}\\p{N}]', '', 'g'), '') AS nkey FROM hd LEFT JOIN tt USING (id)),
sup AS (SELECT s_suppkey AS supplier_id, s_suppkey % 2 AS owner, r_name AS region, CASE s_suppkey % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'REJECTED' ELSE 'UNVERIFIED' END AS verification
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
lim AS (SELECT DISTINCT project_id, currency, 100 + project_id * 2 + x AS user_id, (50000 + 25000 * (project_id % 4) + 10000 * x) * 100 AS amount FROM hd, (SELECT unnest([0, 1]) AS x)),
bud AS (SELECT DISTINCT project_id, currency, 1000000000 * (1 + project_id % 3) AS budget FROM hd)
"""


def m(c: str, alias: str) -> str:
    return f"(({c})::DECIMAL(30,2) * 0.01::DECIMAL(3,2))::DECIMAL(22,2) AS {alias}"


def p4(c: str, alias: str) -> str:
    return f"(({c})::DECIMAL(30,4) * 0.0001::DECIMAL(5,4))::DECIMAL(22,4) AS {alias}"


def q4(c: str, alias: str) -> str:
    return f"(({c})::DECIMAL(14,4)) AS {alias}"


SPLIT = f"""sp0 AS (SELECT inv.*, threshold FROM inv LEFT JOIN (SELECT project_id, currency, min(amount) AS threshold FROM lim GROUP BY ALL) USING (project_id, currency)
  WHERE document_type = 'INVOICE' AND invoice_date IS NOT NULL AND total IS NOT NULL AND supplier_id IS NOT NULL),
sp1 AS (SELECT *, status IN {SUB} AS o, count(CASE WHEN status IN {SUB} THEN 1 END) OVER w AS n, sum(CASE WHEN status IN {SUB} THEN total END) OVER w AS s, max(CASE WHEN status IN {SUB} THEN total END) OVER w AS mx
  FROM sp0 WINDOW w AS (PARTITION BY company_id, project_id, supplier_id, currency ORDER BY date_diff('day', DATE '1970-01-01', invoice_date) RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
sp AS (SELECT id, threshold, n + CASE WHEN o THEN 0 ELSE 1 END AS match_count, coalesce(s, 0) + CASE WHEN o THEN 0 ELSE total END AS combined, greatest(coalesce(mx, total), total) AS largest FROM sp1),
split AS (SELECT *, CASE WHEN threshold IS NULL THEN 'NOT_CHECKED' WHEN match_count >= 2 AND largest <= threshold AND combined > threshold THEN 'WARNING' ELSE 'PASS' END AS status FROM sp)"""
RELATED = f"""rn AS (SELECT related AS original, company_id, project_id, sum(CASE WHEN document_type = 'INVOICE' THEN 0 ELSE signed END) AS notes, count(*) AS n FROM inv WHERE status IN {SUB} AND related IS NOT NULL GROUP BY ALL),
ra AS (SELECT i.id, i.total AS dv, i.total + coalesce(notes, 0) AS balance, coalesce(n, 0) AS match_count, CASE WHEN i.total + coalesce(notes, 0) < 0 THEN 'WARNING' ELSE 'PASS' END AS status
  FROM inv i LEFT JOIN rn ON original = i.id AND rn.company_id = i.company_id AND rn.project_id = i.project_id WHERE document_type = 'INVOICE'),
rb0 AS (SELECT i.id, coalesce(o.total, 0) AS t, o.id IS NOT NULL AS valid, o.supplier_id IS NOT DISTINCT FROM i.supplier_id AND o.currency IS NOT DISTINCT FROM i.currency AS same, i.status IN {SUB} AS sub, i.signed, notes, n
  FROM inv i LEFT JOIN inv o ON o.id = i.related AND o.company_id = i.company_id AND o.project_id = i.project_id AND o.document_type = 'INVOICE'
  LEFT JOIN rn ON original = i.related AND rn.company_id = i.company_id AND rn.project_id = i.project_id WHERE i.document_type <> 'INVOICE'),
rb AS (SELECT id, CASE WHEN valid THEN t END AS dv, CASE WHEN valid THEN t + coalesce(notes, 0) + CASE WHEN sub THEN 0 ELSE signed END END AS balance, CASE WHEN valid THEN coalesce(n, 0) + CASE WHEN sub THEN 0 ELSE 1 END ELSE 0 END AS match_count, valid, same FROM rb0),
rel AS (SELECT * FROM ra UNION ALL SELECT id, dv, balance, match_count, CASE WHEN NOT valid OR NOT same OR balance < 0 THEN 'WARNING' ELSE 'PASS' END FROM rb)"""
LINKED = f"""ll AS (SELECT it.id, position, q, price, tp, hd.po, hd.status IN {SUB} AS o FROM it JOIN hd USING (id) WHERE hd.po IS NOT NULL),
lb AS (SELECT po, position, sum(CASE WHEN o THEN q ELSE 0 END) AS others FROM ll GROUP BY ALL),
lo AS (SELECT k AS po, position, q + position % 3 - 1 AS ordered, CASE WHEN position % 4 = 0 THEN price + 10000 ELSE price END AS oprice, CASE WHEN position % 5 <> 0 THEN q - position % 2 ELSE 0 END AS received FROM it WHERE id < 1000000000 AND k % 3 = 0),
lk AS (SELECT ll.*, others + CASE WHEN o THEN 0 ELSE q END AS billed, ordered, oprice, received FROM ll JOIN lb USING (po, position) JOIN lo USING (po, position))"""
CAP = f"""cu AS (SELECT project_id, currency, sum(CASE WHEN status IN {CNT} THEN signed ELSE 0 END) AS used, count(CASE WHEN status IN {CNT} THEN 1 END) AS n FROM inv GROUP BY ALL),
cap AS (SELECT id, used - CASE WHEN status IN {CNT} THEN signed ELSE 0 END AS before, budget - (used - CASE WHEN status IN {CNT} THEN signed ELSE 0 END) - signed AS remaining, n - CASE WHEN status IN {CNT} THEN 1 ELSE 0 END AS match_count, total FROM inv JOIN bud USING (project_id, currency) JOIN cu USING (project_id, currency)),
capacity AS (SELECT *, CASE WHEN total IS NULL THEN 'NOT_CHECKED' WHEN remaining < 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM cap)"""
DUP = """dr AS (SELECT * FROM inv WHERE supplier_id IS NOT NULL AND invoice_date IS NOT NULL AND total IS NOT NULL AND nkey IS NOT NULL),
dup AS (SELECT inv.id, coalesce(n, 0) AS match_count, CASE WHEN n IS NULL THEN 'NOT_CHECKED' WHEN n > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM inv LEFT JOIN
  (SELECT id, count(*) OVER (PARTITION BY company_id, document_type, supplier_id, invoice_date, currency, total, nkey) - 1 AS n FROM dr) USING (id))"""
RELV = """rv AS (SELECT hd.id, count(it.id) AS lines, count(CASE WHEN part % 6 = 5 THEN 1 END) AS unlinked FROM hd LEFT JOIN it USING (id) GROUP BY hd.id)"""
VER = """ver AS (SELECT id, verification, CASE WHEN owner <> company_id THEN 'WARNING' WHEN verification = 'VERIFIED' THEN 'PASS' WHEN verification = 'REJECTED' THEN 'WARNING' ELSE 'NOT_CHECKED' END AS status FROM inv LEFT JOIN sup USING (supplier_id))"""
DOCT = """doct AS (SELECT id, printed, total, printed - total AS diff, CASE WHEN printed IS NULL OR total IS NULL THEN 'NOT_CHECKED' WHEN printed <> total THEN 'WARNING' ELSE 'PASS' END AS status FROM inv)"""
LEVEL = "CASE WHEN score >= 50 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level"
PL = """pl AS (SELECT it.id, position, eff, q, lower(p_name) AS phrase, CASE p_size % 3 WHEN 2 THEN 'kg' ELSE 'piece' END AS unit, company_id, supplier_id, currency, invoice_date AS day, created_at, status
  FROM it JOIN hd USING (id) JOIN part ON p_partkey = part WHERE document_type = 'INVOICE' AND invoice_date IS NOT NULL)"""
#: Quantiles in 4 * ten-thousandths, so that quarters are whole.
QUANT = "(4 * x[(len(x) - 1) * {k} // 4 + 1] + ((len(x) - 1) * {k} % 4) * (coalesce(x[(len(x) - 1) * {k} // 4 + 2], 0) - x[(len(x) - 1) * {k} // 4 + 1]))"
HALF = "((({c}) * 2 + {d}) // (2 * {d}))"
REGIONAL = f"""{PL}, pr AS (SELECT pl.*, region FROM pl JOIN sup USING (supplier_id) WHERE region IS NOT NULL),
c AS (SELECT f.id, f.position, h.id AS hid, arg_min(h.eff, h.position) AS hp, any_value(h.supplier_id) AS hs, any_value(h.region) AS hregion, any_value(h.day) AS hday FROM pr f JOIN pr h ON f.company_id = h.company_id AND f.currency = h.currency AND f.unit = h.unit AND f.phrase = h.phrase
  AND length(f.phrase) >= 6 AND h.day BETWEEN f.day - 365 AND f.day AND h.created_at < f.created_at AND h.id <> f.id WHERE h.status IN {SUB} GROUP BY ALL)"""
ME = "SELECT DISTINCT project_id, x AS user_id, CASE WHEN project_id % 7 = x THEN 'MANAGER' WHEN (project_id + x) % 3 = 0 THEN 'MEMBER' END AS role FROM hd, (SELECT unnest(range(0, 7)) AS x)"
VAL = f"val AS (SELECT * FROM inv WHERE currency = '{CURRENCY}' AND status <> 'DRAFT')"
APP, REV = "coalesce(sum(signed) FILTER (WHERE status = 'APPROVED'), 0)", "coalesce(sum(signed) FILTER (WHERE status IN ('PROJECT_REVIEW', 'FINANCE_REVIEW')), 0)"
STEP_SQL = " ".join(f"WHEN state = '{s}' AND action = '{a}' THEN '{t}'" for (s, a), t in events.STEPS.items())
SAFE = "CASE WHEN regexp_matches(coalesce({c}, ''), '^\\s*[=+@-]') THEN '''' || {c} ELSE coalesce({c}, '') END"

ORACLE = {
    "line_calculation": V + f"SELECT id AS invoice_id, position::INTEGER AS position, {q4('q', 'quantity')}, {p4('price', 'unit_price')}, {m('gross', 'gross_amount')}, {m('disc', 'discount_amount')}, {m('net', 'net_amount')}, {m('tax', 'tax_amount')}, {m('net + tax', 'total_amount')}, {p4('eff', 'effective_price')} FROM it",
    "invoice_totals": V + f"SELECT id, {m('subtotal', 'subtotal')}, {m('discount', 'discount_total')}, {m('tax', 'tax_total')}, {m('total', 'grand_total')} FROM inv",
    "document_total_checks": V + f", {DOCT} SELECT id, {m('printed', 'document_value')}, {m('total', 'calculated_value')}, {m('diff', 'difference')}, status FROM doct",
    "exact_file_duplicates": "WITH d AS (SELECT doc_id, source, sha256(text) AS sha256 FROM documents) SELECT *, count(*) OVER (PARTITION BY source, sha256) - 1 AS match_count, CASE WHEN count(*) OVER (PARTITION BY source, sha256) > 1 THEN 'WARNING' ELSE 'PASS' END AS status FROM d",
    "potential_duplicates": V + f", {DUP} SELECT id, match_count, status FROM dup",
    "split_invoice": V + f", {SPLIT} SELECT id, {m('threshold', 'threshold')}, match_count::BIGINT AS match_count, {m('combined', 'combined')}, status FROM split",
    "related_documents": V + f", {RELATED} SELECT id, {m('dv', 'document_value')}, {m('balance', 'balance')}, match_count::BIGINT AS match_count, status FROM rel",
    "supplier_verification": V + f", {VER} SELECT * FROM ver",
    "po_line_match": V + f", {LINKED} SELECT id, position::INTEGER AS position, price = oprice AS price_match, true AS tax_match, billed::DECIMAL(18,4) AS billed, ordered::DECIMAL(14,4) AS ordered, CASE WHEN price <> oprice OR billed > ordered THEN 'WARNING' ELSE 'PASS' END AS status FROM lk",
    "receipt_match": V + f", {LINKED} SELECT id, position::INTEGER AS position, billed::DECIMAL(18,4) AS billed, received::DECIMAL(14,4) AS received, CASE WHEN received < billed THEN 'WARNING' ELSE 'PASS' END AS status FROM lk",
    "budget_relevance": V + f", {RELV} SELECT *, CASE WHEN lines = 0 THEN 'NOT_CHECKED' WHEN unlinked > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM rv",
    "budget_capacity": V + f", {CAP} SELECT id, {m('before', 'exposure_before')}, {m('remaining', 'remaining')}, match_count::BIGINT AS match_count, status FROM capacity",
    "budget_usage": V + f", u AS (SELECT project_id, currency, {APP} AS a, coalesce(sum(signed) FILTER (WHERE status = 'FINANCE_REVIEW'), 0) AS c, coalesce(sum(signed) FILTER (WHERE status IN ('PROJECT_REVIEW', 'CHANGES_REQUESTED')), 0) AS p FROM inv GROUP BY ALL) SELECT project_id, currency, {m('budget', 'budget')}, {m('a', 'approved')}, {m('c', 'committed')}, {m('p', 'pending')}, {m('a + c + p', 'exposure')}, {m('budget - a - c - p', 'remaining')} FROM bud JOIN u USING (project_id, currency)",
    "price_history_exact": V + f""", {PL},
c AS (SELECT f.id, f.position, h.id AS hid, arg_min(h.eff, h.position) AS hp FROM pl f JOIN pl h ON f.company_id = h.company_id AND f.supplier_id = h.supplier_id AND f.currency = h.currency AND f.unit = h.unit AND f.phrase = h.phrase
  AND length(f.phrase) >= 6 AND h.day BETWEEN f.day - 365 AND f.day AND h.created_at < f.created_at AND h.id <> f.id WHERE h.status IN {SUB} GROUP BY ALL),
g AS (SELECT pl.id, pl.position, any_value(eff) AS price, count(hp) AS n, list(hp ORDER BY hp) FILTER (WHERE hp IS NOT NULL) AS x FROM pl LEFT JOIN c ON c.id = pl.id AND c.position = pl.position GROUP BY ALL),
r AS (SELECT *, CASE WHEN n >= 3 THEN {QUANT.format(k=1)} END AS a, CASE WHEN n >= 3 THEN {QUANT.format(k=2)} END AS b, CASE WHEN n >= 3 THEN {QUANT.format(k=3)} END AS c FROM g),
t AS (SELECT *, CASE WHEN b > 0 THEN greatest(10 * c + 15 * (c - a), 12 * b) END AS lim FROM r)
SELECT id AS invoice_id, position::INTEGER AS position, n AS samples, {p4('price', 'price')}, {p4(HALF.format(c='b', d=4), 'median')}, {p4(HALF.format(c='a', d=4), 'q1')}, {p4(HALF.format(c='c', d=4), 'q3')}, {p4(HALF.format(c='lim', d=40), 'threshold')},
  CASE WHEN lim IS NULL THEN 'NOT_CHECKED' WHEN price * 40 > lim THEN 'WARNING' ELSE 'PASS' END AS status, CASE WHEN lim IS NOT NULL THEN CASE WHEN n >= 6 THEN 'HIGH' ELSE 'MEDIUM' END END AS confidence FROM t""",
    "regional_price_exact": V + f""", {REGIONAL},
g AS (SELECT pr.id, pr.position, any_value(pr.eff) AS price, any_value(pr.q) AS q, count(hid) AS samples, count(DISTINCT hs) AS suppliers, count(DISTINCT hregion) AS regions, count(*) FILTER (WHERE hregion = pr.region) AS local, list(hp ORDER BY hp) FILTER (WHERE hregion = pr.region) AS x FROM pr LEFT JOIN c ON c.id = pr.id AND c.position = pr.position GROUP BY ALL),
r AS (SELECT *, CASE WHEN samples >= 3 AND suppliers >= 2 AND regions >= 2 AND local >= 2 THEN {QUANT.format(k=2)} END AS b FROM g)
SELECT id AS invoice_id, position::INTEGER AS position, samples, suppliers, regions, local, {p4('price', 'price')}, {p4(HALF.format(c='b', d=4), 'median')}, {p4(HALF.format(c='CASE WHEN b > 0 THEN greatest(4 * price - b, 0) * q END', d=4), 'saving')},
  CASE WHEN coalesce(b, 0) <= 0 THEN 'NOT_CHECKED' WHEN (4 * price - b) * 100 >= b * 20 THEN 'WARNING' ELSE 'PASS' END AS status, CASE WHEN b > 0 THEN CASE WHEN samples >= 6 AND suppliers >= 3 AND regions >= 3 THEN 'HIGH' ELSE 'MEDIUM' END END AS confidence FROM r""",
    "regional_price_report": V + f""", {REGIONAL},
e AS (SELECT DISTINCT c.id, pr.unit, pr.phrase, pr.region, hid, hp, hs, hregion, hday FROM c JOIN pr ON c.id = pr.id AND c.position = pr.position),
g AS (SELECT id, unit, phrase, region, hregion, count(*) AS invoices, count(DISTINCT hs) AS suppliers, min(hday) AS date_from, max(hday) AS date_to, list(hp ORDER BY hp) AS x FROM e GROUP BY ALL),
r AS (SELECT *, {HALF.format(c=QUANT.format(k=2), d=4)} AS b FROM g)
SELECT id AS invoice_id, unit, phrase, region, row_number() OVER (PARTITION BY id, unit, phrase ORDER BY hregion <> region, b, hregion)::INTEGER AS number, hregion AS compared_region, {p4('b', 'median')}, invoices, suppliers, date_from, date_to FROM r""",
    "dashboard_summary": V + f", {VAL} SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'APPROVED') AS approved_documents, count(*) FILTER (WHERE status IN ('PROJECT_REVIEW', 'FINANCE_REVIEW')) AS review_documents, {m(APP, 'approved_net')}, {m(REV, 'review_net')} FROM val",
    "status_histogram": V + f", {VAL} SELECT x AS status, count(id) AS n FROM (SELECT unnest({list(reports.STATUSES)}) AS x) LEFT JOIN val ON status = x GROUP BY x",
    "monthly_trend": V + f", {VAL}, mm AS (SELECT strftime(unnest(range(date_trunc('month', DATE '{AS_OF}') - INTERVAL 5 MONTH, date_trunc('month', DATE '{AS_OF}') + INTERVAL 1 DAY, INTERVAL 1 MONTH)), '%Y-%m') AS month) SELECT month, {m('coalesce(sum(signed), 0)', 'amount')} FROM mm LEFT JOIN val ON status = 'APPROVED' AND strftime(invoice_date, '%Y-%m') = month GROUP BY month",
    "project_breakdown": V + f", {VAL}, pj AS (SELECT DISTINCT project_id FROM hd) SELECT project_id, count(id) AS documents, {m(APP, 'approved_net')}, {m(REV, 'review_net')} FROM pj LEFT JOIN val USING (project_id) GROUP BY project_id",
    "supplier_top6": V + f", {VAL}, t AS (SELECT supplier_id, sum(signed) AS v, count(*) AS documents FROM val WHERE status = 'APPROVED' GROUP BY 1 ORDER BY abs(sum(signed)) DESC, supplier_id LIMIT 6) SELECT supplier_id, {m('v', 'approved_net')}, documents FROM t",
    "invoice_register": V + f"SELECT id, {SAFE.format(c='number')} AS number, document_type, status, currency, invoice_date, {SAFE.format(c='region')} AS region, {m('total', 'total')}, {m('signed', 'signed_total')} FROM inv LEFT JOIN sup USING (supplier_id) WHERE status <> 'DRAFT'",
    "visible_invoices_finance": V + "SELECT id, project_id, status FROM hd WHERE company_id = 1 AND status <> 'DRAFT'",
    "visible_invoices_manager": V + f", me AS ({ME}) SELECT id, project_id, status FROM hd WHERE status <> 'DRAFT' AND project_id IN (SELECT project_id FROM me WHERE user_id = 3 AND role = 'MANAGER')",
    "visible_invoices_employee": V + f", me AS ({ME}) SELECT id, project_id, status FROM hd WHERE created_by = 2 AND project_id IN (SELECT project_id FROM me WHERE user_id = 2 AND role IS NOT NULL)",
    "approval_authority": V + f"SELECT id, user_id, {m('amount', 'amount')}, coalesce(total <= amount, false) AS within FROM inv JOIN lim USING (project_id, currency) WHERE status = 'PROJECT_REVIEW'",
    "approval_matrix": V + "SELECT user_id, " + ", ".join(m(f"max(amount) FILTER (WHERE currency = '{c}')", c.lower()) for c in ("SAR", "AED", "USD")) + " FROM lim GROUP BY user_id",
    "uniqueness_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "offset_page": V + "SELECT id, created_at, status FROM hd ORDER BY created_at DESC, id LIMIT 50 OFFSET 100",
    "latest_event_per_user": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "sliding_failure_limiter": "SELECT event_id, user_id, n, n >= 2 AS blocked FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')",
    "workflow_fold": f"""WITH RECURSIVE a AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'SUBMIT' WHEN 'purchase' THEN 'APPROVE' WHEN 'view' THEN 'REQUEST_CHANGES' WHEN 'error' THEN 'REJECT' END AS action, ts, event_id FROM events),
n AS (SELECT user_id, action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM a WHERE action IS NOT NULL),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'DRAFT' AS state, 0::BIGINT AS moves FROM n
  UNION ALL SELECT n.user_id, n.i, coalesce(CASE {STEP_SQL} END, state), moves + CASE WHEN CASE {STEP_SQL} END IS NULL THEN 0 ELSE 1 END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, state, moves FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "tumbling_event_counts": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "session_events": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, no",
    "json_props_extract": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "notifications_fanout": "SELECT recipient, event_type, ts::DATE AS day, min(event_id) AS event_id FROM events JOIN (SELECT x % 7 AS sender, x + 100 AS recipient FROM (SELECT unnest(range(0, 14)) AS x)) ON user_id % 7 = sender GROUP BY ALL",
}

#: The printed totals and what is added to them on every eleventh document, in cents.
PRINTED = {"DOCUMENT_SUBTOTAL": ("subtotal - discount", 100), "DOCUMENT_TAX_TOTAL": ("tax", 0), "DOCUMENT_GRAND_TOTAL": ("total", 100)}
HEADER = """hm AS (SELECT id, CASE WHEN po IS NULL THEN 'NOT_CHECKED' WHEN k % 7 = 0 OR (k % 9 = 0 AND currency <> 'USD') THEN 'WARNING' ELSE 'PASS' END AS status FROM hd)"""
WORST = "SELECT invoice_id, '{}', CASE WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END FROM ({}) WHERE status <> 'NOT_CHECKED' GROUP BY 1"
RISK = f"""{VALUES}, {COMPARISONS}, {DUP}, {VER}, {RELATED}, {LINKED}, {SPLIT}, {RELV}, {CAP}, {HEADER},
att AS (SELECT hd.id, company_id, sha256(text) AS sha FROM hd JOIN documents ON doc_id = k % (SELECT count(*) FROM documents)),
al AS ({" UNION ALL ".join(f"SELECT id, '{code}' AS code, CASE WHEN k % 13 = 0 OR {v} IS NULL THEN 'NOT_CHECKED' WHEN k % 11 = 0 AND {add} <> 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM inv" for code, (v, add) in PRINTED.items())}
  UNION ALL SELECT id, 'EXACT_FILE_DUPLICATE', CASE WHEN n > 1 THEN 'WARNING' ELSE 'PASS' END FROM hd LEFT JOIN (SELECT id, count(*) OVER (PARTITION BY company_id, sha) AS n FROM att) USING (id)
  UNION ALL SELECT id, 'POTENTIAL_DUPLICATE', status FROM dup
  UNION ALL {WORST.format("HISTORICAL_PRICE_ANOMALY", ORACLE["price_history_exact"])}
  UNION ALL {WORST.format("REGIONAL_SUPPLIER_PRICE", ORACLE["regional_price_exact"])}
  UNION ALL SELECT id, 'SUPPLIER_VERIFICATION', status FROM ver UNION ALL SELECT id, 'RELATED_FINANCIAL_DOCUMENT', status FROM rel UNION ALL SELECT id, 'PURCHASE_ORDER_HEADER', status FROM hm
  UNION ALL SELECT id, 'PURCHASE_ORDER_LINES', CASE WHEN bool_or(price <> oprice OR billed > ordered) THEN 'WARNING' ELSE 'PASS' END FROM lk GROUP BY id
  UNION ALL SELECT id, 'GOODS_RECEIPT_MATCH', CASE WHEN bool_or(received < billed) THEN 'WARNING' ELSE 'PASS' END FROM lk GROUP BY id
  UNION ALL SELECT id, 'SPLIT_INVOICE', status FROM split UNION ALL SELECT id, 'XML_SOURCE_COMPARISON', status FROM xc UNION ALL SELECT id, 'QR_SOURCE_COMPARISON', status FROM qc
  UNION ALL SELECT id, 'PROJECT_BUDGET_RELEVANCE', CASE WHEN lines = 0 THEN 'NOT_CHECKED' WHEN unlinked > 0 THEN 'WARNING' ELSE 'PASS' END FROM rv
  UNION ALL SELECT id, 'PROJECT_BUDGET_CAPACITY', status FROM capacity),
w AS (SELECT unnest({list(checks.WEIGHTS)}) AS code, unnest({list(checks.WEIGHTS.values())}) AS w),
risk AS (SELECT id, least(sum(CASE WHEN status = 'WARNING' THEN w ELSE 0 END), 100)::BIGINT AS score, count(*) FILTER (WHERE status = 'WARNING') AS warnings, count(*) FILTER (WHERE status <> 'NOT_CHECKED') AS evaluated,
  bool_or(status = 'NOT_CHECKED' AND code IN {checks.FIRST}) AS open FROM al JOIN w USING (code) GROUP BY id)"""
ORACLE |= {
    "risk_scores": V + f", {RISK} SELECT id, score, warnings, evaluated, {LEVEL}, CASE WHEN evaluated >= 10 THEN 'HIGH' WHEN evaluated >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN warnings > 0 THEN 'NEEDS_REVIEW' WHEN open THEN 'INCOMPLETE' ELSE 'PASS' END AS summary FROM risk",
    "exception_queue": V + f", {RISK} SELECT id, project_id, score, {LEVEL} FROM risk JOIN hd USING (id) WHERE score > 0 AND currency = '{CURRENCY}' AND status IN ('PROJECT_REVIEW', 'FINANCE_REVIEW') ORDER BY score DESC, id LIMIT 10",
}
