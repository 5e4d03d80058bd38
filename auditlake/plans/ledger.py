"""Queries of budgets, orders, scopes, jobs and inboxes by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import budgets, jobs, reports, similar
from auditlake.plans.catalogue import APP, CNT, CURRENCY, LINKED, ME, REV, RISK, SAFE, SUB, VAL, V, m
from auditlake.sources.tables import Domain, new_folder
from auditlake.streaming import queue

ACTIVE = 100


def _domain(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


def _events(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir).read("events"))


def _kept(events, name: str):
    """(folder, schema) of rows as files that a stream reads."""
    path = new_folder(events.sparkSession, name)
    events.write.parquet(path)
    return path, events.schema


def _stream(spark, path: str, schema):
    return spark.readStream.schema(schema).parquet(path)


def first_claims(events):
    """The first claim of each job of the log, from the stream of its messages."""
    spark = events.sparkSession
    rows = queue.replayed(queue.leases(_stream(spark, *_kept(queue.messages(events), "messages")), "0 seconds"), "leases")
    first = F.min_by(F.struct("new_state", "error", "new_attempts"), F.struct("at", "new_attempts")).alias("c")
    return rows.groupBy("job_id").agg(first).select("job_id", "c.new_state", "c.error", "c.new_attempts")


def _outcomes(rows, judge, schema: str, name: str):
    spark, out = rows.sparkSession, new_folder(rows.sparkSession, name)
    queue.judged(_stream(spark, *_kept(rows, f"{name}-in")), judge, schema, out, f"{out}-checkpoint").awaitTermination()
    return queue.outcomes(spark, out, schema)


def fenced_stream(events):
    """Results of the log, fenced in a stream by the revisions that hold at its end."""
    current = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("current"))
    results = jobs.fenced_results(events).select("event_id", "user_id", "revision")
    return _outcomes(results, queue.fence(lambda: current), queue.FENCED, "fenced").select("event_id", "user_id", "revision", "current", "accepted")


def ingest_stream(events):
    """Requests of the log as a stream takes them in."""
    return _outcomes(events, queue.ingest, queue.INGESTED, "ingested").select("event_id", "fingerprint", "first_id", "state")


QUERIES = {
    "approximate_duplicates": _domain(similar.approximate_duplicates),
    "budget_line_usage": _domain(budgets.budget_line_usage),
    "project_budget_report": _domain(budgets.project_report),
    "archived_line_items": _domain(budgets.archived_line_items),
    "order_totals": _domain(budgets.order_totals),
    "order_balance": _domain(budgets.order_balance),
    "allowed_actions": _domain(budgets.allowed_actions),
    "all_within_limits": _domain(budgets.all_within_limits),
    "project_ranking": _domain(lambda d: budgets.project_ranking(d, CURRENCY)),
    "related_options": _domain(budgets.related_options),
    "revision_changes": _domain(budgets.revision_changes),
    "invoice_detail": _domain(budgets.detail),
    "visible_orders_manager": _domain(lambda d: budgets.visible_orders(d, 3)),
    "visible_budgets_employee": _domain(lambda d: budgets.visible_budgets(d, 2)),
    "memberships_report": _domain(budgets.memberships),
    "last_managers": _domain(budgets.last_managers),
    "supplier_breakdown": _domain(lambda d: budgets.supplier_breakdown(d, CURRENCY)),
    "filtered_register": _domain(lambda d: budgets.filtered_register(d, currency=CURRENCY, status="APPROVED", date_from="1996-01-01", date_to="1998-06-30", most=1_000_000)),
    "risk_factors": _domain(budgets.risk_factors),
    "queue_claims": _events(lambda e: jobs.claims(jobs.jobs(e))),
    "next_job": _events(lambda e: jobs.next_job(jobs.jobs(e))),
    "latest_successful_job": _events(lambda e: jobs.latest_success(jobs.jobs(e))),
    "latest_decision": _events(jobs.latest_decision),
    "fenced_results": _events(jobs.fenced_results),
    "idempotent_requests": _events(jobs.idempotent),
    "active_admission": _events(lambda e: jobs.active_admission(jobs.jobs(e), ACTIVE)),
    "notification_inbox": _events(lambda e: jobs.inbox(e, 7)),
    "inbox_counts": _events(jobs.inbox_counts),
    "limit_history": _events(jobs.limit_history),
    "authority_as_of": _events(jobs.authority_as_of),
    "full_register": _domain(reports.full_register),
    "status_page": _domain(lambda d: reports.status_page(d, "FINANCE_REVIEW", 2)),
    "order_list": _domain(lambda d: reports.order_list(d, 3)),
    "supplier_keys": _domain(reports.supplier_keys),
    "queue_claims_stream": _events(first_claims),
    "fenced_results_stream": _events(fenced_stream),
    "idempotent_requests_stream": _events(ingest_stream),
}

BUCKETS = ", ".join(f"coalesce(sum(v) FILTER (WHERE status IN {s}), 0) AS {n}" for n, s in (("a", "('APPROVED')"), ("c", "('FINANCE_REVIEW')"), ("p", "('PROJECT_REVIEW', 'CHANGES_REQUESTED')")))
USED = f"{m('a', 'approved')}, {m('c', 'committed')}, {m('p', 'pending')}, {m('a + c + p', 'exposure')}"
BL = "bl AS (SELECT project_id, currency, line, budget * (line + 1) // 20 AS allocated, line <> 4 AS is_active FROM bud, (SELECT unnest(range(0, 5))::INTEGER AS line))"
JOBS = """WITH j AS (SELECT event_id AS job_id, user_id AS owner, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'QUEUED' END AS state, event_id % 3 AS attempts, epoch_us(ts) AS created FROM events),
jb AS (SELECT *, CASE WHEN state = 'RUNNING' THEN created + 360000000 END AS lease_until, CASE WHEN state IN ('SUCCEEDED', 'FAILED') AND job_id % 11 <> 0 THEN created + 1000000 END AS finished FROM j),
cl AS (SELECT *, created // 3600000000 AS hour, row_number() OVER (PARTITION BY created // 3600000000 ORDER BY created, job_id) AS place FROM jb, (SELECT max(created) AS now FROM j) WHERE state = 'QUEUED' OR (state = 'RUNNING' AND lease_until < now))"""

ORACLE = {
    "budget_line_usage": V + f""", {BL}, u AS (SELECT project_id, currency, part % 6 AS line, {BUCKETS} FROM (SELECT hd.project_id, hd.currency, part, status, CASE WHEN document_type = 'CREDIT_NOTE' THEN -(net + tax) ELSE net + tax END AS v FROM it JOIN hd USING (id) WHERE status IN {CNT}) GROUP BY ALL)
SELECT project_id, currency, line, is_active, {m('allocated', 'allocated')}, {m('coalesce(a, 0)', 'approved')}, {m('coalesce(c, 0)', 'committed')}, {m('coalesce(p, 0)', 'pending')}, {m('coalesce(a + c + p, 0)', 'exposure')}, {m('allocated - coalesce(a + c + p, 0)', 'remaining')} FROM bl LEFT JOIN u USING (project_id, currency, line)""",
    "project_budget_report": V + f""", {BL}, u AS (SELECT project_id, currency, {BUCKETS} FROM (SELECT *, signed AS v FROM inv WHERE status IN {CNT}) GROUP BY ALL), al AS (SELECT project_id, currency, sum(CASE WHEN is_active THEN allocated ELSE 0 END) AS allocated, count(*) FILTER (WHERE is_active) AS active_lines FROM bl GROUP BY ALL)
SELECT project_id, currency, {m('budget', 'budget')}, {m('allocated', 'allocated')}, {m('budget - allocated', 'reserve')}, {USED}, {m('budget - a - c - p', 'remaining')}, active_lines FROM bud JOIN al USING (project_id, currency) JOIN u USING (project_id, currency)""",
    "archived_line_items": V + "SELECT id AS invoice_id, position::INTEGER AS position, (part % 6)::INTEGER AS line FROM it WHERE part % 6 = 4",
    "order_totals": V + f""", {LINKED}, o AS (SELECT lo.po, lo.ordered, received, (lo.ordered * oprice * 2 + 100) // 200 AS net, tp FROM lo JOIN it ON it.id = lo.po AND it.position = lo.position), t AS (SELECT *, (net * tp * 2 + 100) // 200 AS tax FROM o)
SELECT po AS purchase_order_id, count(*) AS lines, {m('sum(net)', 'subtotal')}, {m('sum(tax)', 'tax_total')}, sum(ordered)::DECIMAL(18,4) AS ordered, sum(received)::DECIMAL(18,4) AS received, {m('sum(net + tax)', 'total')} FROM t GROUP BY po""",
    "order_balance": V + f""", {LINKED}, k AS (SELECT po, position, q AS b, 0 AS r FROM ll WHERE o UNION ALL SELECT po, position, 0, received FROM lo WHERE received > 0)
SELECT po AS purchase_order_id, position::INTEGER AS position, sum(b)::DECIMAL(18,4) AS billed, sum(r)::DECIMAL(18,4) AS received, sum(b - r)::DECIMAL(18,4) AS open FROM k GROUP BY ALL""",
    "allowed_actions": V + """, l AS (SELECT project_id, currency, min(user_id) AS manager, arg_min(amount, user_id) AS amount FROM lim GROUP BY ALL), r AS (SELECT * FROM inv JOIN l USING (project_id, currency))
SELECT id, 'EMPLOYEE' AS role, created_by AS user_id, CASE WHEN status IN ('DRAFT', 'CHANGES_REQUESTED') THEN 'EDIT,SUBMIT' ELSE '' END AS actions FROM r
UNION ALL SELECT id, 'PROJECT_MANAGER', manager, CASE WHEN status <> 'PROJECT_REVIEW' THEN '' WHEN total <= amount THEN 'APPROVE,REQUEST_CHANGES,REJECT' ELSE 'REQUEST_CHANGES,REJECT' END FROM r
UNION ALL SELECT id, 'FINANCE_MANAGER', 900, CASE WHEN status = 'FINANCE_REVIEW' AND id % 17 <> 0 THEN 'APPROVE,REQUEST_CHANGES,REJECT' ELSE '' END FROM r""",
    "all_within_limits": V + """, l AS (SELECT project_id, currency, min(amount) AS least FROM lim GROUP BY ALL)
SELECT project_id, currency, count(*) AS documents, bool_and(total <= least) AS all_within, bool_or(total <= least) AS any_within FROM inv JOIN l USING (project_id, currency) WHERE status = 'PROJECT_REVIEW' AND total IS NOT NULL GROUP BY ALL""",
    "project_ranking": V + f", {VAL}, pj AS (SELECT DISTINCT project_id FROM hd), r AS (SELECT project_id, {APP} AS a, {REV} AS r FROM pj LEFT JOIN val USING (project_id) GROUP BY project_id) SELECT row_number() OVER (ORDER BY abs(a) + abs(r) DESC, project_id) AS place, project_id, {m('a', 'approved_net')}, {m('r', 'review_net')} FROM r",
    "related_options": V + f"SELECT project_id, supplier_id, row_number() OVER w AS place, id, invoice_date FROM hd WHERE document_type = 'INVOICE' AND status IN {SUB} WINDOW w AS (PARTITION BY project_id, supplier_id ORDER BY invoice_date DESC NULLS LAST, created_at DESC) QUALIFY row_number() OVER w <= 5",
    "revision_changes": V + "SELECT o.id, concat_ws(',', " + ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{a}' END" for c, a in (("supplier_id",) * 2, ("project_id",) * 2, ("currency",) * 2, ("invoice_date",) * 2, ("number", "invoice_number"), ("document_type",) * 2, ("status",) * 2)) + ") AS changed FROM hd o JOIN hd n ON n.id = o.id + 1000000000",
    "invoice_detail": V + f"""SELECT hd.id, status, count(position) AS n_lines, {m('max(net + tax)', 'largest')}, coalesce(string_agg(position || ':' || ((net + tax)::DECIMAL(30,2) * 0.01::DECIMAL(3,2))::DECIMAL(22,2)::VARCHAR, ';' ORDER BY position), '') AS lines FROM hd LEFT JOIN it USING (id) GROUP BY hd.id, status""",
    "visible_orders_manager": V + f", me AS ({ME}) SELECT po AS purchase_order_id, project_id FROM hd WHERE po IS NOT NULL AND id < 1000000000 AND project_id IN (SELECT project_id FROM me WHERE user_id = 3 AND role = 'MANAGER')",
    "visible_budgets_employee": V + f", me AS ({ME}) SELECT project_id, currency, {m('budget', 'budget')} FROM bud WHERE project_id IN (SELECT project_id FROM me WHERE user_id = 2 AND role IS NOT NULL)",
    "memberships_report": V + f", me AS ({ME}) SELECT user_id::INTEGER AS user_id, count(*) AS projects, coalesce(string_agg(project_id::VARCHAR, ',' ORDER BY project_id) FILTER (WHERE role = 'MANAGER'), '') AS manages, coalesce(string_agg(project_id::VARCHAR, ',' ORDER BY project_id) FILTER (WHERE role = 'MEMBER'), '') AS member_of FROM me WHERE role IS NOT NULL GROUP BY user_id",
    "last_managers": V + f", me AS ({ME}), o AS (SELECT project_id, min(user_id)::INTEGER AS user_id FROM me WHERE role = 'MANAGER' GROUP BY 1 HAVING count(*) = 1), n AS (SELECT project_id, count(*) AS pending FROM hd WHERE status = 'PROJECT_REVIEW' GROUP BY 1) SELECT user_id, count(*) AS projects, sum(pending)::BIGINT AS pending FROM o JOIN n USING (project_id) GROUP BY user_id",
    "supplier_breakdown": V + f"SELECT coalesce(nullif(trim(s_name), ''), '(none)') AS supplier, {m('sum(signed)', 'net')}, count(*) AS documents FROM inv LEFT JOIN supplier ON s_suppkey = supplier_id WHERE currency = '{CURRENCY}' AND status = 'APPROVED' GROUP BY 1",
    "filtered_register": V + f"SELECT id, project_id, currency, status, invoice_date, {m('total', 'total')} FROM inv WHERE currency = '{CURRENCY}' AND status = 'APPROVED' AND invoice_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'",
    "risk_factors": V + f", {RISK} SELECT id, row_number() OVER (PARTITION BY id ORDER BY w DESC, code) AS place, code, w::BIGINT AS weight FROM al JOIN w USING (code) WHERE status = 'WARNING'",
    "queue_claims": JOBS + " SELECT job_id, hour, place, CASE WHEN attempts >= 2 THEN 'FAILED' ELSE 'RUNNING' END AS new_state, CASE WHEN attempts >= 2 THEN 'INTERRUPTED' END AS error, attempts + CASE WHEN attempts >= 2 THEN 0 ELSE 1 END AS new_attempts, CASE WHEN attempts < 2 THEN now + 360000000 END AS new_lease FROM cl",
    "next_job": JOBS + " SELECT job_id, CASE WHEN attempts >= 2 THEN 'FAILED' ELSE 'RUNNING' END AS new_state, attempts + CASE WHEN attempts >= 2 THEN 0 ELSE 1 END AS new_attempts FROM cl ORDER BY created, job_id LIMIT 1",
    "latest_successful_job": JOBS + " SELECT owner, job_id, finished FROM jb WHERE state = 'SUCCEEDED' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY finished DESC NULLS FIRST, job_id DESC) = 1",
    "latest_decision": "SELECT user_id, event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type IN ('purchase', 'error') AND (props->>'$.k')::BIGINT > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "fenced_results": "WITH r AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id) AS current FROM events) SELECT event_id, user_id, revision, current, revision = current AS accepted FROM r WHERE event_type = 'purchase'",
    "idempotent_requests": "WITH r AS (SELECT event_id, sha256('value|' || printf('%.2f', value)) AS fingerprint, first_value(event_id) OVER w AS first_id, first_value(sha256('value|' || printf('%.2f', value))) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id)) SELECT event_id, fingerprint, first_id, CASE WHEN event_id = first_id THEN 'ACCEPTED' WHEN fingerprint = f THEN 'REPLAYED' ELSE 'CONFLICT' END AS state FROM r",
    "active_admission": JOBS + f" SELECT owner, count(*) FILTER (WHERE state IN ('QUEUED', 'RUNNING')) AS active, count(*) FILTER (WHERE state IN ('QUEUED', 'RUNNING')) < {ACTIVE} AS admitted FROM jb GROUP BY owner",
    "notification_inbox": "SELECT event_id, event_type, event_id % 2 = 0 AS read FROM events WHERE user_id = 7",
    "inbox_counts": "SELECT user_id AS recipient, count(*) AS total, count(*) FILTER (WHERE event_id % 2 <> 0) AS unread FROM events GROUP BY 1",
    "limit_history": "SELECT user_id, event_id, value::DECIMAL(22,2) AS amount, epoch_us(ts) AS valid_from, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE event_type = 'purchase'",
    "authority_as_of": """WITH l AS (SELECT *, value::DECIMAL(22,2) AS amount, last_value(CASE WHEN event_type = 'purchase' THEN {'id': event_id, 'amount': value::DECIMAL(22,2)} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held
  FROM events WHERE event_type IN ('purchase', 'view'))
SELECT event_id, user_id, amount, held.id AS limit_id, held.amount AS limit_amount, coalesce(amount <= held.amount, false) AS within FROM l WHERE event_type = 'view'""",
}
ORACLE["queue_claims_stream"] = f"SELECT job_id, new_state, error, new_attempts FROM ({ORACLE['queue_claims']})"
ORACLE["fenced_results_stream"], ORACLE["idempotent_requests_stream"] = ORACLE["fenced_results"], ORACLE["idempotent_requests"]


def _labels(c: str, labels: dict[str, str]) -> str:
    return f"CASE {c} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())} END"


def _iso(c: str) -> str:
    return f"strftime(make_timestamp(({c}) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


ORACLE["full_register"] = V + f""", k AS (SELECT event_id // 2 AS id, ts, event_id, (props->>'$.k')::BIGINT AS score FROM events WHERE event_type IN ('purchase', 'error') AND (props->>'$.k') IS NOT NULL),
dr AS (SELECT id, score, CASE WHEN score >= 50 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1)
SELECT inv.id, {SAFE.format(c='number')} AS number, {_labels('document_type', reports.DOCUMENT_LABELS)} AS document_type, {_labels('status', reports.STATUS_LABELS)} AS status, 'P' || lpad(project_id::VARCHAR, 3, '0') AS project_code, 'Project ' || project_id AS project,
  {SAFE.format(c='s_name')} AS supplier, {SAFE.format(c='region')} AS region, invoice_date, currency, {m('subtotal', 'subtotal')}, {m('discount', 'discount')}, {m('tax', 'tax')}, {m('total', 'total')}, {m('signed', 'signed_total')},
  score, {_labels('level', reports.RISK_LABELS)} AS level, score // 10 AS warnings, 'User ' || created_by AS creator, {_iso('created_at')} AS created, CASE WHEN status <> 'CHANGES_REQUESTED' THEN {_iso('created_at + 3600')} END AS submitted
FROM inv LEFT JOIN sup USING (supplier_id) LEFT JOIN supplier ON s_suppkey = inv.supplier_id LEFT JOIN dr ON dr.id = inv.id WHERE status <> 'DRAFT'"""
ORACLE["status_page"] = V + "SELECT id, created_at, count(*) OVER () AS total FROM hd WHERE status = 'FINANCE_REVIEW' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20"
ORACLE["order_list"] = V + f", me AS ({ME}) SELECT po AS purchase_order_id, project_id, invoice_date AS order_date, created_at FROM hd WHERE po IS NOT NULL AND id < 1000000000 AND project_id IN (SELECT project_id FROM me WHERE user_id = 3 AND role = 'MANAGER')"
ORACLE["supplier_keys"] = "SELECT s_suppkey AS supplier_id, sha256(lower(trim(regexp_replace(s_name, '\\s+', ' ', 'g')))) AS name_key FROM supplier WHERE s_suppkey IS NOT NULL"
