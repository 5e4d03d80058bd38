"""Budget lines, project reports, order totals and what principals may do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.money import MONEY, money, signed
from auditlake.operators.checks import WARNING, WEIGHTS, all_checks
from auditlake.operators.events import numbered
from auditlake.operators.reports import project_breakdown
from auditlake.operators.scope import members
from auditlake.sources.tables import CLONE, COUNTED, SUBMITTED, Domain

#: Lines of a budget, and the number that linked items have by their part; the last line is archived.
LINES, ARCHIVED = 5, 4


def _zero():
    return F.lit(0).cast(MONEY)


def _buckets(amount: str = "amount") -> list:
    part = lambda name, *s: F.sum(F.when(F.col("status").isin(*s), F.col(amount)).otherwise(_zero())).cast(MONEY).alias(name)
    return [part("approved", "APPROVED"), part("committed", "FINANCE_REVIEW"), part("pending", "PROJECT_REVIEW", "CHANGES_REQUESTED")]


def _left(allocation: str) -> list:
    exposure = (F.col("approved") + F.col("committed") + F.col("pending")).cast(MONEY)
    return [exposure.alias("exposure"), (F.col(allocation) - exposure).cast(MONEY).alias("remaining")]


def budget_lines(d: Domain) -> DataFrame:
    """(project_id, currency, line, allocated, is_active): five lines of each budget, of 1 to 5 twentieths of it."""
    rows = d.budgets().withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(LINES - 1))))
    return rows.select("project_id", "currency", "line", (F.col("budget") * (F.col("line") + 1) / F.lit(20).cast("decimal(3,0)")).cast(MONEY).alias("allocated"), (F.col("line") != ARCHIVED).alias("is_active"))


def budget_line_usage(d: Domain) -> DataFrame:
    """Each budget line with the signed totals of the counted documents' linked lines by state, lines without any too."""
    inv = d.headers().filter(F.col("status").isin(*COUNTED)).select(F.col("id").alias("invoice_id"), "project_id", "currency", "document_type", "status")
    items = d.items().withColumn("line", (F.col("part_id") % 6).cast("int")).filter(F.col("line") < LINES)
    rows = items.join(inv, "invoice_id").withColumn("amount", signed(F.col("document_type"), F.col("total_amount")))
    used = rows.groupBy("project_id", "currency", "line").agg(*_buckets())
    rows = budget_lines(d).join(used, ["project_id", "currency", "line"], "left").na.fill(0, ["approved", "committed", "pending"])
    return rows.select("project_id", "currency", "line", "is_active", "allocated", "approved", "committed", "pending", *_left("allocated"))


def project_report(d: Domain) -> DataFrame:
    """One row for each budget: what is allocated to active lines, what is kept back, and how it is used."""
    lines = budget_lines(d).groupBy("project_id", "currency").agg(F.sum(F.when(F.col("is_active"), F.col("allocated")).otherwise(_zero())).cast(MONEY).alias("allocated"), F.count_if("is_active").alias("active_lines"))
    inv = d.invoices().filter(F.col("status").isin(*COUNTED)).withColumn("amount", signed(F.col("document_type"), F.col("grand_total")))
    used = inv.groupBy("project_id", "currency").agg(*_buckets())
    rows = d.budgets().join(lines, ["project_id", "currency"]).join(used, ["project_id", "currency"], "left").na.fill(0, ["approved", "committed", "pending"])
    return rows.select("project_id", "currency", "budget", "allocated", (F.col("budget") - F.col("allocated")).cast(MONEY).alias("reserve"), "approved", "committed", "pending", *_left("budget"), "active_lines")


def archived_line_items(d: Domain) -> DataFrame:
    """Linked lines whose budget line is not among the active ones, as an anti-join."""
    inv = d.headers().select(F.col("id").alias("invoice_id"), "project_id", "currency")
    items = d.items().withColumn("line", (F.col("part_id") % 6).cast("int")).filter(F.col("line") < LINES).join(inv, "invoice_id")
    return items.join(budget_lines(d).filter("is_active"), ["project_id", "currency", "line"], "left_anti").select("invoice_id", "position", "line")


def order_totals(d: Domain) -> DataFrame:
    """Each purchase order's totals, rounded line by line, and what was received of it."""
    rows = d.order_items().withColumn("net", money(F.col("ordered") * F.col("order_price")))
    rows = rows.withColumn("tax", money(F.col("net") * F.col("order_tax") / F.lit(100).cast("decimal(3,0)")))
    sums = [F.count("*").alias("lines"), *[F.sum(c).cast(MONEY).alias(a) for c, a in (("net", "subtotal"), ("tax", "tax_total"))], *[F.sum(c).cast("decimal(18,4)").alias(c) for c in ("ordered", "received")]]
    rows = rows.groupBy("purchase_order_id").agg(*sums)
    return rows.select("*", (F.col("subtotal") + F.col("tax_total")).cast(MONEY).alias("total"))


def order_balance(d: Domain) -> DataFrame:
    """What was billed and what was received of each ordered line, by adding up both sides over the union of their keys."""
    zero = F.lit(0).cast("decimal(18,4)")
    inv = d.headers().filter("purchase_order_id is not null").filter(F.col("status").isin(*SUBMITTED)).select(F.col("id").alias("invoice_id"), "purchase_order_id")
    billed = d.items().join(inv, "invoice_id").select("purchase_order_id", "position", F.col("quantity").cast("decimal(18,4)").alias("billed"), zero.alias("received"))
    received = d.order_items().filter("received > 0").select("purchase_order_id", "position", zero.alias("billed"), F.col("received").cast("decimal(18,4)").alias("received"))
    sums = [F.sum(c).cast("decimal(18,4)").alias(c) for c in ("billed", "received")]
    return billed.unionByName(received).groupBy("purchase_order_id", "position").agg(*sums).withColumn("open", (F.col("billed") - F.col("received")).cast("decimal(18,4)"))


def allowed_actions(d: Domain) -> DataFrame:
    """(id, role, user_id, actions): what the creator, the project's first manager and finance may do with a document."""
    inv = d.invoices().select("id", "status", "created_by", "project_id", "currency", "grand_total")
    limits = d.limits().groupBy("project_id", "currency").agg(F.min_by("amount", "user_id").alias("amount"), F.min("user_id").alias("manager"))
    rows = inv.join(limits, ["project_id", "currency"])
    edit = F.when(F.col("status").isin("DRAFT", "CHANGES_REQUESTED"), "EDIT,SUBMIT").otherwise("")
    review = F.when(F.coalesce(F.col("grand_total") <= F.col("amount"), F.lit(False)), "APPROVE,REQUEST_CHANGES,REJECT").otherwise("REQUEST_CHANGES,REJECT")
    approved_by_finance = F.col("id") % 17 == 0
    facts = F.array(
        F.struct(F.lit("EMPLOYEE").alias("role"), F.col("created_by").alias("user_id"), edit.alias("actions")),
        F.struct(F.lit("PROJECT_MANAGER").alias("role"), F.col("manager").alias("user_id"), F.when(F.col("status") == "PROJECT_REVIEW", review).otherwise("").alias("actions")),
        F.struct(F.lit("FINANCE_MANAGER").alias("role"), F.lit(900).cast("long").alias("user_id"), F.when((F.col("status") == "FINANCE_REVIEW") & ~approved_by_finance, "APPROVE,REQUEST_CHANGES,REJECT").otherwise("").alias("actions")),
    )
    return rows.select("id", F.explode(facts).alias("a")).select("id", "a.*")


def all_within_limits(d: Domain) -> DataFrame:
    """Whether all documents in project review are within the least limit of their project and currency, and within all."""
    limits = d.limits().groupBy("project_id", "currency").agg(F.min("amount").alias("least"))
    inv = d.invoices().filter("status = 'PROJECT_REVIEW' and grand_total is not null").join(limits, ["project_id", "currency"])
    within = F.col("grand_total") <= F.col("least")
    return inv.groupBy("project_id", "currency").agg(F.count("*").alias("documents"), F.bool_and(within).alias("all_within"), F.bool_or(within).alias("any_within"))


def project_ranking(d: Domain, currency: str) -> DataFrame:
    """Projects by the size of what is approved and under review, then by number."""
    rows = project_breakdown(d, currency)
    size = F.abs("approved_net") + F.abs("review_net")
    rows = numbered(rows.select((-size).alias("order"), "project_id", "approved_net", "review_net"), "order", "project_id")
    return rows.select("place", "project_id", "approved_net", "review_net")


def related_options(d: Domain, most: int = 5) -> DataFrame:
    """For each project and supplier the latest invoices that a note may name, dated ones first."""
    latest = Window.partitionBy("project_id", "supplier_id").orderBy(F.col("invoice_date").desc_nulls_last(), F.col("created_at").desc())
    rows = d.headers().filter("document_type = 'INVOICE'").filter(F.col("status").isin(*SUBMITTED)).withColumn("place", F.row_number().over(latest))
    return rows.filter(F.col("place") <= most).select("project_id", "supplier_id", F.col("place").cast("long").alias("place"), "id", "invoice_date")


def revision_changes(d: Domain) -> DataFrame:
    """Documents against their later revision: the names of the fields that differ, none if the revision changes nothing."""
    names = ["supplier_id", "project_id", "currency", "invoice_date", "invoice_number", "document_type", "status"]
    old = d.headers().filter(F.col("id") < CLONE)
    new = d.headers().filter(F.col("id") >= CLONE).select((F.col("id") - CLONE).alias("id"), *[F.col(c).alias(f"new_{c}") for c in names])
    changed = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in names])
    return old.join(new, "id").select("id", changed.alias("changed"))


def detail(d: Domain) -> DataFrame:
    """Documents with their lines as one nested value: counted, the largest first, and as text by position."""
    line = F.struct("position", F.concat_ws(":", F.col("position").cast("string"), F.col("total_amount").cast("string")).alias("text"))
    lines = d.items().groupBy(F.col("invoice_id").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("lines"), F.max("total_amount").alias("largest"))
    rows = d.headers().join(lines, "id", "left")
    text = F.coalesce(F.array_join(F.transform("lines", lambda x: x["text"]), ";"), F.lit(""))
    return rows.select("id", "status", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), "largest", text.alias("lines"))


def visible_orders(d: Domain, user: int) -> DataFrame:
    """Purchase orders of the projects that a user manages, drafts and other people's too."""
    mine = members(d).filter((F.col("user_id") == user) & (F.col("role") == "MANAGER")).select("project_id")
    rows = d.headers().filter((F.col("id") < CLONE) & F.col("purchase_order_id").isNotNull())
    return rows.join(mine, "project_id", "left_semi").select("purchase_order_id", "project_id")


def visible_budgets(d: Domain, user: int) -> DataFrame:
    """Budgets of the projects that a user is a member or manager of."""
    return d.budgets().join(members(d).filter(F.col("user_id") == user).select("project_id"), "project_id", "left_semi").select("project_id", "currency", "budget")


def memberships(d: Domain) -> DataFrame:
    """Users with the projects that they manage and those that they are members of, in order."""
    ids = lambda role: F.array_join(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("project_id")))), ",")
    return members(d).groupBy("user_id").agg(F.count("*").alias("projects"), ids("MANAGER").alias("manages"), ids("MEMBER").alias("member_of"))


def last_managers(d: Domain) -> DataFrame:
    """What keeps a manager from being removed: documents under review in projects that nobody else manages."""
    managers = members(d).filter("role = 'MANAGER'")
    only = managers.groupBy("project_id").agg(F.count("*").alias("n"), F.min("user_id").alias("user_id")).filter("n = 1")
    open_ = d.headers().filter("status = 'PROJECT_REVIEW'").groupBy("project_id").agg(F.count("*").alias("pending"))
    return only.join(open_, "project_id").groupBy("user_id").agg(F.count("*").alias("projects"), F.sum("pending").alias("pending"))


def supplier_breakdown(d: Domain, currency: str) -> DataFrame:
    """Approved value by the supplier's name as the document has it; documents without one go together."""
    names = d.suppliers().select("supplier_id", "supplier_name")
    rows = d.invoices().filter((F.col("currency") == currency) & (F.col("status") == "APPROVED")).join(names, "supplier_id", "left")
    name = F.coalesce(F.nullif(F.trim("supplier_name"), F.lit("")), F.lit("(none)"))
    return rows.groupBy(name.alias("supplier")).agg(F.sum(signed(F.col("document_type"), F.col("grand_total"))).cast(MONEY).alias("net"), F.count("*").alias("documents"))


#: Most rows of a report.
MOST_ROWS = 5000


def filtered_register(d: Domain, project: int | None = None, currency: str | None = None, status: str | None = None, date_from: str | None = None, date_to: str | None = None, most: int = MOST_ROWS) -> DataFrame:
    """The documents that a report's filters leave, latest first, undated last; too many, or dates in the wrong order, are an error."""
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from is after date_to")
    rows = d.invoices().filter("status <> 'DRAFT'")
    for name, value in (("project_id", project), ("currency", currency), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if date_from:
        rows = rows.filter(F.col("invoice_date") >= F.lit(date_from).cast("date"))
    if date_to:
        rows = rows.filter(F.col("invoice_date") <= F.lit(date_to).cast("date"))
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} documents")
    return rows.select("id", "project_id", "currency", "status", "invoice_date", F.col("grand_total").alias("total")).orderBy(F.col("invoice_date").desc_nulls_last(), "id")


def risk_factors(d: Domain) -> DataFrame:
    """Warnings of each document by weight, heaviest first, then by code."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    rows = all_checks(d).filter(F.col("status") == WARNING).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.element_at(weight, F.col("code"))).alias("w"), "code"))).alias("r"))
    return rows.select("id", F.posexplode("r").alias("i", "f")).select("id", (F.col("i") + 1).cast("long").alias("place"), "f.code", (-F.col("f.w")).cast("long").alias("weight"))
