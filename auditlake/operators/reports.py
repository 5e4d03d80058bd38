"""Dashboard figures and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.money import MONEY, signed
from auditlake.functions.text import name_key
from auditlake.operators import checks
from auditlake.sources.tables import Domain

REVIEW = ("PROJECT_REVIEW", "FINANCE_REVIEW")
STATUSES = ("DRAFT", "PROJECT_REVIEW", "FINANCE_REVIEW", "CHANGES_REQUESTED", "APPROVED", "REJECTED")


def safe_cell(c: Column) -> Column:
    """A text that a spreadsheet would take for a formula gets a leading apostrophe; null is empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def _valued(d: Domain, currency: str) -> DataFrame:
    rows = d.invoices().filter((F.col("currency") == currency) & (F.col("status") != "DRAFT"))
    return rows.withColumn("value", signed(F.col("document_type"), F.col("grand_total")))


def _part(*statuses: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("status").isin(*statuses), F.col("value"))), F.lit(0)).cast(MONEY)


def summary(d: Domain, currency: str) -> DataFrame:
    on = F.col("status").isin(*REVIEW)
    return _valued(d, currency).agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "APPROVED").alias("approved_documents"), F.count_if(on).alias("review_documents"), _part("APPROVED").alias("approved_net"), _part(*REVIEW).alias("review_net"))


def status_histogram(d: Domain, currency: str) -> DataFrame:
    """All six states, with zeros."""
    spine = d.spark.range(1).select(F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    counts = d.headers().filter((F.col("currency") == currency) & (F.col("status") != "DRAFT")).groupBy("status").agg(F.count("*").alias("n"))
    return spine.join(counts, "status", "left").na.fill(0, ["n"])


def monthly_trend(d: Domain, currency: str, as_of: str) -> DataFrame:
    """Approved value of the six months up to as_of, with zeros."""
    spine = d.spark.range(1).select(F.explode(F.expr(f"sequence(add_months(trunc(date'{as_of}', 'MM'), -5), trunc(date'{as_of}', 'MM'), interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    sums = _valued(d, currency).filter("status = 'APPROVED'").groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(F.sum("value").cast(MONEY).alias("amount"))
    return spine.join(sums, "month", "left").na.fill(0, ["amount"])


def project_breakdown(d: Domain, currency: str) -> DataFrame:
    """Every project, those without documents in the currency too."""
    spine = d.headers().select("project_id").distinct()
    sums = _valued(d, currency).groupBy("project_id").agg(F.count("*").alias("documents"), _part("APPROVED").alias("approved_net"), _part(*REVIEW).alias("review_net"))
    return spine.join(sums, "project_id", "left").na.fill(0, ["documents", "approved_net", "review_net"])


def supplier_top(d: Domain, currency: str, n: int = 6) -> DataFrame:
    rows = _valued(d, currency).filter("status = 'APPROVED'").groupBy("supplier_id").agg(F.sum("value").cast(MONEY).alias("approved_net"), F.count("*").alias("documents"))
    return rows.orderBy(F.abs("approved_net").desc(), "supplier_id").limit(n)


def exception_queue(d: Domain, currency: str, n: int = 10) -> DataFrame:
    """Documents under review with the highest risk."""
    inv = d.headers().filter((F.col("currency") == currency) & F.col("status").isin(*REVIEW)).select("id", "project_id")
    return inv.join(checks.risk_scores(d).filter("score > 0").select("id", "score", "level"), "id").orderBy(F.col("score").desc(), "id").limit(n)


def register(d: Domain) -> DataFrame:
    """One line for each document that is not a draft, with cells that are safe in a spreadsheet."""
    s = d.suppliers().select("supplier_id", "region_code")
    rows = d.invoices().filter("status <> 'DRAFT'").join(s, "supplier_id", "left")
    return rows.select("id", safe_cell(F.col("invoice_number")).alias("number"), "document_type", "status", "currency", "invoice_date", safe_cell(F.col("region_code")).alias("region"), F.col("grand_total").alias("total"), signed(F.col("document_type"), F.col("grand_total")).alias("signed_total"))


#: What a register shows for codes, and its column heads.
STATUS_LABELS = {
    "DRAFT": "مسودة",
    "PROJECT_REVIEW": "مراجعة المشروع",
    "FINANCE_REVIEW": "مراجعة المالية",
    "CHANGES_REQUESTED": "مطلوب تعديل",
    "APPROVED": "معتمد",
    "REJECTED": "مرفوض",
}
DOCUMENT_LABELS = {"INVOICE": "فاتورة", "CREDIT_NOTE": "إشعار دائن", "DEBIT_NOTE": "إشعار مدين"}
RISK_LABELS = {"LOW": "منخفضة", "MEDIUM": "متوسطة", "HIGH": "مرتفعة"}
HEADS = {
    "number": "رقم المستند", "document_type": "نوع المستند", "status": "الحالة", "project_code": "رمز المشروع", "project": "المشروع",
    "supplier": "المورد", "region": "رمز منطقة المورد", "invoice_date": "تاريخ المستند", "currency": "العملة", "subtotal": "الإجمالي قبل الخصم",
    "discount": "الخصم", "tax": "الضريبة", "total": "الإجمالي", "signed_total": "الأثر الصافي", "score": "درجة آخر قرار",
    "level": "مستوى أولوية آخر قرار", "warnings": "تحذيرات آخر قرار", "creator": "منشئ المستند", "created": "وقت الإنشاء UTC", "submitted": "وقت الإرسال UTC",
}


def decoded(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; null for a code without one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), c)


def iso(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO time in UTC, whatever the session's zone."""
    day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400)).cast("int")
    clock = F.format_string("T%02d:%02d:%02d+00:00", F.floor(rest / 3600).cast("int"), F.floor(rest / 60).cast("int") % 60, rest % 60)
    return F.when(seconds.isNotNull(), F.concat(F.date_from_unix_date(day).cast("string"), clock))


def decision_risks(events: DataFrame) -> DataFrame:
    """(id, score, level, warnings) that the last decision on each document stored; the log holds two events for each document.

    Decisions without an object that holds a risk are passed over; the larger event_id of equal times is the last.
    """
    score = F.get_json_object("props", "$.k").try_cast("long")
    rows = events.filter(F.col("event_type").isin("purchase", "error")).withColumn("score", score).filter("score is not null")
    last = F.max_by("score", F.struct("ts", "event_id")).alias("score")
    rows = rows.groupBy(F.floor(F.col("event_id") / 2).cast("long").alias("id")).agg(last)
    level = F.when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 20, "MEDIUM").otherwise("LOW")
    return rows.select("id", "score", level.alias("level"), F.floor(F.col("score") / 10).cast("long").alias("warnings"))


def full_register(d: Domain) -> DataFrame:
    """The register with all its columns: labels in place of codes, project, supplier, amounts, risk at the last decision, times.

    A document without lines has no amounts and a signed total of zero; one never decided has no risk. Documents whose
    changes were requested count as not submitted. Texts are safe in a spreadsheet; `HEADS` names the columns there.
    """
    s = d.suppliers().select("supplier_id", F.col("supplier_name").alias("supplier"), F.col("region_code").alias("region"))
    rows = d.invoices().filter("status <> 'DRAFT'").join(s, "supplier_id", "left").join(decision_risks(d.read("events")), "id", "left")
    code = F.concat(F.lit("P"), F.lpad(F.col("project_id").cast("string"), 3, "0"))
    sent = F.when(F.col("status") != "CHANGES_REQUESTED", F.col("created_at") + 3600)
    return rows.select(
        "id", safe_cell(F.col("invoice_number")).alias("number"), decoded(F.col("document_type"), DOCUMENT_LABELS).alias("document_type"), decoded(F.col("status"), STATUS_LABELS).alias("status"),
        code.alias("project_code"), F.concat(F.lit("Project "), F.col("project_id")).alias("project"), safe_cell(F.col("supplier")).alias("supplier"), safe_cell(F.col("region")).alias("region"),
        "invoice_date", "currency", "subtotal", F.col("discount_total").alias("discount"), F.col("tax_total").alias("tax"), F.col("grand_total").alias("total"),
        signed(F.col("document_type"), F.col("grand_total")).alias("signed_total"), "score", decoded(F.col("level"), RISK_LABELS).alias("level"), "warnings",
        F.concat(F.lit("User "), F.col("created_by")).alias("creator"), iso(F.col("created_at")).alias("created"), iso(sent).alias("submitted"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files that spreadsheets open as UTF-8: each file's header begins with a byte order mark. Texts are made safe."""
    cells = [safe_cell(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema]
    marked = rows.select(*cells).withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    marked.write.option("header", True).option("lineSep", "\r\n").option("encoding", "UTF-8").csv(path)


def page(d: Domain, number: int, size: int = 50) -> DataFrame:
    """A page of the document list, newest first."""
    return d.headers().orderBy(F.col("created_at").desc(), "id").offset((number - 1) * size).limit(size).select("id", "created_at", "status")


def page_of(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """A page of a list with the number of all rows of it, which is counted apart, so that the page stays a top-k."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", F.lit(rows.count()).cast("long"))


def status_page(d: Domain, status: str, number: int, size: int = 20) -> DataFrame:
    """A page of the documents in a status, newest first, and how many there are."""
    rows = d.headers().filter(F.col("status") == status).select("id", "created_at")
    return page_of(rows, number, size, F.col("created_at").desc(), "id")


def order_list(d: Domain, user: int) -> DataFrame:
    """Purchase orders that a manager sees, latest order first, then the one made last, then by id."""
    from auditlake.operators.budgets import visible_orders

    rows = visible_orders(d, user).join(d.headers().select(F.col("id").alias("purchase_order_id"), F.col("invoice_date").alias("order_date"), "created_at"), "purchase_order_id")
    return rows.orderBy(F.col("order_date").desc_nulls_first(), F.col("created_at").desc(), "purchase_order_id").select("purchase_order_id", "project_id", "order_date", "created_at")


def supplier_keys(d: Domain) -> DataFrame:
    """Suppliers with the key of their name; suppliers whose names differ in spaces, case or compatible forms share it."""
    return d.suppliers().select("supplier_id", name_key(F.col("supplier_name")).alias("name_key"))


def uniqueness_violations(lines: DataFrame, *key: str) -> DataFrame:
    return lines.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
