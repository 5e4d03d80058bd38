"""Explainable checks: each takes all documents and gives one row for each, with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.money import MONEY, signed
from auditlake.sources.tables import COUNTED, SUBMITTED, Domain

WARNING, PASS, NOT_CHECKED = "WARNING", "PASS", "NOT_CHECKED"
#: The weight of each check in the risk score.
WEIGHTS = {"DOCUMENT_SUBTOTAL": 6, "DOCUMENT_TAX_TOTAL": 8, "DOCUMENT_GRAND_TOTAL": 10, "EXACT_FILE_DUPLICATE": 25, "POTENTIAL_DUPLICATE": 20, "HISTORICAL_PRICE_ANOMALY": 15, "REGIONAL_SUPPLIER_PRICE": 15, "SUPPLIER_VERIFICATION": 10, "RELATED_FINANCIAL_DOCUMENT": 15, "PURCHASE_ORDER_HEADER": 8, "PURCHASE_ORDER_LINES": 12, "GOODS_RECEIPT_MATCH": 12, "SPLIT_INVOICE": 25, "APPROXIMATE_DUPLICATE": 20, "QR_SOURCE_COMPARISON": 8, "XML_SOURCE_COMPARISON": 8, "PROJECT_BUDGET_RELEVANCE": 10, "PROJECT_BUDGET_CAPACITY": 20}
#: A document without a warning is incomplete if one of these could not be checked.
FIRST = ("DOCUMENT_SUBTOTAL", "DOCUMENT_TAX_TOTAL", "DOCUMENT_GRAND_TOTAL", "EXACT_FILE_DUPLICATE", "POTENTIAL_DUPLICATE")


def status(ready, warning):
    return F.when(~F.coalesce(ready, F.lit(False)), NOT_CHECKED).when(warning, WARNING).otherwise(PASS)


def line_calculation(d: Domain) -> DataFrame:
    return d.items().select("invoice_id", "position", "quantity", "unit_price", "gross_amount", "discount_amount", "net_amount", "tax_amount", "total_amount", "effective_price")


def document_totals(d: Domain) -> DataFrame:
    """The printed total against the calculated one."""
    difference = (F.col("document_grand_total") - F.col("grand_total")).cast(MONEY)
    return d.invoices().select("id", F.col("document_grand_total").alias("document_value"), F.col("grand_total").alias("calculated_value"), difference.alias("difference"), status(difference.isNotNull(), difference != 0).alias("status"))


def printed_totals(d: Domain) -> DataFrame:
    """(id, code, status): net amount, tax and total as printed against the calculated ones, three rows for each document."""
    pairs = {"DOCUMENT_SUBTOTAL": ("document_subtotal", "net_total"), "DOCUMENT_TAX_TOTAL": ("document_tax_total", "tax_total"), "DOCUMENT_GRAND_TOTAL": ("document_grand_total", "grand_total")}
    facts = F.array(*[F.struct(F.lit(code).alias("code"), (F.col(a) - F.col(b)).alias("difference")) for code, (a, b) in pairs.items()])
    rows = d.invoices().select("id", F.explode(facts).alias("x"))
    return rows.select("id", "x.code", status(F.col("x.difference").isNotNull(), F.col("x.difference") != 0).alias("status"))


def attached_duplicates(d: Domain) -> DataFrame:
    """How many other documents of the company have the same file attached; one without a file passes."""
    files = d.attachments()
    same = files.groupBy("company_id", "sha256").agg((F.count("*") - 1).alias("match_count")).filter("match_count > 0")
    found = files.join(same, ["company_id", "sha256"]).select("id", "match_count")
    rows = d.headers().select("id").join(found, "id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0).cast("long")))
    return rows.select("id", "match_count", F.when(F.col("match_count") > 0, WARNING).otherwise(PASS).alias("status"))


def file_duplicates(files: DataFrame, company: str, digest) -> DataFrame:
    """How many other files of a company have the same content.

    Counts are taken before the join, so a content that many files share is one row of the counted side.
    """
    rows = files.select("doc_id", company, digest.alias("sha256"))
    counts = rows.groupBy(company, "sha256").agg((F.count("*") - 1).alias("match_count")).filter("match_count > 0")
    joined = rows.join(counts, [company, "sha256"], "left").withColumn("match_count", F.coalesce("match_count", F.lit(0).cast("long")))
    return joined.select("doc_id", company, "sha256", "match_count", F.when(F.col("match_count") > 0, WARNING).otherwise(PASS).alias("status"))


def potential_duplicates(d: Domain) -> DataFrame:
    """Other documents, of any state, with the same company, type, supplier, date, currency, total and number."""
    key = ["company_id", "document_type", "supplier_id", "invoice_date", "currency", "grand_total", "number_key"]
    inv = d.invoices().select("id", *key)
    ready = F.lit(True)
    for c in key:
        ready = ready & F.col(c).isNotNull()
    same = inv.filter(ready).groupBy(*key).agg((F.count("*") - 1).alias("match_count"))
    rows = inv.join(same, key, "left")
    return rows.select("id", F.coalesce("match_count", F.lit(0).cast("long")).alias("match_count"), status(ready, F.col("match_count") > 0).alias("status"))


def split_invoices(d: Domain) -> DataFrame:
    """Invoices within seven days that stay under a manager's limit one by one and exceed it together.

    The frame holds submitted documents; one that is not submitted itself is added to its own frame.
    """
    limits = d.limits().groupBy("project_id", "currency").agg(F.min("amount").alias("threshold"))
    inv = d.invoices().filter("document_type = 'INVOICE'").select("id", "company_id", "project_id", "supplier_id", "currency", "invoice_date", "grand_total", "status")
    ready = F.col("supplier_id").isNotNull() & F.col("invoice_date").isNotNull() & F.col("currency").isNotNull() & F.col("grand_total").isNotNull()
    on = F.col("status").isin(*SUBMITTED)
    week = Window.partitionBy("company_id", "project_id", "supplier_id", "currency").orderBy(F.expr("unix_date(invoice_date)")).rangeBetween(-7, 7)
    total = F.when(on, F.col("grand_total"))
    rows = inv.filter(ready).withColumns({"n": F.count(total).over(week), "s": F.sum(total).over(week), "m": F.max(total).over(week)})
    add = F.when(on, F.lit(0)).otherwise(1)
    own = F.when(on, F.lit(0).cast(MONEY)).otherwise(F.col("grand_total"))
    rows = rows.join(F.broadcast(limits), ["project_id", "currency"], "left").select(
        "id",
        "threshold",
        (F.col("n") + add).alias("match_count"),
        (F.coalesce("s", F.lit(0).cast(MONEY)) + own).cast(MONEY).alias("combined"),
        F.greatest("m", "grand_total").alias("largest"),
    )
    split = (F.col("match_count") >= 2) & (F.col("largest") <= F.col("threshold")) & (F.col("combined") > F.col("threshold"))
    return rows.select("id", "threshold", "match_count", "combined", status(F.col("threshold").isNotNull(), split).alias("status"))


def related_documents(d: Domain) -> DataFrame:
    """Balance of each original with its submitted notes, and the link of each note to its original."""
    inv = d.invoices().select("id", "company_id", "project_id", "supplier_id", "currency", "document_type", "related_invoice_id", "status", "grand_total")
    on, zero = F.col("status").isin(*SUBMITTED), F.lit(0).cast(MONEY)
    note = -signed(F.col("document_type"), F.col("grand_total"))
    effect = F.when(F.col("document_type") == "INVOICE", zero).otherwise(-note)
    sums = inv.filter(on & F.col("related_invoice_id").isNotNull()).groupBy(F.col("related_invoice_id").alias("original"), "company_id", "project_id").agg(F.sum(effect).alias("notes"), F.count("*").alias("n"))
    own = sums.withColumnRenamed("original", "id")
    first = inv.filter("document_type = 'INVOICE'").join(own, ["id", "company_id", "project_id"], "left")
    balance = (F.col("grand_total") + F.coalesce("notes", zero)).cast(MONEY)
    first = first.select("id", F.col("grand_total").alias("document_value"), balance.alias("balance"), F.coalesce("n", F.lit(0).cast("long")).alias("match_count"), F.when(balance < 0, WARNING).otherwise(PASS).alias("status"))
    base = inv.filter("document_type = 'INVOICE'").select(F.col("id").alias("original"), "company_id", "project_id", F.col("supplier_id").alias("s"), F.col("currency").alias("c"), F.coalesce("grand_total", zero).alias("t"))
    notes = inv.filter("document_type <> 'INVOICE'").withColumn("original", F.col("related_invoice_id")).join(base, ["original", "company_id", "project_id"], "left").join(sums, ["original", "company_id", "project_id"], "left")
    valid = F.col("t").isNotNull()
    add = F.when(on, zero).otherwise(effect)
    balance = F.when(valid, F.col("t") + F.coalesce("notes", zero) + add).cast(MONEY)
    n = F.when(valid, F.coalesce("n", F.lit(0)) + F.when(on, 0).otherwise(1)).otherwise(0).cast("long")
    wrong = ~valid | ~F.col("s").eqNullSafe(F.col("supplier_id")) | ~F.col("c").eqNullSafe(F.col("currency")) | (balance < 0)
    notes = notes.select("id", F.col("t").alias("document_value"), balance.alias("balance"), n.alias("match_count"), F.when(wrong, WARNING).otherwise(PASS).alias("status"))
    return first.unionByName(notes)


def supplier_verification(d: Domain) -> DataFrame:
    inv = d.invoices().select("id", "supplier_id", "company_id")
    s = d.suppliers().select("supplier_id", F.col("company_id").alias("owner"), "verification")
    rows = inv.join(s, "supplier_id", "left")
    state = F.when(F.col("owner") != F.col("company_id"), WARNING).when(F.col("verification") == "VERIFIED", PASS).when(F.col("verification") == "REJECTED", WARNING).otherwise(NOT_CHECKED)
    return rows.select("id", "verification", state.alias("status"))


def _linked_lines(d: Domain) -> DataFrame:
    """Lines of documents with a purchase order, with the ordered line and the quantities billed on it so far.

    Billed are submitted documents, and the document itself whatever its state.
    """
    inv = d.headers().filter("purchase_order_id is not null").select("id", "purchase_order_id", F.col("status").isin(*SUBMITTED).alias("on"))
    lines = d.items().select(F.col("invoice_id").alias("id"), "position", "quantity", "unit_price", "tax_rate").join(inv, "id")
    order = d.order_items()
    billed = lines.groupBy("purchase_order_id", "position").agg(F.sum(F.when(F.col("on"), F.col("quantity")).otherwise(0)).alias("others"))
    rows = lines.join(billed, ["purchase_order_id", "position"]).join(order, ["purchase_order_id", "position"], "left")
    return rows.withColumn("billed", (F.col("others") + F.when(F.col("on"), 0).otherwise(F.col("quantity"))).cast("decimal(18,4)"))


def _order_status(rows: DataFrame) -> DataFrame:
    price, tax, over = F.col("unit_price") == F.col("order_price"), F.col("tax_rate") == F.col("order_tax"), F.col("billed") > F.col("ordered")
    return rows.withColumns({"price_match": price, "tax_match": tax, "status": F.when(~price | ~tax | over, WARNING).otherwise(PASS)})


def _receipt_status() -> Column:
    return F.when(F.col("received") < F.col("billed"), WARNING).otherwise(PASS)


def order_lines(d: Domain) -> DataFrame:
    return _order_status(_linked_lines(d)).select("id", "position", "price_match", "tax_match", "billed", "ordered", "status")


def receipts(d: Domain) -> DataFrame:
    return _linked_lines(d).select("id", "position", "billed", "received", _receipt_status().alias("status"))


def linked_checks(d: Domain) -> DataFrame:
    """(id, code, status): the worst line of each document by its order and by its receipts, from one pass over the lines."""
    rows = _order_status(_linked_lines(d)).withColumn("receipt", _receipt_status())
    worst = lambda c: F.when(F.bool_or(F.col(c) == WARNING), WARNING).otherwise(PASS)
    rows = rows.groupBy("id").agg(worst("status").alias("a"), worst("receipt").alias("b"))
    facts = [F.struct(F.lit(code).alias("code"), F.col(c).alias("status")) for code, c in (("PURCHASE_ORDER_LINES", "a"), ("GOODS_RECEIPT_MATCH", "b"))]
    return rows.select("id", F.explode(F.array(*facts)).alias("x")).select("id", "x.*")


def budget_relevance(d: Domain) -> DataFrame:
    """Documents with lines that no budget line covers."""
    rows = d.items().groupBy(F.col("invoice_id").alias("id")).agg(F.count("*").alias("lines"), F.count_if(F.col("part_id") % 6 == 5).alias("unlinked"))
    inv = d.headers().select("id").join(rows, "id", "left")
    zero = F.lit(0).cast("long")
    return inv.select("id", F.coalesce("lines", zero).alias("lines"), F.coalesce("unlinked", zero).alias("unlinked"), status(F.col("lines") > 0, F.col("unlinked") > 0).alias("status"))


def budget_capacity(d: Domain) -> DataFrame:
    """What a budget has left once a document is counted with all others that are."""
    inv = d.invoices().select("id", "project_id", "currency", "status", "document_type", "grand_total")
    inv = inv.withColumn("amount", signed(F.col("document_type"), F.col("grand_total"))).withColumn("on", F.col("status").isin(*COUNTED))
    zero = F.lit(0).cast(MONEY)
    used = inv.groupBy("project_id", "currency").agg(F.sum(F.when(F.col("on"), F.col("amount")).otherwise(zero)).cast(MONEY).alias("used"), F.count_if("on").alias("n"))
    facts = d.budgets().join(used, ["project_id", "currency"], "left")
    rows = inv.join(F.broadcast(facts), ["project_id", "currency"], "left")
    before = (F.col("used") - F.when(F.col("on"), F.col("amount")).otherwise(zero)).cast(MONEY)
    left = (F.col("budget") - before - F.col("amount")).cast(MONEY)
    others = F.col("n") - F.col("on").cast("long")
    return rows.select("id", before.alias("exposure_before"), left.alias("remaining"), others.alias("match_count"), status(F.col("grand_total").isNotNull(), left < 0).alias("status"))


def budget_usage(d: Domain) -> DataFrame:
    inv = d.invoices().filter(F.col("status").isin(*COUNTED)).withColumn("amount", signed(F.col("document_type"), F.col("grand_total")))
    zero = F.lit(0).cast(MONEY)
    part = lambda *s: F.sum(F.when(F.col("status").isin(*s), F.col("amount")).otherwise(zero)).cast(MONEY)
    used = inv.groupBy("project_id", "currency").agg(part("APPROVED").alias("approved"), part("FINANCE_REVIEW").alias("committed"), part("PROJECT_REVIEW", "CHANGES_REQUESTED").alias("pending"))
    rows = d.budgets().join(used, ["project_id", "currency"], "left").na.fill(0, ["approved", "committed", "pending"])
    exposure = (F.col("approved") + F.col("committed") + F.col("pending")).cast(MONEY)
    return rows.select("project_id", "currency", "budget", "approved", "committed", "pending", exposure.alias("exposure"), (F.col("budget") - exposure).cast(MONEY).alias("remaining"))


def all_checks(d: Domain, approximate: bool = False) -> DataFrame:
    """(id, code, status) of the checks; a document without a row of a check is not checked by it, as one that it is not for.

    Approximate duplicates, which take a sequence matcher, are among them only if asked for.
    """
    from auditlake.operators.intake import order_header_match
    from auditlake.operators.prices import price_history, regional_prices
    from auditlake.operators.similar import approximate_duplicates
    from auditlake.sources.structured import payload_comparison, xml_comparison

    def of(code, rows):
        return rows.select("id", F.lit(code).alias("code"), "status")

    worst = lambda rows: rows.groupBy("id").agg(F.when(F.bool_or(F.col("status") == WARNING), WARNING).otherwise(PASS).alias("status"))
    judged = lambda rows: worst(rows.filter(F.col("status") != NOT_CHECKED).withColumnRenamed("invoice_id", "id"))
    d = d.stored()
    out = printed_totals(d).unionByName(linked_checks(d))
    for code, rows in (
        ("EXACT_FILE_DUPLICATE", attached_duplicates(d)),
        ("POTENTIAL_DUPLICATE", potential_duplicates(d)),
        ("HISTORICAL_PRICE_ANOMALY", judged(price_history(d))),
        ("REGIONAL_SUPPLIER_PRICE", judged(regional_prices(d))),
        ("SUPPLIER_VERIFICATION", supplier_verification(d)),
        ("RELATED_FINANCIAL_DOCUMENT", related_documents(d)),
        ("PURCHASE_ORDER_HEADER", order_header_match(d)),
        ("SPLIT_INVOICE", split_invoices(d)),
        ("PROJECT_BUDGET_RELEVANCE", budget_relevance(d)),
        ("PROJECT_BUDGET_CAPACITY", budget_capacity(d)),
        ("XML_SOURCE_COMPARISON", xml_comparison(d)),
        ("QR_SOURCE_COMPARISON", payload_comparison(d)),
        *([("APPROXIMATE_DUPLICATE", approximate_duplicates(d))] if approximate else []),
    ):
        out = out.unionByName(of(code, rows))
    return out


def risk_scores(d: Domain, approximate: bool = False) -> DataFrame:
    """Weights of a document's warnings added up, to 100 at most; its level; and how sure it is, by checks evaluated."""
    codes = list(WEIGHTS)
    warned = F.col("status") == WARNING
    # one number for each row: a bit for each check that warns, and one for each that was evaluated, so little is shuffled
    bit = F.element_at(F.create_map(*[F.lit(x) for i, code in enumerate(codes) for x in (code, 1 << i)]), F.col("code")).cast("long")
    evaluated = F.when(F.col("status") == NOT_CHECKED, F.lit(0)).otherwise(F.shiftleft(bit, len(codes)))
    open_ = F.when((F.col("status") == NOT_CHECKED) & F.col("code").isin(*FIRST), F.lit(1 << 2 * len(codes))).otherwise(F.lit(0))
    rows = all_checks(d, approximate).select("id", (F.when(warned, bit).otherwise(F.lit(0)) + evaluated + open_).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    has = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0
    weights = sum((F.when(has(i), WEIGHTS[code]).otherwise(0) for i, code in enumerate(codes)), F.lit(0))
    mask = (1 << len(codes)) - 1
    rows = rows.select(
        "id",
        F.least(weights, F.lit(100)).cast("long").alias("score"),
        F.bit_count(F.col("bits").bitwiseAND(F.lit(mask).cast("long"))).cast("long").alias("warnings"),
        F.bit_count(F.col("bits").bitwiseAND(F.lit(mask << len(codes)).cast("long"))).cast("long").alias("evaluated"),
        has(2 * len(codes)).alias("open"),
    )
    level = F.when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 20, "MEDIUM").otherwise("LOW")
    sure = F.when(F.col("evaluated") >= 10, "HIGH").when(F.col("evaluated") >= 6, "MEDIUM").otherwise("LOW")
    summary = F.when(F.col("warnings") > 0, "NEEDS_REVIEW").when(F.col("open"), "INCOMPLETE").otherwise("PASS")
    return rows.select("id", "score", "warnings", "evaluated", level.alias("level"), sure.alias("confidence"), summary.alias("summary"))
