"""The audit domain as views of the given tables: invoices, lines, orders, receipts, limits, budgets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.money import MONEY, PRICE, effective_unit_price, line_amounts, money
from auditlake.functions.text import number_key, phrase, unit_key

SUBMITTED = ("PROJECT_REVIEW", "FINANCE_REVIEW", "APPROVED")
COUNTED = (*SUBMITTED, "CHANGES_REQUESTED")
CLONE = 1_000_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share; a temporary one only where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_auditlake_written", None) or tempfile.mkdtemp(prefix="auditlake-")
        spark._auditlake_written = folder
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a new folder."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Domain:
    """Views over one folder of tables. Nothing is computed until a query's result is."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, table: str) -> DataFrame:
        return read(self.spark, self.sf_dir, table)

    def _with_clones(self, rows: DataFrame, id_col: str, changed: dict | None = None) -> DataFrame:
        """rows, and a second copy of every fiftieth document under another id."""
        copy = rows.filter(F.col(id_col) % 50 == 2)
        copy = copy.withColumns({id_col: F.col(id_col) + CLONE, **(changed or {})})
        return rows.unionByName(copy)

    def headers(self) -> DataFrame:
        n = max(1, self.read("supplier").count() // 5)
        o = self.read("orders").selectExpr("o_orderkey as id", f"o_custkey % {n} as supplier_id", "o_custkey", "o_orderstatus", "cast(o_orderdate as date) as day")
        cur = "case o_custkey % 4 when 1 then 'AED' when 2 then 'USD' else 'SAR' end"
        status = """case o_orderstatus when 'F' then 'APPROVED' when 'O' then if(id % 2 = 0, 'PROJECT_REVIEW', 'FINANCE_REVIEW')
            else case id % 3 when 0 then 'DRAFT' when 1 then 'CHANGES_REQUESTED' else 'REJECTED' end end"""
        rows = o.selectExpr(
            "id", "id as order_id", "supplier_id", "supplier_id % 2 as company_id", "supplier_id % 2 * 5 + o_custkey % 5 as project_id", "o_custkey % 7 as created_by",
            "if(id % 101 = 0, null, day) as invoice_date", "unix_date(day) * 86400L + id as created_at", f"{cur} as currency", f"{status} as status",
            "case id % 20 when 0 then 'CREDIT_NOTE' when 1 then 'DEBIT_NOTE' else 'INVOICE' end as document_type",
            "if(id % 20 < 2, id - id % 20 + 2, null) as related_invoice_id", "if(id % 103 = 0, null, concat('INV-', id)) as invoice_number",
            "if(id % 3 = 0, id, null) as purchase_order_id",
        )
        return self._with_clones(rows, "id", {"invoice_number": F.concat(F.lit("inv "), F.col("id")), "created_at": F.col("created_at") + CLONE})

    def items(self) -> DataFrame:
        """Lines with their position; those of a document are together in one partition (by invoice_id), copies of documents too."""
        li = self.read("lineitem")
        ids = F.when(F.col("l_orderkey") % 50 == 2, F.array(F.col("l_orderkey").cast("long"), F.col("l_orderkey") + F.lit(CLONE).cast("long"))).otherwise(F.array(F.col("l_orderkey").cast("long")))
        order = Window.partitionBy("invoice_id", "l_orderkey").orderBy(*[c for c in li.columns if c != "l_orderkey"])
        li = li.withColumn("invoice_id", F.explode(ids)).repartition("invoice_id").withColumn("position", F.row_number().over(order))
        gross = F.col("l_extendedprice").cast(MONEY)
        rows = li.select(
            "invoice_id", F.col("l_orderkey").alias("order_id"), "position", F.col("l_partkey").alias("part_id"),
            F.col("l_quantity").cast("decimal(14,4)").alias("quantity"), gross.alias("gross_amount"),
            money(gross * F.col("l_discount").cast("decimal(4,2)")).alias("discount_amount"), (F.col("l_tax").cast("decimal(4,2)") * 100).cast("decimal(7,4)").alias("tax_rate"),
        )
        g, d, q = F.col("gross_amount"), F.col("discount_amount"), F.col("quantity")
        return rows.withColumns(line_amounts(g, d, F.col("tax_rate"))).withColumns({"unit_price": F.round(g / q, 4).cast(PRICE), "effective_price": effective_unit_price(g, d, q)})

    def described_items(self) -> DataFrame:
        """items with description, its phrase, unit and category of their part."""
        unit = F.expr("case p_size % 3 when 0 then 'piece' when 1 then 'pcs' else 'kg' end")
        part = self.read("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("description"), phrase(F.col("p_name")).alias("phrase"), unit_key(unit).alias("unit"), F.col("p_type").alias("category"))
        return self.items().join(part, "part_id")

    def totals(self) -> DataFrame:
        sums = [F.sum(c).cast(MONEY).alias(a) for c, a in (("gross_amount", "subtotal"), ("discount_amount", "discount_total"), ("tax_amount", "tax_total"), ("total_amount", "grand_total"))]
        return self.items().groupBy(F.col("invoice_id").alias("id")).agg(*sums)

    def invoices(self) -> DataFrame:
        """Headers with totals, null for documents without lines, and the totals printed on the document.

        The printed net amount is wrong where the printed total is, the printed tax is right; where no total is
        printed, neither are the other two.
        """
        headers = self.headers().repartition("id")  # as lines are, so that what is made of both is partitioned by document
        rows = headers.join(self.totals(), "id", "left").withColumn("net_total", (F.col("subtotal") - F.col("discount_total")).cast(MONEY))
        printed = lambda c, add="0.00": F.expr(f"case when order_id % 13 = 0 then null when order_id % 11 = 0 then {c} + {add} else {c} end").cast(MONEY)
        return rows.withColumns({"document_subtotal": printed("net_total", "1.00"), "document_tax_total": printed("tax_total"), "document_grand_total": printed("grand_total", "1.00"), "number_key": number_key(F.col("invoice_number"))})

    def attachments(self) -> DataFrame:
        """(id, company_id, sha256): each document's file is a text of the documents table."""
        texts = self.read("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
        n = max(1, texts.count())
        rows = self.headers().select("id", "company_id", (F.col("order_id") % n).alias("doc_id"))
        return rows.join(texts.groupBy("doc_id").agg(F.min("sha256").alias("sha256")), "doc_id").select("id", "company_id", "sha256")

    def stored(self) -> Domain:
        """This domain with lines and documents written once, for queries that read them many times."""
        return Stored(self)

    def suppliers(self) -> DataFrame:
        """(supplier_id, company_id, region_code, verification, supplier_name)."""
        s = self.read("supplier").filter("s_suppkey is not null")
        nation, region = self.read("nation"), self.read("region")
        geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
        rows = s.join(F.broadcast(geo), s.s_nationkey == F.col("n_nationkey"), "left")
        state = F.expr("case s_suppkey % 4 when 0 then 'VERIFIED' when 1 then 'PENDING' when 2 then 'REJECTED' else 'UNVERIFIED' end")
        return rows.select(F.col("s_suppkey").alias("supplier_id"), (F.col("s_suppkey") % 2).alias("company_id"), F.col("r_name").alias("region_code"), state.alias("verification"), F.col("s_name").alias("supplier_name"))

    def budgets(self) -> DataFrame:
        """(project_id, currency, budget): ten projects by three currencies, from the headers that use them."""
        keys = self.headers().select("project_id", "currency").distinct()
        return keys.withColumn("budget", (F.lit(10_000_000) * (1 + F.col("project_id") % 3)).cast(MONEY))

    def limits(self) -> DataFrame:
        """(project_id, currency, user_id, amount): each project has two managers in each currency."""
        keys = self.headers().select("project_id", "currency").distinct()
        rows = keys.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        return rows.select("project_id", "currency", (F.lit(100) + F.col("project_id") * 2 + F.col("k")).alias("user_id"), (F.lit(50_000) + 25_000 * (F.col("project_id") % 4) + 10_000 * F.col("k")).cast(MONEY).alias("amount"))

    def order_items(self) -> DataFrame:
        """(purchase_order_id, position, ordered, order_price, order_tax, received)."""
        rows = self.items().filter((F.col("invoice_id") < CLONE) & (F.col("order_id") % 3 == 0))
        received = F.expr("if(position % 5 <> 0, quantity - position % 2, 0)").cast("decimal(14,4)")
        return rows.select(
            F.col("order_id").alias("purchase_order_id"), "position", (F.col("quantity") + F.col("position") % 3 - 1).cast("decimal(14,4)").alias("ordered"),
            F.expr("if(position % 4 = 0, unit_price + 1, unit_price)").cast(PRICE).alias("order_price"), F.col("tax_rate").alias("order_tax"), received.alias("received"),
        )


class Stored(Domain):
    """A domain whose lines, headers and documents are Parquet tables in the shared folder, each written when first read."""

    def __init__(self, source: Domain):
        super().__init__(source.spark, source.sf_dir)
        self.written: dict[str, DataFrame] = {}

    def _once(self, name: str, made) -> DataFrame:
        if name not in self.written:
            self.written[name] = written(made(), name)
        return self.written[name]

    def headers(self) -> DataFrame:
        return self._once("headers", super().headers)

    def items(self) -> DataFrame:
        return self._once("items", super().items)

    def described_items(self) -> DataFrame:
        """Only what lines are compared by."""
        return self._once("described-items", lambda: super(Stored, self).described_items().select("invoice_id", "position", "phrase", "unit", "quantity", "effective_price"))

    def invoices(self) -> DataFrame:
        return self._once("invoices", super().invoices)
