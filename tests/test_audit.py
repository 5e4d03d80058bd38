"""Golden values of money and text, queries against their SQL, and the streaming twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

from auditlake.functions import money, text
from auditlake.operators import events as batch
from auditlake.operators import reports
from auditlake.plans import catalogue
from auditlake.streaming import events as streaming

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def dec(x, kind="decimal(22,2)"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(
    "quantity,price,discount,rate,want",
    [("2", "100", "10", "15", ("190.00", "28.50", "218.50")), ("3", "0.335", "0", "15", ("1.01", "0.15", "1.16")), ("1000000", "1000000000", "0.01", "0", ("999999999999999.99", "0.00", "999999999999999.99"))],
)
def test_line(spark, quantity, price, discount, rate, want):
    gross = money.money(dec(quantity, "decimal(14,4)") * dec(price, "decimal(18,4)"))
    parts = money.line_amounts(gross, dec(discount), dec(rate, "decimal(7,4)"))
    assert tuple(str(x) for x in one(spark, *parts.values())) == want


def test_invalid_discount_is_null(spark):
    assert one(spark, money.line_amounts(dec("1"), dec("2"), dec("0", "decimal(7,4)"))["net_amount"])[0] is None


def test_quantiles(spark):
    a = F.array(*[dec(x, "decimal(22,4)") for x in ("90", "100", "110")])
    assert [float(x) for x in one(spark, *[money.quantile(a, k) for k in (1, 2, 3)])] == [95, 100, 105]


def test_keys(spark):
    got = one(spark, text.number_key(F.lit("INV-٠٠١")), text.number_key(F.lit("inv 001")), text.number_key(F.lit("--")), text.unit_key(F.lit("pcs")), text.unit_key(F.lit("قطعة")), text.phrase(F.lit("Cable CAT-6, 2m")))
    assert tuple(got) == ("inv001", "inv001", None, "piece", "piece", "cable cat6 2m")


def test_ratio_is_not_symmetric(spark):
    row = spark.createDataFrame([("tide", "diet")], "a string, b string").select(text.matching_ratio("a", "b"), text.matching_ratio("b", "a")).first()
    assert tuple(row) == (0.25, 0.5)


def test_safe_cell(spark):
    got = one(spark, *[reports.safe_cell(F.lit(x)) for x in ("=CMD|test", " +1", "plain", None)])
    assert tuple(got) == ("'=CMD|test", "' +1", "plain", "")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", ["line_calculation", "potential_duplicates", "split_invoice", "related_documents", "po_line_match", "budget_capacity", "price_history_exact", "monthly_trend", "workflow_fold", "session_events"])
def test_against_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=key)
    want = sorted((tuple(map(norm, r)) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLE[name]})").fetchall()), key=key)
    assert got == want


def test_every_query_has_sql_or_a_reason():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"price_history_fuzzy", "risk_scores_with_approximate"}  # they take a sequence matcher


def test_fuzzy_history_holds_the_exact_one(spark):
    exact = {(r.invoice_id, r.position) for r in catalogue.QUERIES["price_history_exact"](spark, SF).collect()}
    fuzzy = {(r.invoice_id, r.position) for r in catalogue.QUERIES["price_history_fuzzy"](spark, SF).collect()}
    assert exact <= fuzzy


def test_streaming_workflow_is_the_batch_fold(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = streaming.workflow(streaming.source(spark, str(tmp_path / "in"), events.schema)).writeStream.format("memory").queryName("wf").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("wf").collect())) == sorted(map(tuple, batch.fold_workflow(events).collect()))
