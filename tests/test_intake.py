"""Refused payloads and documents, and admission in order."""

import base64

from pyspark.sql import functions as F

from auditlake.operators import intake
from auditlake.sources import structured

TEXTS = ["Seller", "300", "2024-02-29T10:11:12Z", "115.00", "15"]


def payload(*texts, first=1):
    return b"".join(bytes([t, len(x.encode())]) + x.encode() for t, x in enumerate(texts, first))


GOOD = payload(*TEXTS)


def test_payloads(spark):
    cases = {
        "good": GOOD, "optional": GOOD + b"\x07\x01x", "short": GOOD[:-1], "missing": payload(*TEXTS[:4]), "order": GOOD + b"\x05\x01x", "tag": GOOD + b"\x0a\x01x",
        "utf8": payload("x", *TEXTS[1:]).replace(b"x", b"\xff"), "empty": b"", "half": GOOD + b"\x06", "zero": b"\x00\x00" + GOOD, "long": payload("s" * 250, "t" * 250, *TEXTS[2:]),
    }
    for i, wrong in enumerate(("not a date", "2024-02-30T00:00:00Z", "2024-02-29 10:00:00", "2024-02-29")):
        cases[f"time{i}"] = payload(*TEXTS[:2], wrong, *TEXTS[3:])
    for i, wrong in enumerate(("-12.00", "1e3", "+3", "12,00", "", "1.23456", "NaN")):
        cases[f"total{i}"], cases[f"tax{i}"] = payload(*TEXTS[:3], wrong, "15"), payload(*TEXTS[:4], wrong)
    cases |= {"seller": payload(" ", *TEXTS[1:]), "number": payload("Seller", "", *TEXTS[2:]), "zone": payload("  Seller \n Co", "300", "2024-02-29T10:11:12.5+03:00", "0115.00", "0")}
    rows = [(k, base64.b64encode(v).decode()) for k, v in cases.items()] + [("null", None), ("text", "no base64 !"), ("lines", base64.encodebytes(GOOD * 2).decode())]
    got = structured.payload_columns(spark.createDataFrame(rows, "id string, p string"), "id", "p").collect()
    assert {tuple(r) for r in got} == {("good", *TEXTS), ("optional", *TEXTS), ("zone", "Seller Co", "300", "2024-02-29T10:11:12.5+03:00", "115.00", "0")}


def test_documents(spark):
    line = '<c:InvoiceLine><b:ID>{}</b:ID><b:InvoicedQuantity unitCode="KGM">{}</b:InvoicedQuantity>{}<c:Item><b:Name>it  em</b:Name></c:Item><c:Price><b:PriceAmount>{}</b:PriceAmount></c:Price></c:InvoiceLine>'
    allowance = "<c:AllowanceCharge><b:ChargeIndicator>{}</b:ChargeIndicator><b:Amount>{}</b:Amount></c:AllowanceCharge>"
    off = allowance.format("false", "1.50") + allowance.format("false", "x") + allowance.format("true", "9") + allowance.format("false", "2")
    lines = [line.format(1, "2.5", off, "3"), line.format(2, "many", "", "3"), line.format(3, "1e2", "", "3"), line.format(4, "-5", "", "3"), line.format(5, "1", allowance.format("false", "-1"), "4.1234"), line.format(6, "1", "", "+3")]
    good = "<Invoice xmlns:c='x' xmlns:b='y'><b:ID>7</b:ID>" + "".join(lines) + "</Invoice>"
    rows = [(1, good), (2, None), (3, ""), (4, "<Order><ID>1</ID></Order>"), (5, "<!DOCTYPE x>" + good), (6, "<Invoice><ID>1</ID></Invoice>"), (7, good.replace("Invoice", "DebitNote").replace("DebitNoted", "Debited"))]
    got = structured.xml_lines(spark.createDataFrame(rows, "id long, xml string"), "id", "xml").orderBy("id", "position")
    got = got.select("id", "document_number", "position", "description", "unit_code", F.col("quantity").cast("string"), F.col("unit_price").cast("string"), F.col("discount_amount").cast("string")).collect()
    want = [("7", 1, "it em", "KGM", "2.5000", "3.0000", "3.50"), ("7", 5, "it em", "KGM", "1.0000", "4.1234", None)]
    assert [tuple(r) for r in got] == [(i, *w) for i in (1, 7) for w in want]


def test_fields_of_documents_and_their_comparison(spark):
    total = "<L><TaxExclusiveAmount>100</TaxExclusiveAmount><PayableAmount>115.00</PayableAmount></L>".replace("L>", "LegalMonetaryTotal>")
    party = "<AccountingSupplierParty><Party><PartyName><Name> The  Seller</Name></PartyName></Party></AccountingSupplierParty>"
    rows = [
        (1, f"<Invoice><ID>INV 7</ID><IssueDate>2024-02-29</IssueDate><DocumentCurrencyCode>sar</DocumentCurrencyCode>{party}<TaxTotal><TaxAmount>15.0</TaxAmount></TaxTotal>{total}</Invoice>"),
        (2, f"<CreditNote><ID>8</ID><IssueDate>2024-02-30</IssueDate><TaxTotal><TaxAmount>-15</TaxAmount></TaxTotal>{total}</CreditNote>"),
        (3, "<Invoice><IssueDate>soon</IssueDate></Invoice>"), (4, None),
    ]
    fields = structured.xml_fields(spark.createDataFrame(rows, "id long, xml string"), "id", "xml")
    got = {r.id: tuple(r)[1:] for r in fields.collect()}
    assert got == {1: ("Invoice", "The Seller", None, "INV 7", "2024-02-29", "sar", "100", "15.0", "115.00"), 2: ("CreditNote", None, None, "8", None, None, "100", None, "115.00")}
    held = [(1, "Invoice", "the seller", "300", "inv-7", "2024-02-29", "SAR", "100.00", "15.00", "115.00"), (2, "Invoice", "x", None, "8", None, "SAR", None, "1", "116.00"), (3, *(None,) * 9)]
    confirmed = spark.createDataFrame(held, "id long, " + ", ".join(f"{c} string" for c in structured.COMPARED["XML"]))
    assert sorted(map(tuple, structured.source_comparison(confirmed, fields, "XML").collect())) == [(1, 8, 0, 0, "PASS"), (2, 3, 2, 1, "WARNING"), (3, 0, 0, 0, "NOT_CHECKED")]


def test_admission(spark):
    rows = [(1, f"2024-01-01 00:00:{s:02}") for s in (0, 5, 9, 10, 15, 21)] + [(2, "2024-01-01 00:00:00")] * 2
    events = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(map(tuple, intake.admission(events, 10).collect())) == [(1, 3, 3), (2, 1, 1)]


def test_a_document_is_parsed_once_for_all_that_is_read_of_it(spark):
    rows = spark.sql("SELECT 1L AS id, '<!-- a --><Invoice><ID>x</ID></Invoice>' AS xml UNION ALL SELECT 2L, '<CreditNote><ID>y</ID><CreditNoteLine></Invoice>'")
    fields = structured.xml_fields(rows, "id", "xml")
    assert fields._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1  # a filter below it would be a second time
    assert [(r.id, r.document_type, r.invoice_number) for r in fields.collect()] == [(1, "Invoice", "x")]


def test_payloads_are_made_and_decoded_once(spark):
    from auditlake.plans.intake import QUERIES

    plan = QUERIES["tlv_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Base64.encode") == 1 and plan.count("as timestamp)") == 1
