"""Uploads, manifests, logs and report files."""

import glob
import json

from auditlake.operators import reports
from auditlake.sources import files, structured


def test_uploads(spark):
    contents = {"a.pdf": b"%PDF-1.7 x", "b.PNG": b"\x89PNG\r\n\x1a\n..", "c.jpg": b"%PDF-1.4", "d.jpeg": b"\xff\xd8\xff\xe0", "e.pdf": b"", "f.txt": b"text"}
    rows = spark.createDataFrame([(f"file:/in/{n}", c) for n, c in contents.items()], "path string, content binary")
    got = {r.name: (r.media_type, r.error) for r in files.uploads(rows).collect()}
    assert got == {"a.pdf": ("application/pdf", None), "b.PNG": ("image/png", None), "c.jpg": ("application/pdf", "WRONG_SUFFIX"), "d.jpeg": ("image/jpeg", None), "e.pdf": (None, "EMPTY"), "f.txt": (None, "UNKNOWN_TYPE")}


def test_manifest_results_and_log(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "x", "language": "ar", "synthetic": True, "expected": {"currency": "SAR"}}, {"id": "y"}]))
    rows = files.manifest(spark, str(tmp_path / "m.json"))
    assert {r.id: (r.language, r.expected) for r in rows.collect()} == {"x": ("ar", {"currency": "SAR"}), "y": (None, None)}
    files.write_results(rows.select("id", "language").coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for f in glob.glob(str(tmp_path / "out/*.json")) for x in open(f)]
    assert lines == [{"id": "x", "language": "ar"}, {"id": "y", "language": None}]
    for _ in range(2):
        files.append_log(rows.select("id"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_csv_has_a_mark_and_safe_cells(spark, tmp_path):
    reports.write_csv(spark.createDataFrame([("=1+1", 1), (None, 2)], "name string, n int").coalesce(1), str(tmp_path / "csv"))
    text = open(glob.glob(str(tmp_path / "csv/*.csv"))[0], "rb").read()
    assert text.startswith(b"\xef\xbb\xbfname,n\r\n") and b"'=1+1,1\r\n" in text


def test_xml_limits(spark):
    line = "<InvoiceLine><ID>1</ID><InvoicedQuantity>1</InvoicedQuantity><Item><Name>x</Name></Item><Price><PriceAmount>2</PriceAmount></Price></InvoiceLine>"
    docs = {"ok": f"<?xml version='1.0'?><!-- x --><Invoice>{line * 150}</Invoice>", "inside": f"<a><Invoice>{line}</Invoice></a>", "many": "<Invoice>" + "<b/>" * 20_001 + line + "</Invoice>", "type": f"<!DOCTYPE x><Invoice>{line}</Invoice>"}
    rows = spark.createDataFrame(list(docs.items()), "id string, xml string")
    assert {r.id: r["count"] for r in structured.xml_lines(rows, "id", "xml").groupBy("id").count().collect()} == {"ok": 100}
