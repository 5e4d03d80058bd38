"""WARC archives by way of a chunked record table.

A payload is never one row beyond its source: it travels as (record id, chunk number, bytes) rows of at most
CHUNK bytes, is digested chunk by chunk, and is written to and read from the archive in such pieces.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from auditlake.llm.common import input_partitions, join_counted, materialize, scratch_path

CHUNK = 64 << 10
#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_rows(records: DataFrame, payload: str, chunk: int = CHUNK) -> DataFrame:
    """records' other columns, chunk_no from 0, last, and data; an empty payload is one empty chunk.

    Only chunk numbers are exploded, and each row's data is cut from the payload as the row is made, so a payload's
    chunks are never held together.
    """
    others = [c for c in records.columns if c != payload]
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / chunk)).cast("int")
    each = records.select(*others, payload, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return each.select(*others, "chunk_no", (F.col("chunk_no") == n - 1).alias("last"), F.substring(F.col(payload), F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))


def digest_rows(chunks: DataFrame) -> DataFrame:
    """(page_id, fp, url, payload_bytes, payload_digest) of chunk rows that follow each other in order, as chunk_rows() gives them."""

    def run(batches):
        import pyarrow as pa

        sha, n = hashlib.sha1(), 0
        for b in batches:
            out = []
            for i, (last, data) in enumerate(zip(b.column("last").to_pylist(), b.column("data"), strict=True)):
                piece = data.as_buffer()
                sha.update(piece)
                n += piece.size
                if last:
                    out.append((i, n, sha.hexdigest()))
                    sha, n = hashlib.sha1(), 0
            rows = b.select(["page_id", "fp", "url"]).take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["page_id", "fp", "url", "payload_bytes", "payload_digest"])

    return chunks.mapInArrow(run, "page_id long, fp long, url string, payload_bytes long, payload_digest string")


def _uri(page_id, fp) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{fp & (1 << 64) - 1:016x}>"


def record_header(r: dict) -> bytes:
    """The head of a WARC 1.1 record; r is a row of record_table()."""
    revisit = r["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {_uri(r['page_id'], r['fp'])}", f"WARC-Date: {DATE}"]
    if r["url"]:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"]))
    lines += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Payload-Length: {r['payload_bytes']}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(r['refers_to'], r['fp'])}"]
    size = len(HTTP) + (0 if revisit else r["payload_bytes"])
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def record_table(digests: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """digests with record_type and refers_to: of equal payloads of at least `least` bytes the largest page_id is the response."""
    many = digests.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    many = materialize(many, "warc-payloads")
    rows = join_counted(digests, many, "payload_digest", "page_id", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.select(*digests.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """Write gzipped WARC files under path, one member for each record; returns the table of written files.

    Heads and chunks of a record meet as small rows in key order, and go to the file one by one. A task that is run
    again writes a file of another name; only files in the returned table count.
    """
    n = input_partitions(chunks)
    fields = ["page_id", "fp", "chunk_no", "data", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    heads = records.select("page_id", "fp", F.lit(-1).alias("chunk_no"), F.lit(None).cast("binary").alias("data"), *fields[4:])
    null = [F.lit(None).cast(t).alias(c) for c, t in zip(fields[4:], ["string", "long", "string", "string", "long"], strict=True)]
    rows = heads.unionByName(chunks.select("page_id", "fp", "chunk_no", "data", *null))
    rows = rows.repartition(n, "page_id", "fp").sortWithinPartitions("page_id", "fp", "chunk_no")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
        out, member, key, at, written, wanted = None, None, None, None, 0, False

        def close():
            nonlocal member
            if member is not None:
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                member = None

        for b in batches:
            for r in b.to_pylist():
                own = (r["page_id"], r["fp"])
                if r["chunk_no"] < 0:
                    if own == key:
                        continue  # a repeated row
                    close()
                    out = out or store.open_output_stream(name)
                    member, key, at, wanted = zlib.compressobj(4, zlib.DEFLATED, 31), own, -1, r["record_type"] == "response"
                    out.write(member.compress(record_header(r)))
                    written += 1
                elif wanted and r["chunk_no"] == at + 1:
                    at += 1
                    out.write(member.compress(r["data"]))
        close()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name.rpartition('/')[2]}"]), pa.array([written], pa.int64())], ["file", "records"])

    return materialize(rows.mapInArrow(run, "file string, records long"), "warc-files")


def _pieces(stream, size: int = CHUNK):
    """Unpacked bytes of concatenated gzip members, at most `size` at a time."""
    unpack, rest = zlib.decompressobj(31), b""
    while True:
        rest = rest or stream.read(size)
        if not rest:
            return
        piece = unpack.decompress(rest, size)
        rest = unpack.unconsumed_tail
        if unpack.eof:
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)
        if piece:
            yield piece


def parse_archive(stream, chunk: int = CHUNK):
    """(header fields, chunk number, payload bytes, last) for each piece of each record of a gzipped WARC stream."""
    source, held = _pieces(stream, chunk), b""

    def head() -> bytes:
        nonlocal held
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(source, None)
            if more is None:
                return b""
            held += more
        got, held = held[:end], held[end + 4 :]
        return got

    while True:
        lines = head().decode().split("\r\n")
        if lines == [""]:
            return
        fields = dict(line.split(": ", 1) for line in lines[1:])
        left = int(fields["Content-Length"]) - len(head()) - 4
        number = 0
        while True:
            while left and not held:
                held = next(source)
            piece, held = held[: min(left, chunk)], held[min(left, chunk) :]
            left -= len(piece)
            yield fields, number, piece, not left
            number += 1
            if not left:
                break
        while len(held) < 4:
            held += next(source)
        held = held[4:]


def _page(uri: str):
    page = uri.split(":")[2]
    return None if page == "null" else int(page)


def _read(files: DataFrame, schema: str, rows_of):
    """Each file is read by one task."""
    dealt = files.select("file").repartition(max(1, files.count()), "file")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for path in b.column("file").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as stream:
                    some = []
                    for row in rows_of(stream):
                        some.append(row)
                        if len(some) >= 256:
                            yield pa.RecordBatch.from_pylist(some, schema=arrow)
                            some = []
                    if some:
                        yield pa.RecordBatch.from_pylist(some, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(run, schema)


def read_chunks(files: DataFrame) -> DataFrame:
    """The chunked record table of archives: record_type, page_id, chunk_no, data, sha1 (of the payload so far), last."""

    def rows(stream):
        for fields, number, piece, last in parse_archive(stream):
            if not number:
                sha = hashlib.sha1()
            sha.update(piece)
            yield {"record_type": fields["WARC-Type"], "page_id": _page(fields["WARC-Record-ID"]), "chunk_no": number, "data": piece, "sha1": sha.hexdigest(), "last": last}

    return _read(files, "record_type string, page_id long, chunk_no int, data binary, sha1 string, last boolean", rows)


def read_records(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, without its payload.

    A response's length and digest are counted again from its chunks, and must be those of its head; a revisit's are
    those of its head, which are its response's.
    """

    def rows(stream):
        for fields, number, piece, last in parse_archive(stream):
            if not number:
                sha, n = hashlib.sha1(), 0
            sha.update(piece)
            n += len(piece)
            if last:
                kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if kind == "response" and (digest, size) != (sha.hexdigest(), n):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                yield {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None}

    return _read(files, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", rows)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each page; returns the table of written files.

    Null payloads count as empty, null urls are left out, a null id is a record of its own. Rows that repeat an id and
    its payload are one record; one id with different payloads has a record for each. An empty table writes nothing.
    Only the three columns are read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("fp", F.xxhash64("payload"))
    chunks = chunk_rows(rows.select("page_id", "fp", "url", "payload"), "payload")
    digests = materialize(digest_rows(chunks), "warc-digests")
    return write_archives(record_table(digests), chunks, path)


def archive_and_read(pages: DataFrame) -> DataFrame:
    return read_records(archive(pages, scratch_path(pages.sparkSession, "warc")))
