"""Token ids in ORC: run-length encoded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import input_partitions, materialize, scratch_path
from auditlake.llm.pieces import Encode, Recent, batches_of, encode_texts, packed

END_ID = 2
#: ORC writer settings: 16 MB stripes, an index entry for each 10,000 rows, Bloom filters on doc_id.
ORC = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "10000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.encoding.strategy": "SPEED", "compression": "snappy"}

_encoders: dict[str, Encode] = {}
#: Words of the last batches by vocabulary, one per Python worker.
_recent: dict[str, Recent] = {}
#: The bytes that byte-level vocabularies write as themselves; the others follow from code point 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte."""
    others = [b for b in range(256) if b not in set(_PRINTED)]
    return {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(others)}


def encoder(vocabulary: str) -> Encode:
    """The tokenizers library on one vocabulary file, one per Python worker.

    Strings of a space and letters only are one word to the pre-tokenizer and hold no added token, so they go to the
    tokenizer's model alone; all others go through the whole tokenizer, as it is loaded.
    """
    if vocabulary not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(vocabulary)
        model, letters = Tokenizer(full.model), byte_letters()

        def encode(texts: list[str]):
            words = [i for i, t in enumerate(texts) if t[:1] == " " and t[1:].isalpha()]
            others = sorted(set(range(len(texts))).difference(words))
            flat, sizes = [], np.zeros(len(texts), np.int64)
            for some, tokenizer, form in ((words, model, lambda t: t.encode().decode("latin-1").translate(letters)), (others, full, str)):
                for lo in range(0, len(some), 4096):
                    part = some[lo : lo + 4096]
                    lists = [e.ids for e in tokenizer.encode_batch_fast([form(texts[i]) for i in part], add_special_tokens=False)]
                    sizes[part] = list(map(len, lists))
                    flat.append(np.fromiter(chain.from_iterable(lists), "<i4"))
            done = packed(np.concatenate(flat) if flat else np.zeros(0, "<i4"), sizes[words + others])
            order = np.argsort(np.array(words + others, np.int64))
            raw = done.take(pa.array(order)).buffers()[2]
            return np.frombuffer(raw, "<i4")[: int(sizes.sum())] if len(texts) and raw else np.zeros(0, "<i4"), sizes

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def encode_batches(vocabulary: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for some in batches_of(batch, 1):
                ids, at = encode_texts(some.column(1), encoder(vocabulary), _recent.setdefault(vocabulary, Recent()))
                ends = at + np.arange(len(at))
                values = np.full(ends[-1], end_id, "<i4")
                own = np.ones(len(values), bool)
                own[ends[1:] - 1] = False
                values[own] = ids
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(values))], ["doc_id", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write (doc_id, ids, shard, row) as ORC in ascending doc_id order.

    Files follow each other in doc_id order, and rows do within a file; shard numbers the files and row the rows.
    Null and empty texts hold end_id alone; very long texts are encoded whole. Null ids come first; rows with equal ids are ordered by text. An
    empty table writes an empty folder with the schema. Further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = input_partitions(rows)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ids = ordered.mapInArrow(encode_batches(vocabulary, end_id), "doc_id long, ids array<int>")
    at = F.monotonically_increasing_id()
    ids.select("doc_id", "ids", F.shiftright(at, 33).cast("int").alias("shard"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Spark reads ORC by stripes in parallel, and filters on doc_id prune stripes by index and Bloom filter."""
    return spark.read.schema("doc_id long, ids array<int>, shard int, row long").orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents: files and stripes that cannot hold them are skipped by statistics, indexes and Bloom filters."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(ids))


def checksums(batches):
    """n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, from Arrow's own buffers."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        ids = b.column("ids")
        at = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), b.column("row"), pa.array(np.diff(at).astype("int64")), pa.array(crc, pa.int64())], ["doc_id", "shard", "row", "n_tokens", "ids_crc32"])


def token_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written tokens; start counts the ids of all rows before it.

    Starts are added up within each file, and one row for each file carries the sums of the files before it: those
    rows, one for each file of at least a task's size, are all that one task and the broadcast hold.
    """
    sums = tokens.select("doc_id", "shard", "row", "ids").mapInArrow(checksums, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long")
    sums = materialize(sums, "token-sums")
    files = sums.groupBy("shard").agg(F.sum("n_tokens").alias("in_file"))
    before = F.sum("in_file").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return sums.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(files), "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_index(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return token_index(read_tokens(docs.sparkSession, path))
