"""Benchmark decontamination: containment search by size-partitioned MinHash sketches, verified on exact shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from auditlake.llm.common import free_name, materialize

SIZE, THRESHOLD = 5, 0.8
#: Tables of at most so many bytes are broadcast; larger ones are joined by a shuffle.
SMALL_BYTES = 64 << 20


def token_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, so that punctuation and case do not hide a passage."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(rows: DataFrame, ids: list[str], n: int) -> DataFrame:
    """ids and w0..w(n-1) for each n consecutive entries of column words."""
    at = rows.filter(F.size("words") >= n).select(*ids, "words", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))
    return at.select(*ids, *[F.get("words", F.col("at") + i).alias(f"w{i}") for i in range(n)])


def _hash(n: int) -> Column:
    return F.xxhash64(*[F.col(f"w{i}") for i in range(n)])


def _text(n: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"w{i}") for i in range(n)])


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if its values have at most SMALL_BYTES."""
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= SMALL_BYTES else df


def item_shingles(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item_id, n, shingle, h, n_item): distinct shingles of each item; an item of fewer words is one shingle."""
    known = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), token_words(F.col(text_col)).alias("words"))
    known = known.filter(F.size("words") > 0)
    parts = []
    for n in range(1, size + 1):
        own = known.filter(F.size("words") == n) if n < size else known.filter(F.size("words") >= n)
        parts.append(_grams(own, ["item_id"], n).select("item_id", F.lit(n).alias("n"), _text(n).alias("shingle"), _hash(n).alias("h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.distinct()
    return out.withColumn("n_item", F.count("*").over(Window.partitionBy("item_id")))


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """The MinHash sketch of each item: its smallest hashes, as many as its size partition needs.

    Items are partitioned by size, each partition reaching up to a power of two u. A document that holds at least
    the threshold's share of an item's shingles lacks at most (1 - threshold) * u of them, so one of
    floor((1 - threshold) * u) + 1 sketch hashes is in it: the search misses nothing, however long the document.
    """
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double"))))
    need = F.floor(F.lit(round(1 - threshold, 9)) * upper + 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle"))
    return shingles.withColumn("_rank", rank).filter(F.col("_rank") <= need).select("item_id", "n", "h").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each item of which a document holds threshold or more.

    n_item counts an item's distinct shingles of size words (fewer if the item is shorter: the whole item),
    n_shared those found in the document. Rows that share an id count as one document. Rows with a null id,
    null or empty texts and items without words have no result; an empty table gives none. Only the named
    columns are read, so further columns do not matter. Candidates come from the sketches; all are verified on
    the text of the shingles, whole documents included.
    """
    shingles = materialize(item_shingles(items, item_col, item_text, size), "item-shingles")
    lengths = sorted(r[0] for r in shingles.select("n").distinct().collect())  # at most `size` values
    sketch = materialize(sketches(shingles, threshold), "item-sketches")
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    worded = texts.select("doc_id", token_words(F.col("text")).alias("words"))
    if not lengths:
        lengths = [size]
    hits = None
    for n in lengths:
        own = _grams(worded, ["doc_id"], n).select("doc_id", _hash(n).alias("h"))
        part = own.join(_small(sketch.filter(F.col("n") == n).select("item_id", "h")), "h").select("doc_id", "item_id").distinct()
        hits = part if hits is None else hits.unionByName(part)
    pairs = materialize(hits.distinct(), "leak-candidates")
    ids = _small(pairs.select("doc_id").distinct())
    kept = texts.join(ids, "doc_id", "left_semi").select("doc_id", token_words(F.col("text")).alias("words"))
    shared = None
    for n in lengths:
        own = _grams(kept, ["doc_id"], n).select("doc_id", _text(n).alias("shingle"))
        item = _small(shingles.filter(F.col("n") == n).select("item_id", "shingle", "n_item"))
        part = own.join(item, "shingle").select("doc_id", "item_id", "n_item", "shingle")
        shared = part if shared is None else shared.unionByName(part)
    counted = shared.join(_small(pairs), ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    found = counted.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return found.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold a benchmark item, with all of docs' columns, whatever their names.

    All rows of an id go if one of them holds an item, or all together do. Rows with a null id stay, and so do null and
    empty texts; very long texts are searched whole; an empty table of documents or items drops nothing.
    """
    leak = free_name(docs, "leak")
    leaks = find_leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(leak)).distinct()
    leaks = materialize(leaks, "leaks")
    return docs.join(_small(leaks), docs[id_col] == F.col(leak), "left_anti")
