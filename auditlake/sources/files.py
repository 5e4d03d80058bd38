"""Uploads, manifests and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of uploads, by the first bytes of a file in hexadecimal, with the suffixes that they may have.
KINDS = {"application/pdf": ("25504446", ("pdf",)), "image/png": ("89504E470D0A1A0A", ("png",)), "image/jpeg": ("FFD8FF", ("jpg", "jpeg"))}
#: Fixed value: most bytes of an upload.
MOST_BYTES = 10 << 20
MANIFEST = "id string, file string, sha256 string, language string, kind string, split string, family string, synthetic boolean, expected map<string, string>"


def media_type(content: Column) -> Column:
    """The kind of a file by its first bytes, null if unknown."""
    out = F.lit(None).cast("string")
    for kind, (magic, _) in KINDS.items():
        out = F.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, kind).otherwise(out)
    return out


def uploads(files: DataFrame) -> DataFrame:
    """(name, media_type, size, sha256, error) of files (path, content), as spark.read.format("binaryFile") gives them.

    A file is refused if it is empty or too large, of no known kind, or has the suffix of another kind.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    fits = F.lit(False)
    for kind, (_, suffixes) in KINDS.items():
        fits = fits | ((F.col("media_type") == kind) & suffix.isin(*suffixes))
    size = F.octet_length("content")
    error = F.when(size == 0, "EMPTY").when(size > MOST_BYTES, "TOO_LARGE").when(F.col("media_type").isNull(), "UNKNOWN_TYPE").when(~fits, "WRONG_SUFFIX")
    rows = files.withColumn("media_type", media_type(F.col("content")))
    return rows.select(name.alias("name"), "media_type", size.cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), error.alias("error"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON manifest, one array or one record to a line; fields that a record lacks are null."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Results as JSON lines, nulls written."""
    rows.write.option("ignoreNullFields", False).json(path)


def append_log(batch: DataFrame, path: str) -> None:
    """Add rows to a log that is never changed; for foreachBatch and batches alike."""
    batch.write.mode("append").parquet(path)
