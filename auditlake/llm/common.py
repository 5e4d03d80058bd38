"""Helpers that the operators share: scratch tables, words, hashing and skew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII blanks; everything between them is a word.
BLANKS = r"[\x20\x09-\x0D]+"
#: How many parts a key gets that holds an outsized share of the rows.
SALTS = 48


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_auditlake_scratch", None) or tempfile.mkdtemp(prefix="auditlake-")
        spark._auditlake_scratch = folder
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(run):
    """A mapInArrow function that gives unused memory back to the system when a task ends; workers live on for later stages."""

    def whole(batches):
        import contextlib
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def words(text: Column) -> Column:
    """Words of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def py_words(text: str | None) -> list[bytes]:
    """The same words in Python: bytes.split() splits at just these six blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_partitions(df: DataFrame) -> int:
    """Partitions of a scan, at least the session's shuffle partitions."""
    return max(shuffle_partitions(df.sparkSession), df.rdd.getNumPartitions())


def join_counted(rows: DataFrame, counted: DataFrame, key: str, spread: str, how: str = "inner", total: int | None = None, heavy: DataFrame | None = None) -> DataFrame:
    """Join rows with counted, which has one row and a column n (rows of that key) for each key.

    Keys with over 1/2000 of all rows number fewer than 2000, so their list has a fixed bound and may be
    broadcast. Their rows are dealt to SALTS parts by column spread, and their counted row is repeated for each part.
    total is the sum of n, and heavy a smaller table of key and n to find such keys in, where these are at hand.
    """
    total = (counted.agg(F.sum("n")).first()[0] or 0) if total is None else total
    least = max(total / 2000, 200)
    hot, salt = free_name(rows, "hot_key"), free_name(rows, "salt")
    keys = F.broadcast((counted if heavy is None else heavy).filter(F.col("n") > least).select(F.col(key).alias(hot)))
    left = rows.join(keys, rows[key] == keys[hot], "left").withColumn(salt, F.when(F.col(hot).isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = counted.withColumn(salt, F.explode(salts))
    return left.drop(hot).join(right, [key, salt], how).drop(salt)
