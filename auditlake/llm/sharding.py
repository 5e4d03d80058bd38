"""Extendible hashing: shards are hash prefixes, and only those over the byte limit are split on another bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import materialize

#: Bits of the hash that one round looks at; the md5 of the key has four such words, then come those of a row's own number.
WORD = 32
WORDS = 6
#: Finer than the expected depth by so many bits, so that one round settles nearly all rows.
SLACK = 5
#: A directory of at most so many rows (about 100 MB) is broadcast; a larger one is joined by a shuffle.
SMALL_DIRECTORY = 1_000_000


def hash_word(key: Column, word: int) -> Column:
    """Bits 32*word to 32*word+31 of the key's md5 as a long."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 8 * word + 1, 8), 16, 10).cast("long")


def _leaves(cells: DataFrame, depth: int, base: int, limit: int) -> DataFrame:
    """(shard, cell, cell_depth, shard_depth, shard_bytes) for cells whose shard fits; cell is a prefix of depth bits.

    A prefix's bytes fall with its length, so the shard of a cell is its shortest prefix that fits.
    """
    every = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    sums = every.groupBy("parent", "d", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n_rows"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("n_rows") == 1))
    found = every.select("parent", "cell", "d", "prefix").join(fits, ["parent", "d", "prefix"])
    best = found.groupBy("parent", "cell").agg(F.min_by(F.struct("d", "prefix", "shard_bytes"), "d").alias("b"))
    bits = F.when(F.col("b.d") == 0, F.lit("")).otherwise(F.expr("right(lpad(bin(b.prefix), 64, '0'), b.d)"))
    return best.select("parent", "cell", F.concat("parent", bits).alias("shard"), (F.lit(base) + F.col("b.d")).cast("int").alias("shard_depth"), F.col("b.shard_bytes").alias("shard_bytes"))


def assign_shards(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """rows' key and bytes with shard (its hash prefix as text of 0s and 1s), shard_depth and shard_bytes.

    Every shard holds at most limit bytes, or a single row. The hash is the key's md5; when all its 128 bits are
    spent (many rows with one key), the bits of a number that each row got when the sizes were written go on, so
    a key with any share of the rows still splits. Null keys share one hash. A null size counts as 0. An empty
    table gives no rows. Only key and size are read, so further columns do not matter.
    """
    number = F.xxhash64(F.monotonically_increasing_id())
    own = F.lpad(F.hex(number), 16, "0")
    sized = rows.select(F.col(key).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), own.alias("own"))
    left = materialize(sized, "shard-sizes").withColumn("parent", F.lit(""))
    total = left.agg(F.sum("bytes")).first()[0] or 0
    out, base, word, used = None, 0, 0, 0
    expected = max(total / max(limit, 1), 1)
    while True:
        # md5 words first, then the two words of the row's own number
        bits = hash_word(F.coalesce(F.col("key").cast("string"), F.lit("")), word) if word < 4 else F.conv(F.substring("own", 8 * (word - 4) + 1, 8), 16, 10).cast("long")
        step = min(WORD - used, max(int(expected).bit_length() + SLACK, 8))
        rest = F.expr(f"shiftright(w, {WORD - used - step}) & {(1 << step) - 1}L")
        cut = left.withColumn("w", bits).withColumn("cell", rest).drop("w")
        cells = materialize(cut.groupBy("parent", "cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "shard-cells")
        leaves = materialize(_leaves(cells, step, base, limit), "shard-directory")
        last = word == WORDS - 1 and used + step == WORD
        small = leaves.count() <= SMALL_DIRECTORY
        joined = cut.join(F.broadcast(leaves) if small else leaves, ["parent", "cell"], "left")
        settled = joined if last else joined.filter(F.col("shard").isNotNull())
        part = settled.select("key", "bytes", F.coalesce("shard", "parent").alias("shard"), F.coalesce("shard_depth", F.lit(base)).alias("shard_depth"), F.coalesce("shard_bytes", "bytes").alias("shard_bytes"))
        out = part if out is None else out.unionByName(part)
        over = cells.join(leaves, ["parent", "cell"], "left_anti").agg(F.count("*"), F.max("bytes")).first()
        if last or not over[0]:
            return out.select(F.col("key").alias(key), "bytes", "shard", "shard_depth", "shard_bytes")
        prefix = F.expr(f"right(lpad(bin(cell), 64, '0'), {step})")
        left = joined.filter(F.col("shard").isNull()).select("key", "bytes", "own", F.concat("parent", prefix).alias("parent"))
        left = materialize(left, "shard-left")
        base, used, expected = base + step, used + step, max(over[1] / max(limit, 1), 1)
        if used == WORD:
            word, used = word + 1, 0

