"""A trie of conversations' prefixes by truncation peeling.

From the greatest depth down, the conversations that end at a depth join the nodes that survive from below, and all with the
same prefix become one node. A node loses its last turn and goes on to the next depth as a survivor, with what its
subtree has added up so far. So nodes are found and counted in one descent.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import join_counted, materialize, tidy

#: Beyond this depth conversations whose turns fill up to LOCAL_BYTES are peeled in one task, as each depth costs a round.
DEEP, LOCAL_BYTES, TURN_BYTES = 64, 32 << 20, 24
#: A conversation's own turns begin after crc32(conv_id) modulo this, and its base is the next lower multiple of BASE.
HEADS, BASE = 9, 5
ROOT = b""


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as array<struct<turn, same, bytes>>, in order: by turn, nulls first, then role, then digest of the text.

    same is a digest of role and text, null ones being empty; bytes is the text's length in UTF-8. Only these 40 bytes of
    a turn meet in a conversation's row. Rows with a null conv_id take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    same = F.unhex(F.sha2(F.concat(F.hex(role), F.lit(":"), text).cast("binary"), 256))
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", role.alias("role"), F.substring(same, 1, 16).alias("same"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["same"].alias("same"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Each conversation: the first h turns of its base, then its own turns after the first h; h is crc32(conv_id) modulo HEADS."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.col("turns").isNull()
    bases = lists.filter(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base_id"), F.col("turns").alias("base"))
    both = lists.join(bases, (F.col("conv_id") - F.col("conv_id") % BASE) == F.col("base_id"), "left").withColumn("h", h)
    front = F.when(F.col("base").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("base", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.filter(~none).select("conv_id", F.concat(front, rest).alias("turns"))


def _paths(batches):
    """path: for each depth a digest of all turns so far."""
    for b in batches:
        paths, sizes = [], []
        for turns in b.column("turns").to_pylist():
            key, path = ROOT, []
            for t in turns:
                key = hashlib.sha256(key + t["same"]).digest()[:16]
                path.append(key)
            paths.append(path)
            sizes.append([t["bytes"] for t in turns])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([len(p) for p in paths], pa.int64()), pa.array(paths, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], ["conv_id", "depth", "path", "sizes"])


def _key(depth: Column) -> Column:
    """The last digest of the path to depth; the root's is empty."""
    return F.when(depth == 0, F.lit(b"")).otherwise(F.try_element_at("path", depth.cast("int")))


#: One row per node or ended conversation on its way down: what its subtree holds so far.
STATE = "depth long, path array<binary>, sizes array<long>, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
NODE = "depth long, key binary, parent_key binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _ended(paths: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return paths.select("depth", "path", "sizes", "conv_id", F.lit(1).cast("long").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))


def _regrouped(coming: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth from ended conversations and survivors, whose rows are added up before the shuffle too."""
    at = F.lit(depth).cast("long")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = coming.withColumn("key", _key(at)).groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), *sums)
    own = (F.col("n_convs") - 1) * F.coalesce(F.try_element_at("sizes", F.lit(max(depth, 1))), F.lit(0)) if depth else F.lit(0)
    return nodes.select(
        at.alias("depth"), "key", _key(at - 1).alias("parent_key") if depth else F.lit(None).cast("binary").alias("parent_key"), "conv_id", "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("saved_tokens") + own).cast("long").alias("saved_tokens"), "path", "sizes",
    )


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """A depth's nodes without their last turn: each is one child of the node that they now belong to."""
    return nodes.select(
        F.lit(depth - 1).cast("long").alias("depth"), F.slice("path", 1, max(depth - 1, 0)).alias("path"), F.slice("sizes", 1, max(depth - 1, 0)).alias("sizes"), "conv_id", "n_convs",
        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
    )


def _peel_all(least: int):
    """The same descent in one task: all rows in, the nodes below depth `least` out, and the survivors for that depth."""

    def run(batches):
        rows: dict[int, list] = {}
        for b in batches:
            for path, sizes, conv in zip(*(b.column(c).to_pylist() for c in ("path", "sizes", "conv_id")), strict=True):
                rows.setdefault(len(path), []).append((path, sizes, conv))
        live: dict[bytes, list] = {}
        for depth in range(max(rows, default=0), least, -1):
            for path, sizes, conv in rows.pop(depth, []):
                n = live.setdefault(path[depth - 1], [path, sizes, conv, 0, 0, 0, 0])
                n[2], n[3] = min(n[2], conv), n[3] + 1
            out, up = [], {}
            for key, (path, sizes, conv, n_convs, n_children, leaves, saved) in live.items():
                leaves, saved = max(leaves, 1), saved + (n_convs - 1) * sizes[depth - 1]
                parent = path[depth - 2] if depth > 1 else ROOT
                out.append((depth, key, parent, conv, n_convs, n_children, leaves, saved, None, None))
                n = up.setdefault(parent, [path, sizes, conv, 0, 0, 0, 0])
                n[2] = min(n[2], conv)
                for i, x in enumerate((n_convs, 1, leaves, saved)):
                    n[3 + i] += x
            live = up
            if out:
                yield batch(out)
        # survivors for the depth `least`
        out = [(least, key, None, conv, n_convs, n_children, leaves, saved, path[:least], sizes[:least]) for key, (path, sizes, conv, n_convs, n_children, leaves, saved) in live.items()]
        if out:
            yield batch(out)

    kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.binary()), pa.list_(pa.int64())]
    names = [*(x.split()[0] for x in NODE.split(", ")), "path", "sizes"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return tidy(run)


def _digests(batches):
    """SHA-256 of the ascending conv_ids of each key, joined by commas, as they stream by."""
    key, sha = None, None
    for b in batches:
        out = []
        for k, c in zip(b.column("end_key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if sha is None or k != key:
                if sha is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(str(c).encode())
            else:
                sha.update(b",%d" % c)
        if out:
            yield _ends(out)
    if sha is not None:
        yield _ends([(key, sha.hexdigest())])


def _ends(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["end_key", "ends_sha256"])


def nodes(conversations: DataFrame, deep: int = DEEP, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """A row for each distinct prefix of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations has conv_id and turns array<struct<same, bytes>>: equal turns have equal `same`, which is binary. The root
    (depth 0) holds all of them, also those without turns. An empty table gives no rows, not even the root. Conversations
    with equal turns end at one node.

    Each depth is one round: rows are added up before the shuffle, so a prefix of any share of the conversations is no
    burden to one task. A path takes TURN_BYTES for each of its turns, and is one row. Depths beyond `deep` are peeled in one task
    as far as all conversations that reach them fill up to local_bytes, and by further rounds where they fill more.
    """
    paths = materialize(conversations.select("conv_id", "turns").mapInArrow(tidy(_paths), "conv_id long, depth long, path array<binary>, sizes array<long>"), "trie-paths")
    lengths = F.when(F.col("depth") > deep, F.col("depth")).otherwise(0)
    most, below = paths.agg(F.max("depth"), F.sum(lengths * TURN_BYTES)).first()
    levels: list[DataFrame] = []
    survivors = None
    if most is None:
        most = -1
    elif most > deep and below > local_bytes:
        # the least depth from which on what is left fits one task
        reach = paths.filter(F.col("depth") > deep).groupBy("depth").agg(F.sum(F.col("depth") * TURN_BYTES).alias("bytes")).orderBy(F.desc("depth"))
        fits = 0
        for r in reach.toLocalIterator():
            if (fits := fits + r["bytes"]) > local_bytes:
                deep = r["depth"]
                break
    if most > deep:
        alone = paths.filter(F.col("depth") > deep).select("path", "sizes", "conv_id").repartition(1)
        peeled = materialize(alone.mapInArrow(_peel_all(deep), NODE + ", path array<binary>, sizes array<long>"), "trie-deep")
        levels.append(peeled.filter(F.col("path").isNull()))
        survivors = peeled.filter(F.col("path").isNotNull()).select("depth", "path", "sizes", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        most = deep
    for depth in range(most, -1, -1):
        coming = _ended(paths.filter(F.col("depth") == depth))
        level = materialize(_regrouped(coming if survivors is None else coming.unionByName(survivors), depth), "trie-level")
        levels.append(level)
        survivors = _stripped(level, depth) if depth else None
    columns = [x.split()[0] for x in NODE.split(", ")]
    every = reduce(DataFrame.unionByName, [x.select(*columns) for x in levels]) if levels else paths.sparkSession.createDataFrame([], NODE)
    every = materialize(every, "trie-nodes")
    ended = paths.select(F.coalesce(_key(F.col("depth")), F.lit(b"")).alias("end_key"), "conv_id")
    digests = ended.repartition("end_key").sortWithinPartitions("end_key", "conv_id").mapInArrow(tidy(_digests), "end_key binary, ends_sha256 string")
    # a node's digest tells its depth too, so keys are those of single nodes
    parents = every.filter("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below_ = every.filter(F.col("depth") > 0)
    root = every.filter(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = join_counted(below_, parents, "parent_key", "key").select(*columns, "parent_conv_id").unionByName(root.select(*columns, "parent_conv_id"))
    out = found.join(digests, F.col("key") == F.col("end_key"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def of_turns(turns: DataFrame) -> DataFrame:
    """The trie of a table of conv_id, turn, role, text as its conversations are; further columns are ignored."""
    return nodes(turn_lists(turns))


def of_rebuilt(turns: DataFrame) -> DataFrame:
    """The trie of a table's conversations after each is rebuilt from its base's first turns and its own later ones."""
    return nodes(rebuilt(materialize(turn_lists(turns), "trie-turns")))
