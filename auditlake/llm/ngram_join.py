"""Similarity join on word n-grams: rare-first prefixes with length, positional and suffix filters, then components.

The rare-first order is exact. Documents are taken in runs of some million shingles; each run's shingles go, packed, to
buckets of the hash space, where the documents that have a shingle are counted; counts of shingles of two documents or
more go back to the runs. Shingles of one document alone come first in every order and can match nothing, so they are
only counted: no posting of one is ever written, and a document with so many of them that its prefix is full can link
with nothing and drops out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import free_name, join_counted, materialize, shuffle_partitions, tidy

GRAM, PERCENT = 4, 85
#: Tables of numbers of at most so many rows (some 10 MB) are broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 500_000
SIGNATURE = 16
#: Shingles, and documents, that a task works on together.
RUN, RUN_DOCS = 1_000_000, 60_000
#: Bytes of text for each bucket of the hash space, and the least and most bits of buckets.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 32 << 20, 8, 18
#: Shingles with at least HOT_ROWS documents and 1 of HOT_SHARE of all shingles, at most HOT_SHARE in number, come last
#: in every order and are not counted, so that no bucket holds them.
HOT_ROWS, HOT_SHARE = 1_000_000, 400_000
#: After a star round, postings of different components are compared with each other if they make at most so many pairs a
#: posting, or if the round found no link; else another star round goes before, STAR_ROUNDS in all at most.
PAIRS_PER_ROW, STAR_ROUNDS = 200, 3


def shingle_set(text: str | None, gram: int):
    """Sorted distinct hashes of the lower-cased (A-Z) word n-grams of a text."""
    import numpy as np

    from auditlake.llm.shingles import gram_hashes, word_hashes

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(gram_hashes(word_hashes(words), gram))


def class_of(hashes) -> bytes:
    """128 bits for a set of hashes; texts with one set are one class."""
    import numpy as np

    from auditlake.llm.shingles import U, mix

    sums = np.array([mix(hashes + U(0x9E3779B97F4A7C15)).sum(), mix(hashes ^ U(0xD6E8FEB86659FD93)).sum()])
    return mix(sums + U(len(hashes))).tobytes()


def needed(n, percent: int):
    """Least intersection of a set of n with any set that it links with."""
    return -(-percent * n // 100)


#: Rows of the first pass: documents; and of runs, at bucket -1 the classes of their documents, their sizes, and their
#: distinct keys, ids, whether an id is null, and signatures; at bucket -2 keys that many of them have and their counts, at buckets from 0 on their keys' documents and low 32 bits.
PROFILE = "doc_id long, class binary, n int, run long, bucket int, a binary, b binary, c binary"


def _profile(gram: int, bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from auditlake.llm.shingles import U

        names = ["doc_id", "class", "n", "run", "bucket", "a", "b", "c"]
        given, sets, classes, ids, held = set(), [], [], [], 0

        def packed():
            nonlocal sets, classes, ids, held
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            key = np.concatenate(sets) >> U(32 - bits)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), size)
            one = np.ones(len(key), bool)
            one[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[one], doc[one]
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            number = uuid.uuid4().int >> 65
            signs = b"".join(np.minimum(np.bincount((h & U(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE), 65535).astype("<u2").tobytes() for h in sets)
            known = np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes()
            out = [(-1, b"".join(classes), size.astype("<u4").tobytes(), b"".join([np.bincount(doc, minlength=len(sets)).astype("<u4").tobytes(), *known, signs]))]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.concatenate([start, [len(key)]]))
            often = times >= max(8, RUN // HOT_SHARE)
            if often.any():
                out.append((-2, key[start[often]].tobytes(), times[often].astype("<u4").tobytes(), None))
            cuts = np.searchsorted(key, np.arange((1 << bits) + 1, dtype=np.uint64) << U(32)).tolist()
            low = (key & U(0xFFFFFFFF)).astype("<u4")
            for bucket, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if j > i:
                    out.append((bucket, doc[i:j].astype("<u2").tobytes(), np.diff(low[i:j], prepend=np.uint32(0)).tobytes(), None))
            sets, classes, ids, held = [], [], [], 0
            for lo in range(0, len(out), 64):
                bucket, a, b, c = zip(*out[lo : lo + 64], strict=True)
                none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.binary(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([number] * len(a), pa.int64()), pa.array(bucket, pa.int32()), *[pa.array(x, pa.binary()) for x in (a, b, c)]], names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out, part = [], batch.slice(lo, 500)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h = shingle_set(text, gram)
                    if not len(h):
                        out.append((doc, None, 0))
                        continue
                    own = class_of(h)
                    out.append((doc, own, len(h)))
                    if own not in given:
                        if len(given) > 1_000_000:
                            given.clear()
                        given.add(own)  # copies within a task are counted once
                        sets.append(h)
                        classes.append(own)
                        ids.append(doc)
                        held += len(h)
                        if held >= RUN or len(sets) >= RUN_DOCS:
                            yield from packed()
                if out:
                    doc, cls, n = zip(*out, strict=True)
                    none = [pa.nulls(len(out), t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(cls, pa.binary()), pa.array(n, pa.int32()), *none], names)
        if sets:
            yield from packed()

    return run


RUN_ROWS = "run long, bucket int, a binary, b binary, c binary"


def _run_batch(rows):
    import pyarrow as pa

    run, bucket, a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(bucket, pa.int32()), *[pa.array(x, pa.binary()) for x in (a, b, c)]], ["run", "bucket", "a", "b", "c"])


def _often(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for keys, times in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(times, "<u4").astype(np.int64))], ["key", "n"])


def _without(hot):
    """Rows of buckets without the keys of `hot`; those go to rows of their own, as if counted, with the highest count."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                doc, low = np.frombuffer(row["a"], "<u2"), np.cumsum(np.frombuffer(row["b"], "<u4"), dtype=np.uint32)
                is_hot = np.isin(low.astype(np.uint64) | (np.uint64(row["bucket"]) << np.uint64(32)), hot.value)
                out = []
                if is_hot.any():
                    out.append((row["run"], row["bucket"], doc[is_hot].tobytes(), low[is_hot].astype("<u4").tobytes(), b"\xff" * int(is_hot.sum())))
                if not is_hot.all():
                    out.append((row["run"], row["bucket"], doc[~is_hot].tobytes(), np.diff(low[~is_hot], prepend=np.uint32(0)).astype("<u4").tobytes(), None))
                yield _run_batch(out)

    return run


def _groups(batches, column: str):
    """Runs of rows with one value of a column, by which they are sorted."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[column] != key:
                yield key, rows
                rows = []
            key = row[column]
            rows.append(row)
    if rows:
        yield key, rows


def _count_keys(batches):
    """For each run and bucket: documents, low bits and counts (at most 254) of the keys that two documents or more have."""
    import numpy as np

    for bucket, rows in _groups(batches, "bucket"):
        low = np.concatenate([np.cumsum(np.frombuffer(r["b"], "<u4"), dtype=np.uint32) for r in rows])
        doc = np.concatenate([np.frombuffer(r["a"], "<u2") for r in rows])
        ends = np.cumsum([len(r["a"]) // 2 for r in rows])
        runs = [r["run"] for r in rows]
        rows.clear()
        order = np.argsort(low)
        ordered = low[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.concatenate([start, [len(ordered)]]))
        count = np.empty(len(low), np.uint8)
        count[order] = np.repeat(np.minimum(times, 254).astype(np.uint8), times)
        shared = count >= 2
        for run, i, j in zip(runs, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own = shared[i:j]
            if own.any():
                yield _run_batch([(run, bucket, doc[i:j][own].tobytes(), low[i:j][own].tobytes(), count[i:j][own].tobytes())])


def _prefixes(percent: int):
    """(class, n, alone, doc_id, signature, tokens): the shared part of each document's prefix, rarest first; `alone` shingles come before it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, rows in _groups(batches, "run"):
            first, rest = rows[0], rows[1:]
            classes = np.frombuffer(first["a"], "V16")
            n = np.frombuffer(first["b"], "<u4").astype(np.int64)
            k = len(n)
            kept = np.frombuffer(first["c"], "<u4", k).astype(np.int64)
            ids, null = np.frombuffer(first["c"], "<i8", k, 4 * k), np.frombuffer(first["c"], np.uint8, k, 12 * k).astype(bool)
            signs = np.frombuffer(first["c"], f"V{2 * SIGNATURE}", k, 13 * k)
            if not rest:
                continue
            doc = np.concatenate([np.frombuffer(r["a"], "<u2") for r in rest]).astype(np.int64)
            key = np.concatenate([np.frombuffer(r["b"], "<u4").astype(np.uint64) | (np.uint64(r["bucket"]) << np.uint64(32)) for r in rest])
            count = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in rest])
            shared = np.bincount(doc, minlength=len(n))
            alone = kept - shared
            room = np.maximum(n - needed(n, percent) + 1 - alone, 0)
            some = room[doc] > 0
            doc, key, count = doc[some], key[some], count[some]
            order = np.lexsort((key, count, doc))
            doc, key = doc[order], key[order]
            begins = np.searchsorted(doc, np.arange(len(n)))
            use = np.arange(len(doc)) - begins[doc] < room[doc]
            doc, key = doc[use], key[use]
            own = np.flatnonzero(np.bincount(doc, minlength=len(n)))
            at = np.concatenate([np.searchsorted(doc, own), [len(doc)]]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([classes[i].tobytes() for i in own], pa.binary()), pa.array(n[own].astype(np.int32)), pa.array(alone[own].astype(np.int32)), pa.array(ids[own].astype(np.int64), mask=null[own]), pa.array([signs[i].tobytes() for i in own], pa.binary()), tokens], ["class", "n", "alone", "doc_id", "signature", "tokens"])

    return run


def _sets(gram: int):
    """(class, members) of texts whose set is that of the class; a text with the id of another one is left out."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part, out = b.slice(lo, 500), []
                for number, bits, text in zip(*[part.column(c).to_pylist() for c in ("class", "bits", "text")], strict=True):
                    h = shingle_set(text, gram)
                    if class_of(h) == bits:
                        out.append((number, h.tobytes()))
                number, members = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(members, pa.binary())], ["class", "members"])

    return run


def _verify(percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(node, root) for the nodes of edges (a, b) and of `first`, an earlier result: root is the smallest node reached.

    Labels go along edges and are then looked up themselves, so they travel fast; every round's labels are written.
    Joins are of rows of two numbers with one row for each node, so adaptive execution splits those of a hub.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    if first is not None:
        old = first.filter("node <> root")
        both = both.union(old.select("node", "root")).union(old.select("root", "node"))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        moved = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = materialize(moved.join(jump, "root", "left").select("node", "old", F.least("root", "further").alias("root")), "labels")
        changed = labels.filter("old <> root").limit(1).count()
        labels = labels.select("node", "root")
        if not changed:
            return labels


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


class NgramJoin:
    """Links texts whose n-gram sets have a Jaccard similarity of at least percent / 100."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT):
        self.spark, self.gram, self.percent = docs.sparkSession, gram, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def profile(self) -> None:
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(max(int(size // BUCKET_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
        rows = materialize(self.docs.mapInArrow(tidy(_profile(self.gram, bits)), PROFILE), "ngram-profile")
        self.profiles = rows.filter("run is null").select("doc_id", "class", "n")
        self.runs = rows.filter("run is not null").select("run", "bucket", "a", "b", "c")
        #: 6 bytes of a packed shingle for about as many bytes of text
        self.parts = max(shuffle_partitions(self.spark), int(size // BUCKET_BYTES) + 1)

    def hot_keys(self):
        """Keys of so many documents that no bucket should hold them, at most HOT_SHARE in number."""
        import numpy as np

        often = self.runs.filter("bucket = -2").mapInArrow(_often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        total = self.profiles.agg(F.sum("n")).first()[0] or 0
        keys = [r.key for r in often.filter(F.col("n") >= max(HOT_ROWS, total // HOT_SHARE + 1)).select("key").collect()]
        return np.array(keys, np.int64).view(np.uint64)

    def classes_and_prefixes(self) -> None:
        """Writes (num, class, n, alone, doc_id, signature, tokens) of the classes whose prefix has a shared shingle; num numbers them."""
        rows, hot = self.runs.filter("bucket >= 0"), self.hot_keys()
        back = self.runs.filter("bucket = -1")
        if len(hot):
            rows = materialize(rows.mapInArrow(_without(self.spark.sparkContext.broadcast(hot)), RUN_ROWS), "ngram-hot")
            back, rows = back.union(rows.filter("c is not null")), rows.filter("c is null")
        counted = rows.repartition(self.parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_count_keys), RUN_ROWS)
        runs = back.union(counted).repartition(self.parts, "run").sortWithinPartitions("run", "bucket")
        found = runs.mapInArrow(tidy(_prefixes(self.percent)), "class binary, n int, alone int, doc_id long, signature binary, tokens array<long>").dropDuplicates(["class"])
        self.prefixes = materialize(found.withColumn("num", F.monotonically_increasing_id()), "ngram-prefixes")

    def shared_postings(self) -> DataFrame:
        """(token, class, size, alone, at) of tokens that two classes or more have; class is the number of a class."""
        each = self.prefixes.select(F.col("num").alias("class"), F.col("n").alias("size"), "alone", F.posexplode("tokens").alias("i", "token"))
        rows = each.select("token", "class", "size", "alone", (F.col("alone") + F.col("i")).alias("at"))
        tokens = materialize(rows.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "ngram-tokens")
        return materialize(join_counted(rows, tokens, "token", "class").drop("n"), "ngram-shared")

    def _may_link(self) -> str:
        """Length and positional filters of two postings of a token, and the shorter index prefix of the smaller set.

        What two sets share is at most what both have of shared shingles before the token, and what follows in both.
        """
        p = self.percent
        index = lambda size: f"{size} - cast(ceil({2 * p} * cast({size} as double) / {100 + p} - 1e-9) as int) + 1"
        return f"""root <> root2 and 100L * least(size, size2) >= {p}L * greatest(size, size2)
            and {100 + p}L * (least(at - alone, at2 - alone2) + least(size - at, size2 - at2)) >= {p}L * (size + size2)
            and if(size < size2 or (size = size2 and class < class2), at < {index("size")}, at2 < {index("size2")})"""

    def candidates(self, left: DataFrame, tested: DataFrame | None, star: int | None) -> DataFrame:
        """Pairs a < b of different roots that pass the filters; of a star round, each with its token's pivot only.

        The first pivot is the class with the fewest rarer shingles before the token: of a text and its edited copies
        that is mostly the text itself, since edits make rare shingles.
        """
        columns = ("class", "size", "alone", "at", "root")
        if star is not None:
            order = F.xxhash64("class", F.lit(star)) if star else F.col("at").cast("long")
            pivot = left.groupBy("token").agg(F.min(F.struct(order.alias("o"), *columns)).alias("p"), F.count("*").alias("n"))
            pairs = join_counted(left, materialize(pivot, "ngram-pivots"), "token", "class").select(*columns, *[F.col(f"p.{c}").alias(f"{c}2") for c in columns]).filter(self._may_link())
        else:
            right = left.select("token", *[F.col(c).alias(f"{c}2") for c in columns])
            pairs = left.join(right, "token").filter(f"class < class2 and {self._may_link()}")
        p = self.percent
        sides = [(F.when(F.col("class") < F.col("class2"), F.col(x)).otherwise(F.col(y))).alias(z) for x, y, z in (("class", "class2", "a"), ("class2", "class", "b"), ("size", "size2", "na"), ("size2", "size", "nb"), ("at", "at2", "pa"), ("at2", "at", "pb"))]
        pairs = pairs.select(*sides).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("same"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        need = f"({p}L * (na + nb))"
        if star is None:
            # positional filter: what both have up to their last common prefix token, and at most all that follows it
            pairs = pairs.filter(f"{100 + p}L * (same + least(na - pa, nb - pb) - 1) >= {need}")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        # suffix filter: no more in common than in each part of the hash space by itself
        sig = self.classes.select("class", "signature")
        pairs = pairs.join(sig.select(F.col("class").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("class").alias("b"), F.col("signature").alias("sb")), "b")
        part = lambda s, i: F.conv(F.hex(F.substring(F.col(s), 2 * i + 2, 1)), 16, 10).cast("int") * 256 + F.conv(F.hex(F.substring(F.col(s), 2 * i + 1, 1)), 16, 10).cast("int")
        common = sum((F.least(part("sa", i), part("sb", i)) for i in range(SIGNATURE)), F.lit(0))
        # a part of 65535 or more is cut there, so such pairs are not judged by it
        large = (F.col("na") >= 65535) | (F.col("nb") >= 65535)
        return materialize(pairs.filter(large | (F.lit(100 + p) * common.cast("long") >= F.expr(need))).select("a", "b"), "ngram-pairs")

    def needed_sets(self, postings: DataFrame) -> DataFrame:
        """(class, members): the whole sets of the classes with a shared posting, from one text of each."""
        numbers = postings.select("class").distinct()
        known = self.prefixes.select(F.col("num").alias("class"), F.col("class").alias("bits"), F.col("doc_id").alias("needed")).join(numbers, "class", "left_semi")
        known = _small(materialize(known, "ngram-needed"))
        texts = self.docs.join(known, F.col("doc_id").eqNullSafe(F.col("needed"))).select("class", "bits", "text")
        return materialize(texts.mapInArrow(tidy(_sets(self.gram)), "class long, members binary").dropDuplicates(["class"]), "ngram-sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose sets are similar enough: each pair is compared once, on its whole sets; hot classes are dealt out."""
        total = pairs.count()
        if not total:
            return pairs
        both = pairs
        for key, other, name in (("a", "b", "set_a"), ("b", "a", "set_b")):
            degrees = pairs.groupBy(key).agg(F.count("*").alias("n"))
            members = degrees.join(self.sets.select(F.col("class").alias(key), F.col("members").alias(name)), key)
            both = join_counted(both, members, key, other, total=total, heavy=degrees).drop("n")
        return materialize(both.mapInArrow(tidy(_verify(self.percent)), "a long, b long"), "ngram-links")

    def roots(self) -> DataFrame:
        """(node, root) of the classes that link with another class.

        Star rounds first: each class is compared with one pivot for each of its shared tokens, so that a large group of
        near copies is joined by about as many comparisons as it has members. Pairs within one component need no
        comparison any more; all other pairs that share a prefix token are compared in the end, so none is lost.
        """
        self.classes_and_prefixes()
        left = self.shared_postings()
        self.classes = self.prefixes.select(F.col("num").alias("class"), "signature")
        self.sets = self.needed_sets(left)
        left, labels, tested, star, last = left.withColumn("root", F.col("class")), None, None, 0, False
        while True:
            if star:  # in the first round all tokens are open
                by_token = left.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
                by_token = materialize(by_token.select("token", "n"), "ngram-open")
                rows, square = by_token.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
                if not rows:
                    break
                left = materialize(join_counted(left, by_token, "token", "class", total=rows).drop("n"), "ngram-open-rows")
                same = left.groupBy("token", "root").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
                last = last or (square - same) / 2 <= PAIRS_PER_ROW * rows or star >= STAR_ROUNDS
            pairs = self.candidates(left, tested, None if last else star)
            tested = pairs if tested is None else tested.union(pairs)
            links = self.verified(pairs)
            found = links.limit(1).count()
            if found:
                labels = components(links, labels)
            if last:
                break
            if found:
                known = _small(labels.filter("node <> root").select(F.col("node").alias("class"), F.col("root").alias("moved")))
                left = left.withColumnRenamed("root", "old").join(known, "class", "left").withColumn("root", F.coalesce("moved", "class")).drop("old", "moved")
            star, last = star + 1, not found
        return labels if labels is not None else self.spark.createDataFrame([], "node long, root long")

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), one row per input row.

        component_id is the smallest doc_id reached by links, the document's own included. A text without words, or a
        null one, has no shingles and links with nothing; a text of fewer words than n is one shingle. Rows that repeat
        an id are texts of their own; null ids link like others but are no component's id. An empty table gives no rows;
        further columns are not read. Sets are of 64-bit hashes of their n-grams, and told apart by 128 bits.
        """
        self.profile()
        linked = self.roots().join(self.prefixes.select(F.col("num").alias("node"), "class"), "node").select("class", "root")
        classes = self.profiles.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("own"), F.count("*").alias("n"))
        classes = materialize(classes.join(linked, "class", "left").filter("n > 1 or root is not null"), "ngram-linked")
        roots = materialize(classes.filter("root is not null").groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("n")), "ngram-components")
        least = join_counted(classes.withColumnRenamed("n", "docs"), roots, "root", "class", "left").select("class", F.coalesce("least", "own").alias("least"), F.col("docs").alias("n"))
        rows = join_counted(self.profiles.withColumnRenamed("n", "size"), materialize(least, "ngram-least"), "class", "doc_id", "left")
        return rows.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def link(docs: DataFrame, **options) -> DataFrame:
    return NgramJoin(docs, **options).result()


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with the document of the smallest id of each component, and all of docs' columns.

    Rows with a null id stay, and so do repeated rows of an id that stays. Null, empty and wordless texts link with
    nothing and stay; long texts are read whole; an empty table gives no rows. Any other column names may be there.
    """
    copy = free_name(docs, "copy")
    drop = link(docs, id_col=id_col, **options).filter("component_id <> doc_id").select(F.col("doc_id").alias(copy)).distinct()
    drop = _small(materialize(drop, "ngram-copies"))
    return docs.join(drop, docs[id_col] == F.col(copy), "left_anti")
