"""Repeated-phrase automata: recurring passages are located by Aho-Corasick automata and removed from later documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import free_name, join_counted, materialize, py_words, shuffle_partitions, tidy

WINDOW = 50
#: Words of the phrases that stand for a passage; every window has the smallest hash of its phrases in common with its copies.
PHRASE = 8
#: Side tables of at most so many numbers (16 MB) are broadcast; larger ones are joined by a shuffle of the texts.
SMALL_NUMBERS = 2_000_000
#: Phrases of one automaton, about; and the least documents of one that are dealt to several parts.
SHARD, LEAST_PART = 10_000, 200


def _phrases(window: int, phrase: int):
    """Each text's words counted, 128 bits of its word sequence, and the phrases that its windows select."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from auditlake.llm.shingles import BASES, gram_hashes, minimizers, window_hashes, word_hashes

        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                count, whole, found = [], [], []
                for text in part.column("text").to_pylist():
                    w = word_hashes(py_words(text))
                    n = len(w)
                    count.append(n)
                    if n < window:
                        whole.append(None)
                        found.append(np.zeros(0, np.int64))
                        continue
                    whole.append(window_hashes(w, n, BASES[0]).tobytes() + window_hashes(w, n, BASES[1]).tobytes())
                    grams = gram_hashes(w, phrase)
                    found.append(np.unique(grams[minimizers(grams, window - phrase + 1)]).view(np.int64))
                at = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found) if found else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fp"), pa.array(count, pa.int64()), pa.array(whole, pa.binary()), lists], ["doc_id", "fp", "n_words", "whole", "phrases"])

    return run


def _phrase_texts(phrase: int):
    """(shard, phrase): the words of the phrases that a document is the first to have."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from auditlake.llm.shingles import gram_hashes, word_hashes

        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part, shard, out = b.slice(lo, 200), [], []
                for own, text, firsts in zip(part.column("own").to_pylist(), part.column("text").to_pylist(), part.column("firsts").to_pylist(), strict=True):
                    if firsts:
                        words = py_words(text)
                        found = np.flatnonzero(np.isin(gram_hashes(word_hashes(words), phrase).view(np.int64), np.array(firsts, np.int64)))
                        texts = {b" ".join(words[p : p + phrase]) for p in found.tolist()}
                        shard += [own] * len(texts)
                        out += texts
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(out, pa.binary())], ["shard", "phrase"])

    return run


def automaton_of(phrases: list[str]):
    """An Aho-Corasick automaton of phrases of whole words, with the length of each."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        made.add_word(f" {p} ")
    made.make_automaton()
    return made


def locate(automaton, words: list[str]):
    """Numbers of the words where a phrase of the automaton begins."""
    import numpy as np

    hits = [end - size + 1 for end, size in automaton.iter(f" {' '.join(words)} ")]
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])  # of the blank before each word
    return np.searchsorted(starts, np.unique(np.array(hits, np.int64)))


def _windows(window: int, phrase: int):
    """Documents streamed through their shard's automaton: the windows around its hits, by their two hashes and starts.

    Rows come sorted by shard and part, the shard's phrases before its documents.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from auditlake.llm.shingles import BASES, window_hashes, word_hashes

        shard, phrases, automaton = None, [], None
        for b in batches:
            for lo in range(0, b.num_rows, 400):
                part = b.slice(lo, 400)
                doc, fp, starts, one, two = [], [], [], [], []
                for key, p, i, f, text in zip(zip(part.column("shard").to_pylist(), part.column("part").to_pylist(), strict=True), *[part.column(c).to_pylist() for c in ("phrase", "doc_id", "fp", "text")], strict=True):
                    if key != shard:
                        shard, phrases, automaton = key, [], None
                    if p is not None:
                        phrases.append(p.decode("utf-8", "surrogatepass"))
                        continue
                    if not phrases:
                        continue
                    automaton = automaton or automaton_of(phrases)
                    words = py_words(text)
                    at = locate(automaton, [w.decode("utf-8", "surrogatepass") for w in words])
                    n = len(words) - window + 1
                    edges = np.zeros(max(n, 0) + 1, np.int64)
                    if n > 0 and len(at):
                        np.add.at(edges, np.clip(at + phrase - window, 0, n), 1)
                        np.add.at(edges, np.clip(at + 1, 0, n), -1)
                    s = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                    if len(s):
                        h = word_hashes(words)
                        doc.append(i)
                        fp.append(f)
                        starts.append(s.astype(np.int32))
                        one.append(window_hashes(h, window, BASES[0])[s].view(np.int64))
                        two.append(window_hashes(h, window, BASES[1])[s].view(np.int64))
                if doc:
                    at = pa.array(np.cumsum([0, *map(len, starts)]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (starts, one, two)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(fp, pa.int64()), *lists], ["doc_id", "fp", "starts", "h1", "h2"])

    return run


def _ranges(window: int):
    """Sorted window starts as ranges of words: begins and ends."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            begins, ends = [], []
            for s in b.column("starts").to_pylist():
                s = np.sort(np.array(s, np.int64))
                gap = np.flatnonzero(np.diff(s) > window)
                begins.append(s[np.concatenate([[0], gap + 1])].tolist())
                ends.append((s[np.concatenate([gap, [len(s) - 1]])] + window).tolist())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), pa.array(begins, kind), pa.array(ends, kind)], ["doc_id", "fp", "begins", "ends"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("fp"), F.col(text_col).alias("text"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, fp, begins, ends): ranges of words covered by windows that also start in a document with a smaller id.

    fp is the hash of the text, so rows that repeat an id with another text are kept apart. Texts without such words,
    and rows with a null id, have no row.
    """
    rows = _keyed(docs, id_col, text_col).filter("doc_id is not null")
    profile = materialize(rows.mapInArrow(tidy(_phrases(window, phrase)), "doc_id long, fp long, n_words long, whole binary, phrases array<long>"), "phrases")
    # whole copies: all windows of a text start in its first copy too
    copies = profile.filter("whole is not null").groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = materialize(copies, "whole-copies")
    tagged = join_counted(profile.filter("whole is not null"), copies, "whole", "doc_id", "left")
    tagged = materialize(tagged.select("doc_id", "fp", "n_words", "phrases", (F.col("first") < F.col("doc_id")).alias("copy")), "phrases-tagged")
    copied = tagged.filter("copy").select("doc_id", "fp", F.array(F.lit(0)).alias("begins"), F.array(F.col("n_words").cast("int")).alias("ends"))
    first = tagged.filter("copy is null or not copy")
    # phrases of two documents or more; those that one document is the first to have are in one automaton
    each = first.select("doc_id", "fp", F.explode("phrases").alias("phrase"))
    recurring = each.groupBy("phrase").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("phrase", "n", "lo")
    recurring = materialize(recurring, "recurring-phrases")
    shards = recurring.count() // SHARD + 1
    wanted = join_counted(each, recurring, "phrase", "doc_id").withColumn("shard", F.pmod(F.xxhash64("lo"), F.lit(shards)).cast("int"))
    wanted = wanted.groupBy("doc_id", "fp").agg(F.collect_set("shard").alias("shards"), F.collect_list(F.when(F.col("lo") == F.col("doc_id"), F.col("phrase"))).alias("firsts"))
    wanted = materialize(wanted, "wanted-phrases")
    numbers = wanted.agg(F.sum(F.size("firsts") + F.size("shards") + 2)).first()[0] or 0
    texts = rows.join(F.broadcast(wanted) if numbers <= SMALL_NUMBERS else wanted, ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"])
    texts = materialize(texts.select("doc_id", "fp", "text", "shards", "firsts"), "phrase-documents")
    # the automata, and the documents that stream through them
    own = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("own")
    phrases = texts.filter(F.size("firsts") > 0).select(own, "text", "firsts").mapInArrow(tidy(_phrase_texts(phrase)), "shard int, phrase binary").distinct()
    streams = texts.select("doc_id", "fp", "text", F.explode("shards").alias("shard"))
    met = streams.groupBy("shard").agg(F.count("*").alias("n"))
    total = met.agg(F.sum("n")).first()[0] or 0
    parts = materialize(met.select("shard", F.ceil(F.col("n") / max(LEAST_PART, total // 100)).cast("int").alias("parts")), "phrase-parts")
    streams = streams.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "fp"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("binary").alias("phrase"), "doc_id", "fp", "text")
    phrases = phrases.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "phrase", *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("fp", "long"), ("text", "string"))])
    n = max(shuffle_partitions(docs.sparkSession), shards)
    dealt = phrases.unionByName(streams).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", F.col("phrase").isNull())
    lists = materialize(dealt.mapInArrow(tidy(_windows(window, phrase)), "doc_id long, fp long, starts array<int>, h1 array<long>, h2 array<long>"), "windows")
    # confirm: whole windows, by 128 bits of hash
    each = lists.select("doc_id", "fp", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select("doc_id", "fp", "w.*")
    first = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("first < hi")
    first = materialize(first.select("h1", F.col("h2").alias("check"), "first", "n"), "recurring-windows")
    found = join_counted(each, first, "h1", "doc_id").filter("h2 = check and first < doc_id")
    starts = found.groupBy("doc_id", "fp").agg(F.collect_list("starts").alias("starts"))
    ranges = starts.mapInArrow(_ranges(window), "doc_id long, fp long, begins array<int>, ends array<int>")
    return materialize(ranges.unionByName(copied.dropDuplicates(["doc_id", "fp"])), "repeated-ranges")


def with_ranges(docs: DataFrame, id_col: str, text_col: str, window: int, phrase: int) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: where repeated ranges begin and end, null where nothing repeats."""
    i, f, begins, ends = (free_name(docs, c) for c in ("range_id", "range_fp", "range_begins", "range_ends"))
    ranges = repeated_ranges(docs, id_col, text_col, window, phrase)
    numbers = ranges.agg(F.sum(2 * F.size("begins") + 2)).first()[0] or 0
    ranges = ranges.select(F.col("doc_id").alias(i), F.col("fp").alias(f), F.col("begins").alias(begins), F.col("ends").alias(ends))
    same = (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(F.coalesce(text_col, F.lit(""))) == F.col(f))
    return docs.join(F.broadcast(ranges) if numbers <= SMALL_NUMBERS else ranges, same, "left").drop(i, f), begins, ends


def kept_words(words: list[bytes], begins, ends) -> list[bytes]:
    if not begins:
        return words
    kept, at = [], 0
    for a, b in zip(begins, ends, strict=True):
        kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row.

    Windows are judged on the input. Null and empty texts have no words. A document never loses words to itself, to a
    row of its own id, or to a row with a null id; rows with a null id lose none. Repeated rows give equal rows. An
    empty table gives no rows; further columns are not read.
    """
    rows, begins_at, ends_at = with_ranges(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", window, phrase)

    def run(batches):
        import pyarrow as pa

        for b in (part.slice(lo, 500) for part in batches for lo in range(0, part.num_rows, 500)):
            out = []
            for doc, text, begins, ends in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", begins_at, ends_at)], strict=True):
                words = py_words(text)
                kept = kept_words(words, begins, ends)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", begins_at, ends_at).mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """docs with the repeated words taken out of text_col; texts that lose words have the others joined by one space.

    All rows and columns stay, whatever the columns' names. Texts that lose nothing, null and empty ones too, stay as
    they are; a text whose words all go is empty. Rows with a null id lose nothing, repeated rows lose alike, very long
    texts are read whole, and an empty table gives no rows.
    """
    rows, begins_at, ends_at = with_ranges(docs, id_col, text_col, window, phrase)
    columns = docs.columns
    at = columns.index(text_col)
    order = [*range(len(columns)), rows.columns.index(begins_at), rows.columns.index(ends_at)]

    def run(batches):
        import pyarrow as pa

        for b in (part.slice(lo, 500) for part in batches for lo in range(0, part.num_rows, 500)):
            texts = []
            for text, begins, ends in zip(*[b.column(i).to_pylist() for i in (at, order[-2], order[-1])], strict=True):
                texts.append(b" ".join(kept_words(py_words(text), begins, ends)).decode("utf-8", "surrogatepass") if begins else text)
            own = [b.column(i) for i in range(len(columns))]
            own[at] = pa.array(texts, own[at].type)
            yield pa.RecordBatch.from_arrays(own, columns)

    return rows.mapInArrow(tidy(run), docs.schema)
