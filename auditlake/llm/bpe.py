"""Byte-level BPE by corpus-level merge replay, and its decoding."""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, shuffle_partitions, tidy
from auditlake.llm.pieces import batches_of, encode_texts, packed, split_pieces, untouched, without_marks

#: Words with at least one of so many occurrences are in the corpus's dictionary, so it has at most so many words.
SHARE = 500_000
#: Bytes of words whose merges are replayed together.
REPLAY_BYTES = 1 << 18
#: Bytes of text that a task works on together.
BATCH_BYTES = 6 << 20


class MergeReplay:
    """Applies every merge in rank order to many words at once.

    An inverted index leads from the rank of a token pair to the positions of the words where that pair stands.
    The pair of lowest rank is taken next; each of its positions is merged and only the pairs of the touched
    neighbours are looked up again. Of one word, the leftmost position goes first and the others wait, since the
    merge may have made a pair of lower rank. Ranks are those of the joined bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        import numpy as np

        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs: dict[int, int] = {}

    def pair(self, a: int, b: int) -> int:
        """Rank of the merge of two tokens, -1 if there is none."""
        key = a << 20 | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 150_000:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def encode(self, words: list[bytes]) -> list[list[int]]:
        ids, at = self.encode_flat(words)
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_some(self, words: list[bytes], most: int = REPLAY_BYTES):
        """encode_flat() of runs of words with about `most` bytes, so that its lists stay small; one long word may have more."""
        import numpy as np

        part = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
        ids, sizes = [np.zeros(0, "<i4")], [np.zeros(1, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                some, at = self.encode_flat(words[a:b])
                ids.append(some)
                sizes.append(np.diff(at))
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def encode_flat(self, words: list[bytes]):
        """The ids of all words one after another, and the places where those of each word begin and end."""
        import numpy as np

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text, ends, full = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes), sizes > 0
        n, last, of_word = len(text), ends[full] - 1, np.repeat(np.arange(len(words)), sizes)
        ranks, follows, precedes = np.full(n, -1), np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks[:-1] = self.of_bytes[text[:-1], text[1:]]
        ranks[last] = follows[last] = precedes[(ends - sizes)[full]] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.count_nonzero(ranks < 0) :]
        keys, at = np.unique(ranks[order], return_index=True)
        index: dict[int, list[int]] = {k: part.tolist() for k, part in zip(keys.tolist(), np.split(order, at[1:]), strict=False)}
        token, rank, word, after, before = (x.tolist() for x in (self.byte[text], ranks, of_word, follows, precedes))
        heap, known, pair = list(index), self.pairs.get, self.pair
        heapify(heap)

        def put(p: int, r: int) -> None:
            rank[p] = r
            if r >= 0:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heappush(heap, r)

        while heap:
            r = heappop(heap)
            done, wait, high = -1, [], r << 20
            for p in sorted(index.pop(r)):
                if rank[p] != r:
                    continue
                if word[p] == done:
                    wait.append(p)
                    continue
                done = word[p]
                gone = after[p]
                right, left = after[gone], before[p]
                token[p], after[p], rank[gone], token[gone] = r, right, -1, -1
                if right >= 0:
                    before[right] = p
                    x = known(high | token[right])
                    put(p, pair(r, token[right]) if x is None else x)
                else:
                    rank[p] = -1
                if left >= 0:
                    x = known(token[left] << 20 | r)
                    put(left, pair(token[left], r) if x is None else x)
            for p in wait:
                put(p, rank[p])
        tokens = np.array(token, "<i4")
        left = tokens >= 0
        return tokens[left], np.concatenate([[0], np.cumsum(np.bincount(of_word[left], minlength=len(words)))])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_tools: dict[tuple[str, str], tuple] = {}


def tools(vocabulary: str, pattern: str):
    """The merge replay of one rank file, and encode() of strings by it; one per Python worker."""
    if (vocabulary, pattern) not in _tools:
        import numpy as np
        import regex

        replay, find = MergeReplay(load_ranks(vocabulary)), regex.compile(pattern).findall

        def encode(texts: list[str]):
            matches = [find(t) for t in texts]
            words = list({w for ms in matches for w in ms})
            number = {w: i for i, w in enumerate(words)}
            ids, at = replay.encode_some([w.encode("utf-8", "surrogatepass") for w in words])
            counts = np.fromiter(map(len, matches), np.int64, len(matches))
            used = np.fromiter((number[m] for ms in matches for m in ms), np.int64, int(counts.sum()))
            sizes = np.diff(at)[used]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = ids[np.repeat(at[used] - ends[:-1], sizes) + np.arange(ends[-1])]
            return flat, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

        _tools[vocabulary, pattern] = replay, encode
    return _tools[vocabulary, pattern]


def encode(texts: list[str], vocabulary: str, pattern: str) -> list[list[int]]:
    import pyarrow as pa

    ids, at = encode_texts(pa.array(texts, pa.string()), tools(vocabulary, pattern)[1])
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def decode(ids: list[int], vocabulary: str, pattern: str) -> bytes:
    tokens = tools(vocabulary, pattern)[0].tokens
    return b"".join([tokens[i] for i in ids])


def _count_pieces(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for some in batches_of(batch, 0, BATCH_BYTES):
            at, number, distinct = split_pieces(some.column(0))
            later = np.ones(len(number), bool)
            later[at[:-1]] = False
            counts = np.bincount(number[later], minlength=len(distinct))
            use = untouched(distinct) & (counts > 0)
            words, _ = without_marks(distinct.filter(pa.array(use)))
            coded = words.dictionary_encode()
            sums = np.bincount(coded.indices.to_numpy(zero_copy_only=False), counts[use], len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(sums)], ["word", "n"])


def common_words(texts: DataFrame, vocabulary: str, pattern: str, share: int = SHARE) -> DataFrame:
    """(word, ids): the merges of all words with at least 1 of `share` of the corpus's occurrences, at most `share` rows.

    Words are counted over the whole corpus by a shuffle, and each is replayed once, in shards of words. ids are those
    of the word with a space before it, as little-endian 32-bit integers.
    """
    counts = materialize(texts.mapInArrow(tidy(_count_pieces), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    total = counts.agg(F.sum("n")).first()[0] or 0

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                ids = packed(*tools(vocabulary, pattern)[1]([" " + w for w in b.column(0).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), ids.cast(pa.binary())], ["word", "ids"])

    often = counts.filter(F.col("n") >= max(2, -(-total // share))).select("word").repartition(shuffle_partitions(texts.sparkSession))
    return materialize(often.mapInArrow(tidy(run), "word string, ids binary"), "bpe-dictionary")


def _encoded(texts: DataFrame, vocabulary: str, pattern: str):
    """A function of a text array to its ids, for tasks: common words come from the corpus's dictionary, which is broadcast."""
    table = common_words(texts, vocabulary, pattern).toArrow().combine_chunks()  # at most SHARE rows, whatever the input
    held = texts.sparkSession.sparkContext.broadcast((table.column("word").combine_chunks() if table.num_rows else None, table.column("ids").combine_chunks() if table.num_rows else None))

    def run(column):
        import pyarrow as pa

        words, ids = held.value
        known = None if words is None else (words, ids.cast(pa.large_binary()))
        return encode_texts(column, tools(vocabulary, pattern)[1], known)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, one row per input row.

    Words with a notable share of the corpus are replayed once for all; a task replays the merges of the other words of
    some 24 MB of its rows at a time. A text longer than that is encoded by itself, whole. Null and empty texts have no
    ids; null and repeated ids are kept; an empty table gives no rows; further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = _encoded(rows.select("text"), vocabulary, pattern)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in batches_of(batch, 1, BATCH_BYTES):
                ids, at = encoded(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(at.astype("int32")), pa.array(ids))], ["doc_id", "ids"])

    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each text, decode its ids, and digest both.

    Edge cases are those of encode_documents(); a text without ids has the digests of nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = _encoded(rows.select("text"), vocabulary, pattern)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        replay = tools(vocabulary, pattern)[0]
        decimals, tokens = (pa.array(x, pa.large_binary()) for x in ([b"%d " % i for i in range(len(replay.tokens))], replay.tokens))

        def digests(values, ids, at, cut):
            taken = values.take(pa.array(ids))
            bounds, data = np.frombuffer(taken.buffers()[1], np.int64), memoryview(taken.buffers()[2] or b"")
            ends = bounds[at].tolist()
            return [hashlib.sha256(data[a : max(a, b - cut)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]

        for batch in batches:
            for some in batches_of(batch, 1, BATCH_BYTES):
                ids, at = encoded(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(at)), pa.array(digests(decimals, ids, at, 1)), pa.array(digests(tokens, ids, at, 0))], names)

    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
