"""Byte-level tokenizers split the space-separated pieces of a text independently; this encodes each piece of a batch once.

A piece is what stands between two single spaces. With the space before it, it is split alone as it is in its text,
unless blanks touch blanks there; a text where that happens is encoded whole. Marks at the end of a piece that come
after a letter are split from it, so they are encoded by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together; one long text may have more.
BATCH_BYTES = 24 << 20
#: Marks that never belong to a word before them.
MARKS = ".,;:!?*#%&$|)"
#: encode(strings) -> the ids of all of them one after another, and how many each has.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def batches_of(batch: pa.RecordBatch, text_at: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def split_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's pieces begin (and the end), the number of each piece, and the distinct pieces."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = lists.flatten().dictionary_encode()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return at, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def packed(ids: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Ids as little-endian bytes, one value for each of sizes."""
    at = 4 * np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids, "<i4"))])


def _bounds(a: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]


def untouched(pieces: pa.Array) -> np.ndarray:
    """Whether each piece is split by itself after a space: it has no blank at its ends."""
    return pc.and_(pc.equal(pc.utf8_trim_whitespace(pieces), pieces), pc.not_equal(pieces, "")).to_numpy(zero_copy_only=False)


def without_marks(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each piece as a word and the marks after it, which are empty where the word does not end with a letter."""
    word = pc.utf8_rtrim(pieces, characters=MARKS)
    cut = pc.and_(pc.not_equal(word, pieces), pc.utf8_is_alpha(pc.utf8_slice_codeunits(word, start=-1)))
    mark = pc.struct_field(pc.extract_regex(pieces, f"(?P<m>[{MARKS}]*)$"), "m")
    return pc.if_else(cut, word, pieces), pc.if_else(cut, mark, "")


#: Words that a worker keeps from batch to batch, and bytes of the longest.
MOST_RECENT, LONGEST_RECENT = 400_000, 64


class Recent:
    """Words of the last batches and their raw ids, the latest first; a text's ids don't depend on what is kept."""

    def __init__(self, most: int = MOST_RECENT):
        self.most, self.pair = most, None

    def keep(self, words: pa.Array, raw: pa.LargeBinaryArray) -> None:
        short = pc.less_equal(pc.binary_length(words), LONGEST_RECENT)
        words, raw = words.filter(short), raw.filter(short)
        if self.pair is not None and len(words) < self.most:
            older = pc.invert(pc.is_in(self.pair[0], value_set=words))
            words, raw = pa.concat_arrays([words, self.pair[0].filter(older)]), pa.concat_arrays([raw, self.pair[1].filter(older)])
        first = pa.array(np.arange(min(self.most, len(words))))
        self.pair = words.take(first), raw.take(first)


def encode_pieces(pieces: pa.Array, encode: Encode, known: tuple[pa.Array, pa.Array] | Recent | None) -> pa.LargeBinaryArray:
    """Raw ids of each piece with a space before it; known has words and their raw ids, or keeps those of the last batches."""
    recent = known if isinstance(known, Recent) else None
    known = recent.pair if recent else known
    word, mark = (x.dictionary_encode() for x in without_marks(pieces))
    words, marks = word.dictionary, mark.dictionary
    parts, place = [], np.zeros(len(words), np.int64)
    new = np.ones(len(words), bool)
    if known is not None:
        found = pc.index_in(words, value_set=known[0])
        new = pc.is_null(found).to_numpy(zero_copy_only=False)
        place = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts.append(known[1])
    at = sum(map(len, parts))
    place[new] = at + np.arange(new.sum())
    parts.append(packed(*encode([" " + w for w in words.filter(pa.array(new)).to_pylist()])))
    if recent and len(words):
        recent.keep(words, pa.concat_arrays(parts).take(pa.array(place)))
    at = sum(map(len, parts))
    parts.append(packed(*encode(marks.to_pylist())))
    both = np.empty(2 * len(pieces), np.int64)
    both[::2] = place[word.indices.to_numpy(zero_copy_only=False)]
    both[1::2] = at + mark.indices.to_numpy(zero_copy_only=False)
    made = pa.concat_arrays(parts).take(pa.array(both))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(np.ascontiguousarray(_bounds(made)[::2])), made.buffers()[2]])


def encode_texts(texts: pa.Array, encode: Encode, known: tuple[pa.Array, pa.Array] | Recent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and where those of each begin (and the end). Null texts are empty."""
    if not len(texts):
        return np.zeros(0, "<i4"), np.zeros(1, np.int64)
    at, number, distinct = split_pieces(texts)
    first = at[:-1]
    later = np.ones(len(number), bool)
    later[first] = False
    used = np.zeros(len(distinct), bool)
    used[number[later]] = True
    good = untouched(distinct)
    wanted = used & good
    place = np.zeros(len(distinct), np.int64)
    place[wanted] = np.arange(wanted.sum())
    raw = [encode_pieces(distinct.filter(pa.array(wanted)), encode, known)]
    entry = place[number]
    # the first piece has no space before it
    heads = np.unique(number[first])
    place[heads] = len(raw[0]) + np.arange(len(heads))
    entry[first] = place[number[first]]
    names = distinct.take(pa.array(heads)).to_pylist()
    raw.append(packed(*encode(names)))
    open_end = np.zeros(len(distinct), bool)
    open_end[heads] = [h[-1:].isspace() for h in names]
    # texts where blanks touch blanks are encoded whole
    broken = later & ~good[number]
    broken[first] = open_end[number[first]]
    whole = np.flatnonzero(np.logical_or.reduceat(broken, first))
    if len(whole):
        keep = np.ones(len(number), bool)
        for i in whole.tolist():
            keep[at[i] + 1 : at[i + 1]] = False
        entry[at[whole]] = sum(map(len, raw)) + np.arange(len(whole))
        raw.append(packed(*encode(texts.take(pa.array(whole)).to_pylist())))
        at, entry = np.concatenate([[0], np.cumsum(keep)])[at], entry[keep]
    made = pa.concat_arrays(raw).take(pa.array(entry))
    bounds = _bounds(made)
    data = made.buffers()[2]
    ids = np.frombuffer(data, "<i4")[: bounds[-1] // 4] if data is not None and len(data) else np.zeros(0, "<i4")
    return ids, bounds[at] // 4
