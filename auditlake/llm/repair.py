"""Conversation repair: the cheapest edits that make the roles' initials `(s?(ua)+)?`, of equal ones the ASCII-least audit.

A node is a row's place and a state of the pattern; an arc is an edit. After a DP over costs, the arcs on cheapest paths are
ranked by their next 1, 2, 4, ... letters: an arc's rank for twice as many letters is that of the pair of its rank and the
rank of the arc that its doubled pointer leads to. The least-ranked arc of the first node begins the audit, and the
pointers give each of its letters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import free_name, join_counted, materialize, shuffle_partitions, tidy

#: States of the pattern: nothing yet, after s, after u, after a. KEEP: where a kept initial (other, s, u, a) leads to, FORCED: where the role to add leads to.
START, S, U, A = range(4)
KEEP = np.array([[-1, S, U, -1], [-1, -1, U, -1], [-1, -1, -1, A], [-1, -1, U, -1]])
FORCED = np.array([U, U, A, U])
ROLE = {U: "user", A: "assistant"}
DELETE, INSERT, KEPT, REROLE = range(4)
LETTERS = np.frombuffer(b"DIKR", dtype=np.uint8)
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 3, 4, 3, 3
#: A row's fault; of several the first counts.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = np.int64(1) << 40
#: Costs from each state to the end, with nothing left but to insert.
ENDING = np.array([0, 6, 3, 0], dtype=np.int64)
ENDING_LETTERS = ["", "II", "I", ""]
#: Rows of a conversation or bytes of its texts beyond which it is cut into parts, rows of a part, rows solved together.
LONG_ROWS, LONG_BYTES, PART_ROWS, TOGETHER = 16_384, 32 << 20, 16_384, 8192
BLANKS = "\t\n\x0b\x0c\r "


def damage(turns: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text with known faults: crc32 of `conv_id:turn` modulo 20 decides; a null is one space.

    0 drops a row (its column gone is true), 1 empties its text, 2 takes the end marks out, 3 repeats it, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    new = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(text("role"))
    times = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), new.alias("text"), (kind == 0).alias("gone"), F.explode(times).alias("n")).drop("n")


def _steps(code: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Costs by way of each row edit: rows x states x (delete, insert: none here, keep, rerole). ahead: costs after the row, rows x states."""
    fault, initial = code >> 2, code & 3
    must, extra = (fault == BLANK) | (fault == DUPLICATE), np.where(fault == TRUNCATED, COST_TRUNCATED, 0)
    out = np.full((len(code), 4, 4), FAR)
    out[:, :, DELETE] = COST_DELETE + ahead
    to = KEEP[:, initial].T
    kept = np.take_along_axis(ahead, np.maximum(to, 0), 1) + extra[:, None]
    out[:, :, KEPT] = np.where((to < 0) | must[:, None], FAR, kept)
    out[:, :, REROLE] = np.where(must[:, None], FAR, COST_REROLE + extra[:, None] + ahead[:, FORCED])
    return np.minimum(out, FAR)


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs with insertions before the next row; more than three in a row never pay."""
    for _ in range(3):
        cost = np.minimum(cost, COST_INSERT + cost[..., FORCED])
    return cost


def part_matrix(code: np.ndarray) -> np.ndarray:
    """Least costs of a part from each state before it (insertions there included) to each state after its last row."""
    at = np.full((4, 4), FAR)
    np.fill_diagonal(at, 0)
    for c in code[::-1]:
        at = np.minimum(_closed(_steps(np.full(4, c), at.T).min(2)).T, FAR)
    return at


def solve(codes: list[np.ndarray], ends: np.ndarray, states: list[list[int]], last: bool) -> tuple[np.ndarray, list[list[tuple[bytes, int]]]]:
    """Costs from each state of each sequence, and (audit, state at its end) for those asked for.

    codes: fault * 4 + initial of each row. ends: costs from each state after the last row, sequences x states. With last,
    insertions may follow the last row; otherwise they belong to what comes next.
    """
    n = np.array([len(c) for c in codes], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    code = np.zeros(first[-1], dtype=np.int64)
    for c, at in zip(codes, first, strict=False):
        code[at : at + len(c)] = c
    final = first[:-1] + n
    cost = np.full((first[-1], 4), FAR)
    cost[final] = _closed(ends) if last else ends
    by_length = np.argsort(-n, kind="stable")
    lengths, k = n[by_length], len(codes)
    for i in range(int(n.max(initial=0))):  # from the ends backward, all sequences together
        while k and lengths[k - 1] <= i:
            k -= 1
        at = final[by_length[:k]] - 1 - i
        cost[at] = _closed(_steps(code[at], cost[at + 1]).min(2))

    # arcs on cheapest paths: node = place * 4 + state, arc = node * 4 + letter
    inner = np.ones(first[-1], dtype=bool)
    inner[final] = False
    rows = np.flatnonzero(inner)
    ways = np.full((first[-1], 4, 4), FAR)
    ways[rows] = _steps(code[rows], cost[rows + 1])
    if last:
        ways[final, :, INSERT] = np.where((ends <= cost[final]), FAR, COST_INSERT + cost[final][:, FORCED])
    ways[rows, :, INSERT] = COST_INSERT + cost[rows][:, FORCED]
    optimal = (ways == cost[:, :, None]) & (cost[:, :, None] < FAR)
    state = np.broadcast_to(np.arange(4), (first[-1], 4))
    to = np.stack([state, FORCED[state], KEEP[state, (code & 3)[:, None]], FORCED[state]], axis=2)
    place = np.arange(first[-1])[:, None, None] + np.array([1, 0, 1, 1])
    head = (place * 4 + to).reshape(-1)
    nodes, sink = first[-1] * 4, first[-1] * 16
    # an arc's rank by its own letter, 0 for the end; the next arc is the least-ranked one that leaves its head
    rank = np.where(optimal, np.array([1, 2, 3, 4]), 0).reshape(-1)
    least = np.where(optimal.any(2), optimal.argmax(2), -1).reshape(-1)
    begin = np.where(least >= 0, np.arange(nodes) * 4 + least, sink)
    real = np.flatnonzero(optimal.reshape(-1))
    pointer = np.full(sink + 1, sink)
    pointer[real] = begin[head[real]]
    rank, pointers = np.append(rank, 0), []
    while True:
        pointers.append(pointer)
        if (pointer[real] == sink).all():
            break
        pairs = rank[real] * (len(real) + 5) + rank[pointer[real]]
        rank = rank.copy()
        rank[real] = np.unique(pairs, return_inverse=True)[1].reshape(-1) + 1
        pointer = pointer[pointer]

    out: list[list[tuple[bytes, int]]] = []
    for s, want in enumerate(states):
        each = []
        for state_ in want:
            node = first[s] * 4 + state_
            leaving = node * 4 + np.flatnonzero(optimal.reshape(-1, 4)[node])
            if not len(leaving):
                each.append((b"", state_))
                continue
            arc = leaving[np.argmin(rank[leaving])]
            length, end = 1, arc
            for j in range(len(pointers) - 1, -1, -1):
                if pointers[j][end] != sink:
                    end, length = pointers[j][end], length + (1 << j)
            path, steps = np.full(length, arc), np.arange(length)
            for j, p in enumerate(pointers):
                jump = (steps >> j) & 1 == 1
                path[jump] = p[path[jump]]
            each.append((LETTERS[path & 3].tobytes(), int(head[end] & 3)))
        out.append(each)
    return np.where(cost[first[:-1]] >= FAR, FAR, cost[first[:-1]]), out


class Writer:
    """Applies an audit's letters to rows as they come, and hashes `role:text` lines."""

    def __init__(self):
        self.state, self.sha, self.begun = START, hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.sha.update(b"\n" * self.begun + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.begun = True

    def apply(self, letters: bytes, rows) -> None:
        """rows gives (role, text) for each letter but I."""
        for letter in letters:
            if letter == LETTERS[DELETE]:
                next(rows)
                continue
            if letter == LETTERS[INSERT]:
                self.state = int(FORCED[self.state])
                self.line(ROLE[self.state], "")
                continue
            role, text = next(rows)
            if letter == LETTERS[REROLE]:
                self.state = int(FORCED[self.state])
                role = ROLE[self.state]
            else:
                self.state = int(KEEP[self.state, initial(role)])
            self.line(role, text)


def initial(role: str) -> int:
    return {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches):
    """Conversations whose rows come sorted: each is repaired when its last row is there."""

    def out(held):
        codes, faults = [], []
        for _, rows in held:
            seen, code = set(), []
            for _, role, text, _ in rows:
                body = text.rstrip(BLANKS)
                fault = BLANK if not body else DUPLICATE if (role, text) in seen else NONE if body[-1] in ".!?" else TRUNCATED
                seen.add((role, text))
                code.append(fault * 4 + initial(role))
            codes.append(np.array(code, dtype=np.int64))
            faults.append(np.bincount(codes[-1] >> 2, minlength=4))
        ends = np.full((len(held), 4), FAR)
        ends[:, [START, A]] = 0
        cost, audits = solve(codes, ends, [[START]] * len(held), True)
        table = []
        for (key, rows), f, c, ((audit, _),) in zip(held, faults, cost, audits, strict=True):
            w = Writer()
            w.apply(audit, iter([r[1:3] for r in rows]))
            t = [r[0] for r in rows if r[0] is not None]
            gaps = max(t) - min(t) + 1 - len(set(t)) if t else 0
            illegal = sum(not _legal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False))
            table.append((key, gaps, *map(int, f[1:]), illegal, int(c[START]), audit.decode(), w.sha.hexdigest()))
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in names[-2:] else pa.int64()) for n, x in zip(names, zip(*table, strict=True), strict=True)], names)

    held, count, size = [], 0, 0
    for b in batches:
        for key, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
            if not held or held[-1][0] != key:
                if count >= TOGETHER or size >= LONG_BYTES:
                    yield out(held)
                    held, count, size = [], 0, 0
                held.append((key, []))
            if not row[3]:
                held[-1][1].append(tuple(row))
                count, size = count + 1, size + len(row[2])
    if held:
        yield out(held)


def _matrices(batches):
    for b in batches:
        cells = [part_matrix(np.array(c, dtype=np.int64)).reshape(-1).tolist() for c in b.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("part"), pa.array(cells, pa.list_(pa.int64()))], ["key", "part", "cells"])


def _ends(batches):
    """Parts from the last to the first: the costs from each state after a part to the end."""
    key, ends = None, ENDING
    for b in batches:
        out = []
        for k, cells in zip(b.column("key").to_pylist(), b.column("cells").to_pylist(), strict=True):
            if k != key:
                key, ends = k, ENDING
            out.append(ends.tolist())
            ends = np.minimum((np.array(cells).reshape(4, 4) + ends[None, :]).min(1), FAR)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("part"), pa.array(out, pa.list_(pa.int64()))], ["key", "part", "ends"])


def _pieces(batches):
    """Each part's audit from each state before it, the states after it, and the costs from each state to the end."""
    for b in batches:
        audits, states, costs = [], [], []
        for code, ends in zip(b.column("codes").to_pylist(), b.column("ends").to_pylist(), strict=True):
            cost, ((*each,),) = solve([np.array(code, dtype=np.int64)], np.array([ends], dtype=np.int64), [[START, S, U, A]], False)
            audits.append([a.decode() for a, _ in each])
            states.append([s for _, s in each])
            costs.append(cost[0].tolist())
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("part"), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int64())), pa.array(costs, pa.list_(pa.int64()))], ["key", "part", "audits", "states", "costs"])


def _chosen(batches):
    """Parts from the first to the last: the audit of the state that the part before ends in."""
    key, state = None, START
    for b in batches:
        audits, costs = [], []
        for k, a, s, c in zip(*(b.column(n).to_pylist() for n in ("key", "audits", "states", "costs")), strict=True):
            costs.append(c[START] if k != key else None)
            if k != key:
                key, state = k, START
            audits.append(a[state])
            state = s[state]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("part"), pa.array(audits, pa.string()), pa.array(costs, pa.int64())], ["key", "part", "audit", "cost"])


def _written(batches):
    """A part's audit (kind 0), then its rows: the digest and the audit of each conversation; only rows of a batch are held."""
    key, w, audit, letters, illegal, before = None, None, [], iter(b""), 0, None

    def result():
        rest = ENDING_LETTERS[w.state]
        w.apply(rest.encode(), iter(()))
        return key, "".join(audit) + rest, w.sha.hexdigest(), illegal

    for b in batches:
        done = []
        for k, kind, piece, role, text in zip(*(b.column(n).to_pylist() for n in ("key", "kind", "audit", "role", "text")), strict=True):
            if k != key:
                if w:
                    done.append(result())
                key, w, audit, illegal, before = k, Writer(), [], 0, None
            if kind == 0:
                audit.append(piece)
                letters = iter(piece.encode())
                # insertions before the first row come with the row; a part never ends with one
                continue
            illegal += before is not None and not _legal(before, role)
            before = role
            for letter in letters:
                w.apply(bytes([letter]), iter([(role, text)]))
                if letter != LETTERS[INSERT]:
                    break
        if done:
            yield _digests(done)
    if w:
        yield _digests([result()])


def _digests(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["key", "audit", "repaired_sha256", "illegal"])


def _parted(rows: DataFrame, ids: DataFrame, part_rows: int) -> DataFrame:
    """The same result for long conversations: rows are sorted by ranges, and a conversation's parts are solved apart.

    Only three numbers a part go through one task of a conversation, and, since a digest has an order, its texts as a stream.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    live = rows.filter(~F.col("gone")).select(key.alias("key"), "turn", "role", "text", F.monotonically_increasing_id().alias("own"), F.sha2(F.concat_ws("\x00", key, F.hex("role"), "text"), 256).alias("same"))
    live = materialize(live, "repair-long")
    first = live.groupBy("same").agg(F.min(F.struct("turn", "own")).alias("first"), F.count("*").alias("n"))
    live = join_counted(live, first, "same", "own").withColumn("again", F.col("first.own") != F.col("own"))
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(F.col("again"), DUPLICATE).when(F.right(body, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    start = F.left("role", F.lit(1))
    code = fault * 4 + F.when(start == "s", 1).when(start == "u", 2).when(start == "a", 3).otherwise(0)
    sorted_ = live.repartitionByRange(shuffle_partitions(spark), "key", "turn", "role", F.left("text", F.lit(32)), "own").sortWithinPartitions("key", "turn", "role", "text", "own")
    # the number rises along partitions and rows; a part is part_rows numbers of one conversation
    place = F.monotonically_increasing_id()
    rows = materialize(sorted_.select("key", "turn", "role", "text", code.cast("byte").alias("code"), place.alias("place")), "repair-sorted").withColumn("part", F.expr(f"place div {part_rows}"))
    grouped = rows.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("c"))
    parts = materialize(grouped.select("key", "part", F.col("c.code").alias("codes")), "repair-parts")
    matrices = parts.mapInArrow(tidy(_matrices), "key string, part long, cells array<long>")
    ends = materialize(matrices.repartition("key").sortWithinPartitions("key", F.desc("part")).mapInArrow(tidy(_ends), "key string, part long, ends array<long>"), "repair-ends")
    pieces = parts.join(ends, ["key", "part"]).select("key", "part", "codes", "ends").mapInArrow(tidy(_pieces), "key string, part long, audits array<string>, states array<long>, costs array<long>")
    chosen = pieces.repartition("key").sortWithinPartitions("key", "part").mapInArrow(tidy(_chosen), "key string, part long, audit string, cost long")
    chosen = materialize(chosen, "repair-audits")
    none = F.lit(None).cast("string")
    stream = chosen.select("key", "part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("place"), "audit", none.alias("role"), none.alias("text")).unionByName(
        rows.select("key", "part", F.lit(1).alias("kind"), "place", none.alias("audit"), "role", "text")
    )
    digests = stream.repartition("key").sortWithinPartitions("key", "part", "kind", "place").mapInArrow(tidy(_written), "key string, audit string, repaired_sha256 string, illegal long")
    count = lambda f: F.count_if(F.col("code").cast("int").bitwiseAND(12) == 4 * f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = rows.groupBy("key").agg(gaps.alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"))
    costs = chosen.groupBy("key").agg(F.max("cost").alias("cost"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        ids.withColumn("key", key)
        .join(counts, "key", "left")
        .join(costs, "key", "left")
        .join(digests, "key", "left")
        .select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    )


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per conv_id: faults, cost, audit and the digest of the repaired conversation.

    rows has conv_id, turn, role, text (neither null) and gone; rows that are gone only keep their conversation in the
    result. Rows are ordered by turn, nulls first, then role, then text, so ties and repeated rows have one order. Rows with
    a null conv_id are one conversation with a null id. A conversation without rows, or of deleted rows only, has an empty
    repaired text. An empty table gives no rows. Further columns are ignored.

    Conversations of up to long_rows rows and long_bytes bytes are repaired whole in one task; longer ones in parts, with
    the same result.
    """
    held = rows.select("conv_id", "turn", "role", "text", "gone")
    sizes = held.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    longer = materialize(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("conv_id"), "repair-ids")
    if longer.isEmpty():
        return _repaired(held)
    is_long = free_name(held, "is_long")
    marks = longer.select(F.col("conv_id").alias("long_id"), F.lit(True).alias(is_long))
    marked = held.join(marks, F.col("conv_id").eqNullSafe(F.col("long_id")), "left").drop("long_id")
    short = marked.filter(F.col(is_long).isNull()).drop(is_long)
    return _repaired(short).unionByName(_parted(marked.filter(is_long).drop(is_long), longer, part_rows))


def _repaired(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(tidy(_whole), RESULT)
