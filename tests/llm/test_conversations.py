"""Conversation repair and prefix trie against brute force: given and random turns, long conversations in parts, edge rows."""

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest

from auditlake.llm import common, repair, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, n long, gone string, key string, part int"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def cheapest(faults, initials):
    """(cost, audit, [(letter, role)]) of the definition: all edits tried from the end on, with whole audits compared."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserts):
        found = []
        if i == len(faults) and state in ("", "a"):
            found.append((0, "", ()))
        new = follow[state][-1]
        if inserts < 3:
            c, a, e = best(i, new, inserts + 1)
            found.append((c + 3, "I" + a, (("I", new), *e)))
        if i < len(faults):
            extra = 3 * (faults[i] == "truncated")
            c, a, e = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, (("D", ""), *e)))
            if faults[i] not in ("blank", "duplicate"):
                c, a, e = best(i + 1, new, 0)
                found.append((c + 3 + extra, "R" + a, (("R", new), *e)))
                if initials[i] and initials[i] in follow[state]:
                    c, a, e = best(i + 1, initials[i], 0)
                    found.append((c + extra, "K" + a, (("K", ""), *e)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def brute_repair(rows):
    out, by = [], {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, [])
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        by[c] += [(t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for c, turns in by.items():
        turns.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in turns:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, edits = cheapest(tuple(faults), tuple(r[1][:1] for r in turns))
        at, lines = iter(turns), []
        for letter, new in edits:
            _, role, text = ("", "", "") if letter == "I" else next(at)
            if letter != "D":
                lines.append(f"{ {'u': 'user', 'a': 'assistant'}[new] if letter in 'IR' else role}:{text}")
        t = [r[0] for r in turns if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out.append((c, max(t) - min(t) + 1 - len(set(t)) if t else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def turns_of(rng, n, convs):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Ünder"], ["One.", "Two!", "three", " ", "", None, "One. \n", "Ende ", "x?", "é日."]
    out = []
    for _ in range(n):
        c, t = int(rng.integers(0, convs)), int(rng.integers(0, 60))
        out.append((None if c == 0 else c, None if t < 3 else t, roles[int(rng.choice(7, p=[0.36, 0.36, 0.1, 0.06, 0.04, 0.04, 0.04]))], texts[int(rng.integers(0, len(texts)))] if rng.random() < 0.4 else f"t{rng.integers(0, 40)}.", 1, "x", "k", 2))
    return out + out[: n // 20]


def given(spark, path):
    return [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def got(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_conversations_are_repaired_as_by_brute_force(spark):
    want = brute_repair(given(spark, SF))
    assert got(repair.repair(repair.damage(spark.read.parquet(f"{SF}/conversations.parquet")))) == want
    assert sum(r[6] > 0 for r in want) > 5


@pytest.mark.parametrize("long_rows,part_rows", [(1 << 20, 1 << 20), (30, 7), (0, 1), (0, 64)])
def test_repair_of_random_turns_whole_and_in_parts(spark, long_rows, part_rows):
    rows = turns_of(np.random.default_rng(5), 1500, 40)
    rows += [(99, t, "user", "long " * 4000 + ".", 1, "x", "k", 2) for t in range(3)] + [(98, 5, "assistant", "same", 1, "x", "k", 2)] * 30
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(dropped, 1, "user", "One.", 1, "x", "k", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    have = got(repair.repair(repair.damage(df), long_rows=long_rows, part_rows=part_rows))
    assert have == brute_repair(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", sha("")) in have


def test_repair_by_bytes_and_without_rows(spark):
    rows = turns_of(np.random.default_rng(6), 300, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair.repair(repair.damage(df), long_bytes=100, part_rows=5)) == brute_repair(rows)
    none = common.materialize(df.limit(0), "none")
    assert repair.repair(repair.damage(none)).count() == 0


def test_a_long_conversation_solved_at_once():
    rng = np.random.default_rng(7)
    code = rng.integers(0, 16, 5000)
    ends = np.array([[0, repair.FAR, repair.FAR, 0]])
    cost, ((((audit, _)),),) = repair.solve([code], ends, [[repair.START]], True)
    names, faults = ["", "s", "u", "a"], ["", "blank", "duplicate", "truncated"]
    # by blocks from the end, so that brute force needs no deep recursion
    best = {"": (0, ""), "a": (0, "")}
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def closed(d):
        for _ in range(3):
            for s in follow:
                if follow[s][-1] in d:
                    c, a = d[follow[s][-1]]
                    d[s] = min(d.get(s, (10**9, "")), (c + 3, "I" + a))
        return d

    best = closed(best)
    for x in code[::-1]:
        fault, letter, new = faults[x >> 2], names[x & 3], {}
        extra = 3 * (fault == "truncated")
        for s in follow:
            found = [(best[s][0] + 4, "D" + best[s][1])]
            if fault in ("", "truncated"):
                c, a = best[follow[s][-1]]
                found.append((c + 3 + extra, "R" + a))
                if letter and letter in follow[s]:
                    c, a = best[letter]
                    found.append((c + extra, "K" + a))
            new[s] = min(found)
        best = closed(new)
    assert (int(cost[0][repair.START]), audit.decode()) == best[""]


def brute_trie(convs):
    """convs: conv_id and its list of (role, text)."""
    members, out = {}, []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)

    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in children.get(k, [])) or 1
        saved[k] = own + sum(saved[x] for x in children.get(k, []))
    for k, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def brute_rebuilt(rows):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    for v in own.values():
        v.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), hashlib.sha256(f"{r[1].encode().hex().upper()}:{r[2]}".encode()).digest()[:16]))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])
        out[c] = [r[1:] for r in base[:h] + turns[h:]]
    return out


def trie_rows(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_of_given_conversations(spark, sf):
    path = f"/root/testdata/{sf}"
    assert trie_rows(trie.of_rebuilt(spark.read.parquet(f"{path}/conversations.parquet"))) == brute_trie(brute_rebuilt(given(spark, path)))


def test_trie_of_edge_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in [*range(0, 120), -3, -10]:
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, None if rng.random() < 0.1 else t, ["user", "assistant", None][int(rng.integers(0, 3))], [f"t{rng.integers(0, 2)}", "", None, "é日"][int(rng.integers(0, 4))], 1, "x", "k", 2))
    rows += rows[:30] + [(None, 1, "user", "no id", 1, "x", "k", 2), (7, 9, "user", "long " * 20_000, 1, "x", "k", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie_rows(trie.of_rebuilt(df)) == brute_trie(brute_rebuilt(rows))
    none = common.materialize(df.limit(0), "none")
    assert trie.of_rebuilt(none).count() == 0


@pytest.mark.parametrize("deep,local_bytes", [(64, 1 << 20), (3, 1 << 20), (3, 1500), (0, 0), (0, 1 << 20)])
def test_deep_conversations_are_peeled_in_one_task_or_by_rounds(spark, deep, local_bytes):
    convs = {}
    for c in range(60):
        turns = [("u", f"{d}") for d in range(c % 4)]
        convs[c] = turns + [("a", f"{c % 3}{d}") for d in range(c % 7)] + [("u", "deep")] * (6 if c % 20 == 0 else 0)
    same = lambda r: hashlib.md5(repr(r).encode()).digest()
    df = spark.createDataFrame([(c, [(same(r), len(r[1].encode())) for r in turns]) for c, turns in convs.items()], "conv_id long, turns array<struct<same binary, bytes long>>")
    assert trie_rows(trie.nodes(df, deep=deep, local_bytes=local_bytes)) == brute_trie(convs)
