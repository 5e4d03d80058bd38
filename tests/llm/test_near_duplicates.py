"""The pipeline's near-duplicate stage against brute force on five-word shingles and a similarity of 0.8."""

import numpy as np

import corpus_pipeline


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def first_of_groups(rows):
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (_, x) in enumerate(rows):
        for b in range(a):
            if similarity(x, rows[b][1]) >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return {i for a, (i, _) in enumerate(rows) if least[find(a)] == i}


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(500)]
    text = " ".join(base)
    cut, longer, shorter = " ".join(base[:411]), " ".join(base + [f"p{k}" for k in range(100)]), " ".join(base[:390])
    edited = list(base)
    for k in range(20, 500, 48):
        edited[k] = f"e{k}"
    edited = " ".join(edited)
    assert all(0.8 <= similarity(text, x) < 0.85 for x in (cut, longer, edited)) and similarity(text, shorter) < 0.8
    rows = [(1, text), (2, cut), (3, longer), (4, edited), (5, shorter.replace("w", "v")), (6, text.replace("w", "v"))]
    for g in range(5):
        own = [f"t{g}_{k}" for k in range(120)]
        for _ in range(8):
            copy = list(own)
            for k in rng.choice(120, int(rng.integers(0, 7)), replace=False):
                copy[k] = f"x{len(rows)}_{k}"
            rows.append((100 + len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = first_of_groups(rows)
    assert {1, 5, 6} <= want and not {2, 3, 4} & want
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
