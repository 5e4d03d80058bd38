"""Quality rules whose cutoffs limit false rejection: exact binomial bounds on labelled holdouts, per stratum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from auditlake.llm.common import free_name, materialize, py_words, tidy

#: A rule rejects texts whose score is over its cutoff; cutoffs are fixed beforehand, from loose to strict.
RULES = {
    "symbol_share": (0.50, 0.30, 0.20, 0.15, 0.10, 0.08, 0.06, 0.04, 0.03, 0.02),
    "caps_share": (0.90, 0.70, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15),
    "exclaim_share": (0.30, 0.20, 0.15, 0.10, 0.08, 0.06, 0.04, 0.03),
    "dup_line_share": (0.90, 0.70, 0.50, 0.40, 0.30, 0.25, 0.20),
    "repeat_share": (0.90, 0.70, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15),
}
#: In each stratum all rules together reject at most ALPHA of the good texts, with probability 1 - DELTA over all strata.
ALPHA, DELTA = 0.05, 0.05
#: The holdout is all labels. So many good ids are broadcast at most; with more, counts of the texts meet them by a shuffle.
MAX_LABELS = 1_000_000
#: Cutoffs of so many bytes are broadcast.
SMALL_BYTES = 16 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps_words", "n_exclaims"]
SCORES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "caps_share": ("n_caps_words", "n_words"),
    "exclaim_share": ("n_exclaims", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    import numpy as np

    text = text or ""
    words = py_words(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if line and line.strip(" \t\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if n >= 4:
        codes: dict[bytes, int] = {}
        c = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
        if len(codes) <= n - 3 or n < 6:
            two = np.unique(c[:-1] * len(codes) + c[1:], return_inverse=True)[1]
            _, inverse, times = np.unique(two[:-1] * len(codes) + c[2:], return_inverse=True, return_counts=True)
            again = times[inverse] > 1
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[i : n - 2 + i] |= again
            repeated = int(covered.sum())
    return n, chars, sum(map(text.count, "#*$%&|<>")), dup, repeated, lines, sum(map(str.isupper, text.split())), text.count("!")


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) and COUNTS of its whole texts; null and empty texts count as no words."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    at = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches):
        import pyarrow as pa

        for b in (part.slice(lo, 500) for part in batches for lo in range(0, part.num_rows, 500)):
            made = list(zip(*map(text_counts, b.column(at).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(m, pa.int64()) for m in made]], [*keep, *COUNTS])

    schema = StructType([*docs.select(*keep).schema.fields, *[StructField(c, LongType()) for c in COUNTS]])
    return rows.mapInArrow(tidy(run), schema)


def scores() -> dict:
    return {r: F.col(a) / F.greatest(F.col(b), F.lit(1)) for r, (a, b) in SCORES.items()}


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p); at most p is over the exact (Clopper-Pearson) upper bound iff this is small."""
    if k >= n * p:
        return 1.0
    term = n * math.log1p(-p)
    terms = [term]
    for i in range(k):
        term += math.log((n - i) / (i + 1)) + math.log(p / (1 - p))
        terms.append(term)
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def certified(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """How many of the cutoffs, loose to strict, have a false rejection rate of at most alpha at this level.

    rejected counts the good holdout texts over each cutoff. Cutoffs are tested in their fixed order, and the first
    one that fails ends it, so the level holds for all of them together.
    """
    for i, k in enumerate(rejected):
        if binomial_tail(k, n, alpha) > level:
            return i
    return len(rejected)


def fit_cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) for each rule and stratum in which a cutoff is certified.

    Good texts are those whose id has labels, all of them of quality 1; an id with several labels counts once, and so
    does a text that several good documents of a stratum share, since copies are no independent draws. The guarantee is
    on distinct good texts that pass the base rules, since only those are in the holdout. The level delta is divided
    over all rules and strata (Bonferroni), alpha over the rules, since a text may break more than one. Only counts of
    the holdout leave the tasks.
    """
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("least"))
    known = materialize(known, "quality-labels")
    good = known.filter("least = 1").select("label")
    few = good.count() <= MAX_LABELS
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(good), F.col("id") == F.col("label"), "left_semi") if few else texts.filter(F.col("id").isNotNull())
    rows = rows.select("id", "stratum", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("print"), "text")
    held = measure(rows, "text", ["id", "stratum", "print"]).filter(~base_failed())
    held = (held if few else held.join(good.hint("merge"), F.col("id") == F.col("label"), "left_semi")).dropDuplicates(["stratum", "print"])
    over = [F.lit(0).alias("_")]
    for rule, score in scores().items():
        over += [F.sum((score > c).cast("long")).alias(f"{rule}_{i}") for i, c in enumerate(RULES[rule])]
    counted = materialize(held.groupBy("stratum").agg(F.count("*").alias("n"), *over[1:]), "quality-counts")
    tests = max(counted.count(), 1) * len(RULES)

    def choose(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                for rule, cutoffs in RULES.items():
                    i = certified([int(row[f"{rule}_{j}"]) for j in range(len(cutoffs))], int(row["n"]), alpha / len(RULES), delta / tests)
                    if i:
                        out.append((row["stratum"], rule, cutoffs[i - 1]))
            yield pd.DataFrame(out, columns=["stratum", "rule", "cutoff"])

    return counted.mapInPandas(choose, "stratum string, rule string, cutoff double")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default), COUNTS, base_failed, broken (rules over their cutoffs) and kept.

    Every row has a verdict. Null texts count as empty and fail the base rules; a null stratum is a stratum of its
    own; where no cutoff is certified, the base rules alone decide, as with an empty table of labels. Repeated rows
    are judged alike; very long texts are read whole. An empty table gives no rows. Columns that docs has under the
    names of COUNTS or of the verdict, in any case, are not kept; keep_good() keeps them.
    """
    cutoffs = materialize(fit_cutoffs(docs, labels, stratum, id_col, text_col), "quality-cutoffs")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*COUNTS, "base_failed", "broken", "kept")]
    own, key = free_name(docs, "own_stratum"), free_name(docs, "cutoff_stratum")
    at = {r: free_name(docs, f"cutoff_{r}") for r in RULES}
    wide = cutoffs.groupBy(F.col("stratum").alias(key)).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = wide.select(key, *[F.col(r).alias(at[r]) for r in RULES])
    if (wide.agg(F.sum(F.octet_length(key) + 64)).first()[0] or 0) <= SMALL_BYTES:
        wide = F.broadcast(wide)
    rows = measure(docs.withColumn(own, F.coalesce(F.col(stratum).cast("string"), F.lit(""))), text_col, [*keep, own])
    rows = rows.join(wide, F.col(own) == F.col(key), "left")
    broken = F.array_compact(F.array(*[F.when(score > F.col(at[r]), F.lit(r)) for r, score in scores().items()]))
    rows = rows.select(*keep, *COUNTS, base_failed().alias("base_failed"), broken.alias("broken"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all of docs' columns, whatever their names."""
    columns = docs.columns
    plain = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = docs.toDF(*plain.values())
    judged = judge(rows, labels.withColumnRenamed(id_col, plain[id_col]), plain[stratum], plain[id_col], plain[text_col])
    return judged.filter("kept").select(*plain.values()).toDF(*columns)
