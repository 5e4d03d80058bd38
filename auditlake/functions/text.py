"""Keys of names, numbers and units, and similarity of descriptions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that are written alike, by the letter that stands for them; the last one is left out.
LETTERS = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ؤ": "و", "ئ": "ي", "ة": "ه", "ـ": ""}
#: The ten digits of three scripts.
DIGITS = {"٠١٢٣٤٥٦٧٨٩": "0123456789", "۰۱۲۳۴۵۶۷۸۹": "0123456789"}
#: Folded spellings of units and the unit that each stands for.
UNITS = {
    "قطعه": "piece", "قطع": "piece", "حبه": "piece", "piece": "piece", "pieces": "piece", "pc": "piece", "pcs": "piece",
    "كجم": "kg", "كيلوجرام": "kg", "كيلو": "kg", "kg": "kg", "جرام": "g", "جم": "g", "g": "g", "لتر": "l", "liter": "l", "litre": "l", "l": "l",
    "متر": "m", "meter": "m", "metre": "m", "m": "m", "صندوق": "box", "كرتون": "box", "box": "box",
}
#: A word of a folded text, and the hyphens within a word.
WORD, HYPHEN = r"[a-z0-9\u0621-\u064a]+", r"(?<=[a-z])[-_/](?=[0-9])"
_DIGITS = {ord(x): y for xs, ys in DIGITS.items() for x, y in zip(xs, ys, strict=True)}
_FOLD = {ord(x): y for x, y in LETTERS.items()} | _DIGITS


def _is_plain(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


@F.pandas_udf(T.StringType())
def _folded(c: pd.Series) -> pd.Series:
    """Compatible forms composed, letters and digits folded, lower case, without combining marks."""
    compose = lambda s: unicodedata.normalize("NFKC", s).translate(_FOLD).casefold()
    return c.map(lambda s: None if s is None else "".join(x for x in compose(s) if not unicodedata.combining(x)))


@F.pandas_udf(T.StringType())
def _letters_and_digits(c: pd.Series) -> pd.Series:
    """Compatible forms composed, digits folded, lower case, letters and digits only."""
    return c.map(lambda s: None if s is None else "".join(x for x in unicodedata.normalize("NFKC", s).translate(_DIGITS).casefold() if x.isalnum()))


def number_key(c: Column) -> Column:
    """Letters and digits of a document number, folded; null if none are left. Only texts beyond ASCII go to Python."""
    plain = F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    return F.nullif(F.when(_is_plain(c), plain).otherwise(_letters_and_digits(F.when(~_is_plain(c), c))), F.lit(""))


@F.pandas_udf(T.StringType())
def _one_line(c: pd.Series) -> pd.Series:
    """Spaces collapsed, compatible forms composed, case folded."""
    return c.map(lambda s: None if s is None else unicodedata.normalize("NFKC", " ".join(s.split())).casefold())


def name_key(c: Column) -> Column:
    """SHA-256 of a name with its spaces collapsed, compatible forms composed and case folded. Only names beyond ASCII go to Python."""
    spaces = r"[\x09-\x0D\x1C-\x20]+"
    plain = F.lower(F.regexp_replace(F.regexp_replace(c, spaces, " "), "^ | $", ""))
    return F.sha2(F.when(_is_plain(c), plain).otherwise(_one_line(F.when(~_is_plain(c), c))), 256)


def phrase(c: Column) -> Column:
    """Words of a description, folded, joined by one space; a hyphen between a letter and a digit joins them (CAT-6 is cat6)."""
    folded = F.when(_is_plain(c), F.lower(c)).otherwise(_folded(F.when(~_is_plain(c), c)))
    return F.coalesce(F.array_join(F.regexp_extract_all(F.regexp_replace(folded, HYPHEN, ""), F.lit(f"({WORD})")), " "), F.lit(""))


def unit_key(c: Column) -> Column:
    """The unit that a spelling stands for, else its phrase; null if that is empty."""
    names = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    own = F.nullif(phrase(c), F.lit(""))
    return F.coalesce(F.try_element_at(names, own), own)


def digit_words(c: Column) -> Column:
    """Words of a phrase that are digits throughout, in order; descriptions compare only if these agree."""
    return F.filter(F.split(c, " "), lambda w: w.rlike(r"^[0-9]+$"))


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks (longest block first); not symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def common_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in the longest common subsequence, which matching_ratio() is never over; symmetric."""

    def ratio(x: str, y: str) -> float:
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | 1 << i
        every = free = (1 << len(x)) - 1  # a bit is cleared for each character of the subsequence
        for c in y:
            hit = free & at.get(c, 0)
            free = (free + hit | free - hit) & every
        return 2.0 * (len(x) - free.bit_count()) / (len(x) + len(y))

    return pd.Series([ratio(x, y) if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")


#: Kinds of letters that are counted.
KINDS = 32


@F.pandas_udf(T.BinaryType())
def letter_counts(c: pd.Series) -> pd.Series:
    """How often a text has letters of each of KINDS kinds, in a byte each, up to 255 times."""
    import numpy as np

    counted = lambda x: np.minimum(np.bincount(np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32) % KINDS, minlength=KINDS), 255)
    return c.map(lambda x: counted(x).astype(np.uint8).tobytes(), na_action=None)


def shared_letters(a, b, n, m):
    """Shares of letters that texts of n and m letters may have in common by their counts, which matching_ratio() is never over."""
    import numpy as np

    both = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    most = np.minimum(n - a.sum(axis=1, dtype=np.int64) + both, m - b.sum(axis=1, dtype=np.int64) + both)
    return 2.0 * most / np.maximum(n + m, 1)


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when((a != "") & (b != ""), both / F.size(F.array_union(x, y)))


#: Letters of a phrase up to which parts of phrases are compared; longer ones are compared by their lengths.
LONG = 64


def _parts(phrase: str, least: float, longer: bool) -> set[str]:
    """Keys of a phrase as the shorter or as the longer one of two; phrases with a similarity of `least` share one.

    Texts of a and b letters with a ratio of least differ in d = (1 - least) * (a + b) letters at most. So one of d + 1
    pieces of the shorter stands in the longer unchanged, moved by no more than the other letters allow.
    """
    words = sorted({*phrase.split(" ")}, key=lambda w: (-len(w), w))
    missing = int((1 - least) * len(words) + 1e-9)
    if int(len(words) / least + 1e-9) == len(words):  # all words must be equal
        keys = {"|".join(["=", *words])}
    else:
        keys = {f"w|{w}" for w in words[: missing + 1]}
    n = len(phrase)
    others = range(int(n * least / (2 - least) - 1e-9), n + 1) if longer else range(n, int(n * (2 - least) / least + 1e-9) + 1)
    for m in others:
        a, b = (m, n) if longer else (n, m)
        d = int((1 - least) * (a + b) + 1e-9)
        if b > LONG or d >= a:
            keys.add(f"{a}|{b}")
            continue
        for i in range(d + 1):
            start, end = i * a // (d + 1), (i + 1) * a // (d + 1)
            moved = range(-((d - b + a) // 2), (d + b - a) // 2 + 1) if longer else (0,)
            keys |= {f"{a}|{b}|{i}|{phrase[start + k : end + k]}" for k in moved if start + k >= 0 and end + k <= n}
    return keys


def text_keys(c: Column, least: float, longer: bool) -> Column:
    """Keys of a text as the shorter or as the longer one of two; texts that are alike by `least` share one."""
    return F.pandas_udf(lambda x: x.map(lambda s: sorted(_parts(s, least, longer))), T.ArrayType(T.StringType()))(c)


def similar_phrases(phrases: DataFrame, least: float) -> DataFrame:
    """(phrase, other, similarity) of different phrases with equal words of digits and a similarity of at least `least`.

    Only phrases that share a key are compared, each pair once in each order, as the ratio is not symmetric.
    """
    rows = phrases.select("phrase", F.array_join(digit_words(F.col("phrase")), " ").alias("sizes"))
    side = lambda name, longer: rows.select(F.col("phrase").alias(name), "sizes", F.explode(text_keys(F.col("phrase"), least, longer)).alias("k")).select(name, F.xxhash64("sizes", "k").alias("k"), "sizes")
    found = side("a", False).join(side("b", True), ["k", "sizes"]).filter("a <> b")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = found.select(F.col("a").alias("phrase"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("phrase"), F.col("a").alias("other")))
    jaccard = word_jaccard(F.col("phrase"), F.col("other"))
    # a ratio cannot be over twice the shorter length by both lengths
    bound = 2.0 * F.least(F.length("phrase"), F.length("other")) / (F.length("phrase") + F.length("other"))
    pairs = pairs.filter((bound >= least) | (jaccard >= least))
    return pairs.withColumn("similarity", F.greatest(matching_ratio("phrase", "other"), jaccard)).filter(F.col("similarity") >= least)
