"""Values as they are printed on documents, read strictly: a text that may mean two things means none."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.text import DIGITS

#: Marks of decimals and thousands beside digits, what is left out of a line, and currencies.
MARKS = {"٫": ".", "٬": ","}
LEFT_OUT = r"[\u064b-\u065f\u0670\u0640\u200e\u200f\u202a-\u202e]"
CURRENCIES = ("SAR", "AED", "USD", "EUR")
#: Characters around a value or label that do not belong to it.
EDGES = " :.#"
_TABLE = {ord(x): y for xs, ys in DIGITS.items() for x, y in zip(xs, ys, strict=True)} | {ord(x): y for x, y in MARKS.items()}


@F.pandas_udf(T.StringType())
def _composed(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).translate(_TABLE))


def line(c: Column) -> Column:
    """Compatible forms composed, digits folded, marks of reading left out, blanks as one space. Only texts beyond ASCII go to Python."""
    plain = c.rlike(r"^[\x00-\x7F]*$")
    text = F.when(plain, c).otherwise(F.regexp_replace(_composed(F.when(~plain, c)), LEFT_OUT, ""))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_composed(c: pd.Series) -> pd.Series:
    return c.map(lambda xs: None if xs is None else [None if s is None else unicodedata.normalize("NFKC", s).translate(_TABLE) for s in xs])


def lines(c: Column) -> Column:
    """line() of each text of an array. Only arrays with texts beyond ASCII go to Python."""
    other = F.exists(c, lambda s: F.coalesce(~s.rlike(r"^[\x00-\x7F]*$"), F.lit(False)))
    blanks = lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    composed = lambda s, t: blanks(F.when(s.rlike(r"^[\x00-\x7F]*$"), s).otherwise(F.regexp_replace(t, LEFT_OUT, "")))
    return F.when(~other, F.transform(c, blanks)).otherwise(F.zip_with(c, _all_composed(F.when(other, c)), composed))


def label_key(c: Column) -> Column:
    """A label in lower case, with one kind of alef, without what stands around it; c is a line()."""
    return F.btrim(F.translate(F.lower(c), "أإآ", "ااا"), F.lit(EDGES))


def one_edit_apart(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) == 1


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: A number with and without marks of thousands, and a day in two forms, after a time of day is left out.
GROUPED, NUMBER = r"^\d{1,3}(,\d{3})+(\.\d{1,4})?$", r"^\d{1,18}(\.\d{1,4})?$"
ISO_DAY, SLASHED_DAY, TIME = r"^\d{4}-\d{2}-\d{2}$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"[ T]\d{2}:\d{2}(:\d{2})?$"
#: The same as most numbers are printed, with their marks of thousands, or with a percent sign.
PLAIN_GROUPED, PLAIN_PERCENT = r"^\d{1,3}(,\d{3}){1,5}(\.\d{1,4})?$", r"^\d{1,18}(\.\d{1,4})?%?$"
#: Fixed value: what a number may hold beside its digits and point.
PRINTED = r"(?i)[,\s]|" + "|".join(CURRENCIES)
#: What a document's number looks like, and the lengths of a name.
DOCUMENT_NUMBER, NAME = r"^[A-Za-z0-9][A-Za-z0-9/_-]{0,99}$", (2, 200)


def amount(c: Column, percentage: bool = False) -> Column:
    """A number as text, its places kept; null unless commas stand at thousands. A percent sign only where one is meant."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, "[%٪]", "")), r"(?i)\b(" + "|".join(CURRENCIES) + r")\b", ""))
    plain = let(bare, lambda t: F.when(~t.contains(","), t).when(t.rlike(GROUPED), F.replace(t, F.lit(","), F.lit(""))))
    value = let(plain, lambda t: F.when(t.rlike(NUMBER), F.regexp_replace(t, r"^0+(?=\d)", "")))
    digits = c.rlike(r"\d")
    if percentage:
        whole = F.translate(c, "%", "")
        at_once = F.when(whole.try_cast("decimal(22,4)") <= 100, F.regexp_replace(whole, r"^0+(?=\d)", ""))
        return F.when(c.rlike(PLAIN_PERCENT), at_once).when(digits, let(value, lambda v: F.when(v.try_cast("decimal(22,4)") <= 100, v)))
    # most texts are numbers as they stand, or hold nothing that is left out of one
    grouped = F.regexp_replace(F.translate(c, ",", ""), r"^0+(?=\d)", "")
    return F.when(c.rlike(NUMBER), F.regexp_replace(c, r"^0+(?=\d)", "")).when(c.rlike(PLAIN_GROUPED), grouped).when(digits & ~c.rlike("[%٪]") & c.rlike(PRINTED), value)


def day(c: Column) -> Column:
    """A date: year-month-day, or day and month in the order that only one of them allows; a time of day is left out."""
    date = lambda t: F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date")

    def slashed(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        built = lambda m, d: date(F.concat_ws("-", F.get(p, F.lit(2)), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
        return F.when((a.cast("int") > 12) | (a.cast("int") == b.cast("int")), built(b, a)).when(b.cast("int") > 12, built(a, b))

    read = lambda t: F.when(t.rlike(ISO_DAY), date(t)).when(t.rlike(SLASHED_DAY), let(F.split(t, "[/-]"), slashed))
    return F.when(c.rlike(r"^\d{1,4}[/-]\d"), let(F.regexp_replace(c, TIME, ""), read))


def field_value(field: Column, c: Column) -> Column:
    """The value of a field from the line after its label, null where it is not of the field's kind."""
    return let(
        F.btrim(c, F.lit(EDGES)),
        lambda text: F.when(field.isin("subtotal", "tax_total", "grand_total"), amount(text))
        .when(field == "currency", F.when(F.upper(text).isin(*CURRENCIES), F.upper(text)))
        .when(field == "invoice_date", day(text).cast("string"))
        .when(field == "invoice_number", F.when(text.rlike(DOCUMENT_NUMBER), text))
        .otherwise(F.when(F.length(text).between(*NAME), text)),
    )


def clean(c: Column, most: int = 500) -> Column:
    """Without NUL, blanks as one space, cut; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit("")), r"\s+", " ")), 1, most), F.lit(""))


def decimal_text(c: Column) -> Column:
    """A number from a structured source: digits and up to four places, without sign, exponent or marks; null otherwise."""
    return let(clean(c, 80), lambda t: F.when(t.rlike(NUMBER), F.regexp_replace(t, r"^0+(?=\d)", "")))


#: Fixed value: a day and time of a structured source.
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)?$"


def iso_timestamp(c: Column) -> Column:
    """A day and time as text, with a T between them; null unless both exist."""
    return let(clean(c, 80), lambda t: F.when(t.rlike(TIMESTAMP) & F.replace(t, F.lit(","), F.lit(".")).try_cast("timestamp").isNotNull(), t))


def iso_date(c: Column) -> Column:
    """A day as text; null unless it exists."""
    return let(clean(c, 40), lambda t: F.when(t.rlike(ISO_DAY) & t.try_cast("date").isNotNull(), t))


def row_is_consistent(quantity: Column, price: Column, discount: Column, rate: Column, total: Column) -> Column:
    """Whether a line's total is what its parts make, to two hundredths."""
    made = (quantity * price - discount) * (1 + rate / 100)
    return F.abs(made - total) <= F.lit("0.02").cast("decimal(4,2)")
