"""Column expressions for cells of a feed: cleaning, keys, numbers, measures, barcodes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lookups as L

_INVISIBLE = "[\\u200b-\\u200f\\uFEFF\\u0000]"
#: White space as Unicode has it, for use in patterns.
SPACE = r"[\s\u0085   -     　﻿]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns added or replaced, each evaluated once.

    Plain projections are merged by the optimizer, which repeats an expression wherever its column
    is used; keys built from keys would grow without end. A generated row keeps them apart.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def nfkc(c: Column, ascii_only: bool = False) -> Column:
    """Compatibility composition; ASCII text is left alone, and with ``ascii_only`` no Python is planned."""
    return c if ascii_only else F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def clean(c: Column, ascii_only: bool = False) -> Column:
    """A cell without invisible characters and outer space; null for placeholders and empty cells. Printable ASCII needs no more than trimming."""
    odd = trim(F.regexp_replace(F.regexp_replace(nfkc(c, ascii_only), _INVISIBLE, ""), "\r\n", "\n"))
    s = F.when(c.rlike(r"[^\x20-\x7E]"), odd).otherwise(F.trim(c))
    known = F.split(F.lit("\x1f".join(L.PLACEHOLDERS)), "\x1f", -1)  # a constant to the optimizer, and one call to build
    return F.when(F.array_contains(known, F.lower(s)), F.lit(None).cast("string")).otherwise(s)


def base_key(c: Column, ascii_only: bool = False) -> Column:
    """Lower case, single spaces, no invisible characters; null if empty."""
    s = F.lower(F.regexp_replace(nfkc(c, ascii_only), "[\\u200b-\\u200f\\uFEFF]", ""))
    return F.nullif(F.trim(F.regexp_replace(s, rf"{SPACE}+", " ")), F.lit(""))


def name_key(c: Column, ascii_only: bool = False) -> Column:
    """A company name without punctuation and suffix words; the plain key if nothing else is left."""
    base = base_key(c, ascii_only)
    words = "|".join(L.NAME_SUFFIXES)
    bare = F.regexp_replace(F.regexp_replace(base, r"[,.\-()]", " "), rf"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit("")), base)


def mpn_key(c: Column, ascii_only: bool = False) -> Column:
    """A part number in upper case without separators; null if empty."""
    return F.nullif(F.regexp_replace(F.upper(nfkc(c, ascii_only)), rf"{SPACE}|[\-_/.\\]", ""), F.lit(""))


def strong_description(c: Column, ascii_only: bool = False) -> Column:
    s = base_key(c, ascii_only)
    return F.coalesce((F.length(s) >= 20) & (F.size(F.filter(F.split(s, " "), lambda t: F.length(t) > 1)) >= 4), F.lit(False))


def description_fingerprint(c: Column, ascii_only: bool = False) -> Column:
    """The first 12 of the sorted significant tokens; independent of word order."""
    tokens = F.transform(F.split(base_key(c, ascii_only), " "), lambda t: F.regexp_replace(t, "[^a-z0-9\\u00c0-\\uffff]", ""))
    return F.array_join(F.slice(F.array_sort(F.filter(tokens, lambda t: F.length(t) > 1)), 1, 12), "|")


def strip_vendor_code(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c, r"\s*\([A-Z0-9]{1,6}\)\s*$", ""), F.lit("")), c)


def parse_number(c: Column) -> Column:
    """A double, or null for anything but plain digits with commas, a sign and one point."""
    s = F.regexp_replace(F.regexp_replace(c, rf"[,]|{SPACE}", ""), r"^\+", "")
    return F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))


MEASURE = r"^(-?[0-9.,]+)\s*([A-Za-zµ°]{1,6})\.?$"


def valid_gtin(digits: Column) -> Column:
    """Whether a code of 8, 12, 13 or 14 digits has the right GS1 check digit."""
    body = F.reverse(F.split(F.expr("''") if digits is None else F.substring(digits, F.lit(1), F.length(digits) - 1), ""))
    total = F.aggregate(F.transform(body, lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(digits.rlike(r"^([0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})$") & ((10 - total % 10) % 10 == F.right(digits, F.lit(1)).try_cast("int")), F.lit(False))


def barcode_digits(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}|-", "")
