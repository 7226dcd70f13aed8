"""Text and date functions of statements."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC form; Spark has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_description(text: Column) -> Column:
    """NFKC (skipped for ASCII), white space collapsed, trimmed, upper case."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text)
    return F.upper(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def squash(text: Column) -> Column:
    """An identifier without anything but letters and digits, upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def mask_identifier(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(4))))


def shape(text: Column) -> Column:
    """Letters to X or x, digits to 9; other scripts to x."""
    return F.regexp_replace(F.mask(text, F.lit("X"), F.lit("x"), F.lit("9")), r"[^\x00-\x7F]", "x")


def fiscal_year(day: Column) -> Column:
    """``TY2026`` for days from July 2025 to June 2026."""
    return F.concat(F.lit("TY"), (F.year(day) + F.when(F.month(day) >= 7, 1).otherwise(0)).cast("string"))


def parse_date(text: Column, formats: tuple[str, ...]) -> Column:
    """The date by the first format that fits, else null."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(*[F.try_to_timestamp(flat, F.lit(f)).cast("date") for f in formats])


def txn_id(account: Column, day: Column, amount: Column, balance: Column, description: Column, occurrence: Column) -> Column:
    """First 16 hex digits of a digest over all parts; a null balance is the word none, not a gap."""
    parts = (account.cast("string"), F.date_format(day, "yyyy-MM-dd"), amount.cast("string"), F.coalesce(balance.cast("string"), F.lit("none")), description, occurrence.cast("string"))
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)
