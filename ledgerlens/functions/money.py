"""Exact money in minor units: text to BIGINT and back, never through a float."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The amount grammar (parenthesis, sign, currency word, digits in groups of two or three, decimals,
# parenthesis, trailing minus) and the cells that say "nothing".
AMOUNT = r"(?i)^(\()?([-+])?\s*(?:(?:PKR|Rs)\.?)?\s*([0-9]{1,3}(?:,[0-9]{2,3})*|[0-9]+)(?:\.([0-9]{1,2}))?\s*(\))?(-)?$"
EMPTY = ("", "-", "--", "—", "–", "n/a", "na", "nil")


def is_empty(text: Column) -> Column:
    """Whether a cell says that there is no figure."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*EMPTY)


@cache
def _compatible() -> tuple[str, str]:
    """Characters of one NFKC character that amounts are written with, and that character."""
    known = set("0123456789,.()+-PKRSpkrs \u2212")
    pairs = [(chr(k), n) for k in range(0x80, 0x20000) if (n := unicodedata.normalize("NFKC", chr(k))) in known and n != chr(k)]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs)


def parse(text: Column) -> Column:
    """Minor units of an amount, null where the text is no amount or too large for BIGINT.

    A no-break space inside is dropped, the Unicode minus is a minus, and compatibility characters (full-width digits
    and the like) are read as their plain forms; of those that stand for several characters only the rupee sign is.
    """
    plain = lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(F.replace(F.translate(t, *_compatible()), F.lit("\u20a8"), F.lit("Rs")), "\u2212", "-")).otherwise(t)
    t = bind(F.replace(text, F.lit("\u00a0"), F.lit("")), plain)
    # one match gives all parts; a text that is no amount has no such mark in front
    return bind(F.split(F.regexp_replace(t, AMOUNT, "\x01$1;$2;$3;$4;$5;$6"), ";"), _units)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it; keeps generated code small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _units(parts: Column) -> Column:
    g = lambda k: F.get(parts, F.lit(k - 1))
    opened, whole = g(1) == "\x01(", F.replace(g(3), F.lit(",")).try_cast("bigint")
    units = F.try_add(F.try_multiply(whole, F.lit(100).cast("bigint")), F.rpad(g(4), 2, "0").try_cast("bigint"))
    minus = [g(2) == "-", opened, g(6) == "-"]
    count = reduce(Column.__add__, [m.cast("int") for m in minus])
    return F.when(F.startswith(g(1), F.lit("\x01")) & (opened == (g(5) == ")")) & (count <= 1), F.when(count == 1, -units).otherwise(units))


def render(units: Column) -> Column:
    """``1,234.50`` for 123450, by integer arithmetic."""
    size = F.abs(units)
    digits = F.lpad(size.cast("string"), 20, "0")
    groups = F.regexp_replace(F.regexp_replace(F.substring(digits, 1, 18), "^0+(?=.)", ""), r"(?<=\d)(?=(\d{3})+$)", ",")
    return F.concat(F.when(units < 0, "-").otherwise(""), groups, F.lit("."), F.substring(digits, 19, 2))


def signed(mode: str, debit: Column, credit: Column, amount: Column, credit_tokens: tuple[str, ...] = (), debit_tokens: tuple[str, ...] = ()) -> Column:
    """An amount by the layout's sign mode.

    ``columns``: exactly one of debit and credit holds a figure, debits turn
    negative (a negative debit turns positive). ``suffix``: the last token
    tells the direction. ``signed``: the amount as it is.
    """
    if mode == "signed":
        return parse(amount)
    if mode == "suffix":
        return by_suffix(amount, credit_tokens, debit_tokens)
    d, c = F.when(~is_empty(debit), parse(debit)), F.when(~is_empty(credit), parse(credit))
    return F.when(is_empty(debit) & ~is_empty(credit), c).when(is_empty(credit) & ~is_empty(debit), -d)


def by_suffix(text: Column, credit: tuple[str, ...], debit: tuple[str, ...]) -> Column:
    """An amount whose last token tells its direction; credit tokens are tried first."""
    low, out = F.lower(F.trim(text)), F.lit(None).cast("bigint")
    for sign, tokens in ((-1, debit), (1, credit)):
        for token in reversed(tokens):
            bare = F.trim(F.substring(F.trim(text), F.lit(1), F.length(low) - len(token)))
            out = F.when(F.endswith(low, F.lit(token.lower())), sign * F.abs(parse(F.btrim(bare, F.lit(" ."))))).otherwise(out)
    return out
