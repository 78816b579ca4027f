"""Numeric scalars (F-09 … F-12, F-28).  ANSI mode is on, so text is parsed
behind a regex guard (never a raising cast, never a per-row exception) and
every division is ``try_divide``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    """Exact two-place money: sums of these are order-independent."""
    return c.cast(MONEY)


NUMBER_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def parse_double(c: Column) -> Column:
    """Text → double, null when not a number.  A regex guard in front of the
    cast avoids ``try_cast``'s per-row exception on non-numeric text."""
    s = c.cast("string")
    return F.when(s.rlike(NUMBER_RE), F.trim(s).cast("double"))


def int_text(c: Column) -> Column:
    """Text holding a number → integer text ('6.0' → '6'); non-numbers → null."""
    return F.round(parse_double(c)).cast("bigint").cast("string")


def to_int_or_zero(c: Column) -> Column:
    """F-09 integer columns: unparsable → 0."""
    return F.coalesce(F.round(parse_double(c)).cast("bigint"), F.lit(0).cast("bigint"))


def amount_text_to_money(c: Column) -> Column:
    """F-09 amounts: strip thousands separators, parse, 0 → null."""
    v = parse_double(F.regexp_replace(c.cast("string"), ",", "")).cast(MONEY)
    return F.nullif(v, F.lit(0).cast(MONEY))


def safe_divide(a: Column, b: Column, default: Column | None = None) -> Column:
    """F-12: a / b, ``default`` when b is 0/null or either side unparsable."""
    r = F.try_divide(parse_double(a), parse_double(b))
    return r if default is None else F.coalesce(r, default)


def numeric_op(a: Column, b: Column, op: str) -> Column:
    """F-11: add/subtract/multiply/divide with text inputs; divide by 0 → a."""
    x, y = parse_double(a), parse_double(b)
    if op == "add":
        return x + y
    if op == "subtract":
        return x - y
    if op == "multiply":
        return x * y
    if op == "divide":
        return F.when(y == 0, x).otherwise(F.try_divide(x, y))
    raise ValueError(op)


def qty_add_text(a: Column, b: Column) -> Column:
    """F-28: quantity text + quantity text, nulls count as 0, result as text."""
    x = F.coalesce(parse_double(a), F.lit(0.0))
    y = F.coalesce(parse_double(b), F.lit(0.0))
    return F.round(x + y).cast("bigint").cast("string")
