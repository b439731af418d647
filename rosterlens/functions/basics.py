"""Small column helpers shared by every operator."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

# White space as text tools outside the JVM see it: the Unicode property plus
# the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Higher-order functions have no common-subexpression elimination and the
    optimizer inlines aliases into lambdas, so an array built from a long text
    would otherwise be rebuilt for every element that looks at it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def lower_text(col: Column) -> Column:
    return F.lower(text(col))


def number(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


def flag(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def strings(values: Iterable[str]) -> Column:
    """Literal array<string>: one literal however long the list, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def string_lists(lists: Iterable[Iterable[str]]) -> Column:
    """Literal array<array<string>>."""
    return F.from_json(F.lit(json.dumps([list(v) for v in lists])), "array<array<string>>")


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    """Unbounded substring test against a literal list."""
    words = tuple(needles)
    if not words:
        return F.lit(False)
    return let(col, lambda c: F.exists(strings(words), lambda n: F.contains(c, n)))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(col: Column) -> Column:
    return strip(F.regexp_replace(col, rf"(?U){SPACE}+", " "))


def as_word(phrase: str) -> str:
    """Pattern for ``phrase`` with no letter, digit or underscore next to it."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)
    return rf"(?<!{WORD}){quoted}(?!{WORD})"


def grid(col: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: array-library rounding."""
    factor = float(10 ** digits)
    return F.rint(col * F.lit(factor)) / F.lit(factor)


def exact_units(col: Column, digits: int) -> Column:
    """``col`` in units of 10^-digits, correctly rounded from its binary value.

    Multiplying by ten in floating point can turn a value just below a tie into
    the tie. The value is split into two halves of its bits, whose products
    with a small integer are exact, to see on which side of the tie it lies.
    """
    scale = float(10 ** digits)

    def rounded(x: Column) -> Column:
        wide = x * F.lit(134217729.0)
        return let(F.struct(x.alias("x"), (wide - (wide - x)).alias("high"),
                            F.floor(x * scale).cast("double").alias("down")), from_halves)

    def from_halves(p: Column) -> Column:
        tie = p["down"] * 2.0 + 1.0
        side = (p["high"] * (2.0 * scale) - tie) + (p["x"] - p["high"]) * (2.0 * scale)
        up = (side > 0) | ((side == 0) & (p["down"] % 2 == 1))
        return p["down"].cast("bigint") + F.when(up, 1).otherwise(0)

    def signed(x: Column) -> Column:
        return F.when(x < 0, -rounded(F.abs(x))).otherwise(rounded(x))

    return let(col.cast("double"), signed)


def exact_round(col: Column, digits: int) -> Column:
    return exact_units(col, digits) / F.lit(float(10 ** digits))


def one_decimal(col: Column) -> Column:
    """Text with one decimal, e.g. ``6.2`` (values are never negative here)."""
    return let(exact_units(col, 1), lambda u: F.concat(
        F.floor(u / 10).cast("bigint").cast("string"), F.lit("."),
        F.pmod(u, F.lit(10)).cast("string")))


def no_decimals(col: Column) -> Column:
    return F.rint(col).cast("bigint").cast("string")


def number_text(col: Column) -> Column:
    """Whole numbers without a decimal point, others as they are."""
    return F.when(col == F.floor(col), col.cast("bigint").cast("string")).otherwise(
        col.cast("string"))
