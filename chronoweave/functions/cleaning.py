"""Column expressions that bring messy cells to one form. Nothing here raises under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions.hashing import as_col

# Spellings read as true or false.
TRUE_WORDS = ["true", "t", "yes", "y"]
FALSE_WORDS = ["false", "f", "no", "n"]
RATING_STEP_TOLERANCE = 1e-8

_STEP = RATING_STEP_TOLERANCE


def null_like(c) -> Column:
    """Null, NaN or blank text."""
    c = as_col(c)
    text = c.cast("string")
    return c.isNull() | (text == "NaN") | (F.trim(text) == "")


def number(c) -> Column:
    """Numeric parse; anything unparsable or NaN is null."""
    v = F.trim(as_col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def moment(c) -> Column:
    """Timestamp parse in UTC; unparsable is null."""
    return as_col(c).cast("string").try_cast("timestamp")


def plain_number_text(c) -> Column:
    """Text of a double without exponent for whole values (1.0E7 becomes 10000000)."""
    c = as_col(c)
    whole = (F.abs(c) < 1e15) & (c == F.floor(c))
    return F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))


def value_text(c) -> Column:
    """Trimmed text; null-like becomes '' and a whole number written with '.0' loses it."""
    c = as_col(c)
    t = F.trim(c.cast("string"))
    whole = t.rlike(r"^[+-]?\d*\.0$")
    return F.when(null_like(c), F.lit("")).when(whole, t.try_cast("decimal(38,0)").cast("string")).otherwise(t)


@dataclass(frozen=True)
class CategoryRule:
    """How a categorical column is declared: a type name and, optionally, its domain."""

    dtype: str = ""
    valid_values: tuple | None = None

    @property
    def domain(self) -> list[str] | None:
        return None if self.valid_values is None else [str(v) for v in self.valid_values]

    @property
    def binary(self) -> bool:
        if self.dtype.lower() in ("bool", "boolean"):
            return True
        domain = {d.strip().lower().removesuffix(".0") for d in self.domain or []}
        return bool(domain) and domain <= {"0", "1", "true", "false"}

    @property
    def whole(self) -> bool:
        if self.dtype.lower() in ("int", "integer", "int64", "int32"):
            return True
        try:
            return bool(self.domain) and all(float(d).is_integer() for d in self.domain)
        except ValueError:
            return False

    @property
    def real(self) -> bool:
        return self.dtype.lower() in ("float", "double", "number", "numeric")


def category(c, rule: CategoryRule = CategoryRule()) -> Column:
    """Canonical text of a categorical cell under its rule; null-like is null."""
    # bound once as a lambda variable: the expression is used many times below
    return F.transform(F.array(F.when(~null_like(c), value_text(c))), lambda text: _category(text, rule))[0]


def _category(text: Column, rule: CategoryRule) -> Column:
    num = number(text)
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    if rule.binary:
        low = F.lower(text)
        out = out.when(low.isin(TRUE_WORDS), F.lit("1")).when(low.isin(FALSE_WORDS), F.lit("0"))
        out = out.when(num.isin(0.0, 1.0), num.cast("int").cast("string"))
    if rule.whole:
        out = out.when(num.isNotNull() & (num == F.floor(num)), plain_number_text(num))
    if rule.real:
        out = out.when(num.isNotNull(), num.cast("string"))
    return out.otherwise(text)


def rating(c) -> Column:
    """Positive number on the half-step grid, else null."""
    num = number(c)
    twice = F.bround(num * 2)
    return F.when((F.abs(num * 2 - twice) <= _STEP) & (twice > 0), twice / 2)


def flag_any_text(c) -> Column:
    """Variant A: null 0, known words, numbers as they are, any other non-empty text 1."""
    t = as_col(c).cast("string")
    low = F.lower(F.trim(t))
    return (
        F.when(as_col(c).isNull(), 0.0).when(low.isin([*TRUE_WORDS, "1"]), 1.0).when(low.isin([*FALSE_WORDS, "0"]), 0.0)
        .otherwise(F.when(t != "", 1.0).otherwise(0.0))
    )


def flag_words(c) -> Column:
    """Variant B: true words 1, all else 0 (trimmed)."""
    return F.coalesce(F.lower(F.trim(as_col(c).cast("string"))).isin([*TRUE_WORDS, "1"]), F.lit(False)).cast("double")


def flag_strict(c) -> Column:
    """Variant C: true, 1, yes, y (not trimmed, no 't') is 1, all else 0."""
    return F.coalesce(F.lower(as_col(c).cast("string")).isin(["true", "1", "yes", "y"]), F.lit(False)).cast("double")


def flag_numeric_first(c, any_number: bool) -> Column:
    """Variant D: numbers when any cell of the column parses (the caller knows), else words incl. 'verified'."""
    if any_number:
        return number(c)
    return F.coalesce(F.lower(as_col(c).cast("string")).isin(["true", "1", "yes", "y", "verified"]), F.lit(False)).cast("double")


def flag_or_null(c) -> Column:
    """Variant E: known words or 0/1; anything else null."""
    low = F.lower(F.trim(as_col(c).cast("string")))
    num = number(low)
    near = F.bround(num)
    return (
        F.when(low.isin([*TRUE_WORDS, "1", "1.0", "verified"]), 1.0).when(low.isin([*FALSE_WORDS, "0", "0.0", "unverified"]), 0.0)
        .when((F.abs(num - near) <= _STEP) & near.isin(0.0, 1.0), near)
    )


def time_bucket(ts, level: str) -> Column:
    """Text bucket of a time: date, year_month, month, year or global."""
    ts = as_col(ts)
    if level == "global":
        return F.lit("global")
    return F.date_format(ts, {"date": "yyyy-MM-dd", "year_month": "yyyy-MM", "month": "MM", "year": "yyyy"}[level])


def padded_month(c) -> Column:
    """Month keys 1..12 to two digits; other keys stay."""
    t = F.trim(as_col(c).cast("string"))
    return F.when(t.rlike("^([1-9]|0[1-9]|1[0-2])$"), F.lpad(t, 2, "0")).otherwise(t)


def reflect_unit(x) -> Column:
    """Fold a number into [0, 1] by reflection at both ends; not finite gives one half."""
    x = as_col(x).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, 1 - F.abs(1 - F.pmod(x, F.lit(2.0)))).otherwise(F.lit(0.5))


def logit(p, tiny: float = 1e-4) -> Column:
    p = F.least(F.greatest(as_col(p).cast("double"), F.lit(tiny)), F.lit(1 - tiny))
    return F.ln(p / (1 - p))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-as_col(x)))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def softmax(a) -> Column:
    a = as_col(a)
    top = F.array_max(a)
    return F.transform(F.transform(a, lambda v: F.exp(v - top)), lambda e: e / array_sum(F.transform(a, lambda v: F.exp(v - top))))


def log_clip(a, tiny: float = 1e-12) -> Column:
    return F.transform(as_col(a), lambda v: F.ln(F.greatest(v, F.lit(tiny))))


def entropy(a, bits: bool = False) -> Column:
    """Entropy of a probability array in nats or bits."""
    log = F.log2 if bits else F.ln
    return -array_sum(F.transform(as_col(a), lambda p: F.when(p > 0, p * log(p)).otherwise(F.lit(0.0))))


def dot(a, b) -> Column:
    return array_sum(F.zip_with(as_col(a), as_col(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def decay(days, tau: float) -> Column:
    return F.exp(-F.greatest(as_col(days).cast("double"), F.lit(0.0)) / tau)


def decimal_places(c) -> Column:
    """Digits after the point in the shortest text of a number, exponent form included."""
    t = as_col(c).cast("double").cast("string")
    exponent = F.coalesce(F.regexp_extract(t, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    digits = F.length(F.regexp_replace(F.regexp_extract(t, r"\.(\d+)", 1), "0+$", ""))
    return F.greatest(digits - exponent, F.lit(0))


def date_parts(ts) -> dict[str, Column]:
    """Month, weekday (Monday 0), hour, year, and the cyclic forms of month and weekday."""
    import math

    ts = as_col(ts)
    month, weekday = F.month(ts), F.weekday(ts)
    turn = 2 * math.pi
    return {
        "month": month, "weekday": weekday, "hour": F.hour(ts), "year": F.year(ts),
        "month_sin": F.sin(turn * (month - 1) / 12), "month_cos": F.cos(turn * (month - 1) / 12),
        "weekday_sin": F.sin(turn * weekday / 7), "weekday_cos": F.cos(turn * weekday / 7),
        "seconds": F.unix_micros(ts) / F.lit(1e6),
    }


def bucket_by_edges(c, edges: Sequence[float], right: bool = True) -> Column:
    """Number of edges at or below the value (`right`) or strictly below it."""
    c = as_col(c)
    grid = F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(grid, (lambda e: e <= c) if right else (lambda e: e < c)))
