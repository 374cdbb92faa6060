"""Exact decoding of text into typed values. A value that would round or is malformed decodes to an error.

Each decoder returns (value, bad): `bad` is true where a text is present but has no exact value. Callers fail the
whole transfer if any row is bad (`tessera.operators.checks.require`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decimal_from_text(text: Column, precision: int, scale: int) -> tuple[Column, Column]:
    """An optional exponent is allowed; a nonzero digit beyond the scale, or too many digits, is bad.

    Digits are shifted as text, so nothing goes through a double or a rounding cast.
    """
    kind = f"decimal({precision},{scale})"

    def shown(p: Column, units: Column) -> Column:
        padded = F.lpad(units, F.greatest(F.length(units), F.lit(scale + 1)), F.lit("0"))
        return F.concat(F.when(p["negative"], "-").otherwise(""), F.left(padded, F.length(padded) - scale), F.lit("." if scale else ""), F.right(padded, F.lit(scale)))

    def fitted(p: Column) -> Column:
        over = F.greatest(p["tail"] - scale, F.lit(0))
        cut = F.when(over >= F.length(p["digits"]), F.lit("")).otherwise(F.left(p["digits"], F.length(p["digits"]) - over))
        lost = F.when(over >= F.length(p["digits"]), p["digits"]).otherwise(F.right(p["digits"], over))
        units = F.concat(cut, F.repeat(F.lit("0"), F.least(F.greatest(scale - p["tail"], F.lit(0)), F.lit(80))))
        return let(F.regexp_replace(units, r"^0+", ""), lambda u: F.when((F.length(u) <= precision) & ~lost.rlike("[1-9]"), shown(p, u).try_cast(kind)))

    def parsed(plain: Column) -> Column:
        mantissa = F.regexp_extract(plain, r"^[+-]?(\d*)\.?(\d*)", 1), F.regexp_extract(plain, r"^[+-]?(\d*)\.?(\d*)", 2)
        exponent = F.coalesce(F.nullif(F.regexp_extract(plain, r"[eE]([+-]?\d{1,6})$", 1), F.lit("")).try_cast("int"), F.lit(0))
        parts = F.struct(F.regexp_replace(F.concat(*mantissa), r"^0+", "").alias("digits"), (F.length(mantissa[1]) - exponent).alias("tail"), plain.startswith("-").alias("negative"))
        return F.when(plain.rlike(NUMBER), let(parts, fitted))

    value = let(F.trim(text), parsed)
    return value, text.isNotNull() & value.isNull()


def int_from_text(text: Column) -> tuple[Column, Column]:
    """A whole number within 64 bits; `1.0` and `1e3` are whole, `1.5` is bad."""
    value, bad = decimal_from_text(text, 19, 0)
    whole = value.try_cast("long")
    return whole, text.isNotNull() & (bad | whole.isNull())


def _digits(text: Column) -> tuple[Column, Column]:
    """Significant digits of a number's text, and the power of ten that their last one stands for."""
    parts = [F.regexp_extract(text, r"^[+-]?(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$", i) for i in (1, 2, 3)]
    raw = F.regexp_replace(F.concat(parts[0], parts[1]), "^0+", "")
    kept = F.regexp_replace(raw, "0+$", "")
    power = F.coalesce(F.nullif(parts[2], F.lit("")).try_cast("int"), F.lit(0)) - F.length(parts[1]) + F.length(raw) - F.length(kept)
    return kept, F.when(kept == "", 0).otherwise(power)


def double_from_text(text: Column) -> tuple[Column, Column]:
    """A finite number whose shortest decimal form is the text's value; minus zero becomes zero. Digits and powers of
    ten are compared as text, so numbers of any size are decided exactly."""
    bare = F.trim(text)
    value = bare.try_cast("double")
    (digits, power), (back, back_power) = _digits(bare), _digits(value.cast("string"))
    good = bare.rlike(NUMBER) & value.isNotNull() & (F.abs(value) < float("inf")) & (digits == back) & (power == back_power)
    return F.when(good, value + F.lit(0.0)), text.isNotNull() & ~F.coalesce(good, F.lit(False))


def bool_from_text(text: Column) -> tuple[Column, Column]:
    value = F.when(text == "true", True).when(text == "false", False)
    return value, text.isNotNull() & value.isNull()


def date_from_text(text: Column) -> tuple[Column, Column]:
    """Just `YYYY-MM-DD`."""
    value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    return value, text.isNotNull() & value.isNull()


def timestamp_from_text(text: Column, unit: str = "us", utc: bool = True) -> tuple[Column, Column]:
    """`YYYY-MM-DDTHH:MM:SS[.fraction]`, with an offset if and only if `utc`; digits beyond the unit must be zero."""
    zone = r"(Z|[+-]\d{2}:?\d{2})" if utc else ""
    m = lambda i: F.regexp_extract(text, rf"^(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}})(\.\d+)?{zone}$", i)
    places = {"ms": 3, "us": 6}[unit]
    fraction = F.rpad(F.regexp_replace(m(2), r"^\.", ""), F.greatest(F.length(m(2)), F.lit(7)), F.lit("0"))
    fine = F.substring(fraction, places + 1, 1000).rlike("[1-9]")
    shown = F.concat(m(1), F.lit("."), F.left(fraction, F.lit(6)), F.regexp_replace(m(3), r"([+-]\d{2}):?(\d{2})", "$1:$2") if utc else F.lit(""))
    value = F.when((m(1) != "") & ~fine & ~F.substring(m(1), 18, 2).rlike("[6-9]."), shown.try_cast("timestamp" if utc else "timestamp_ntz"))
    return value, text.isNotNull() & value.isNull()


def binary_from_text(text: Column) -> tuple[Column, Column]:
    """Strict base64."""
    ok = text.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    value = F.when(ok, F.unbase64(text))
    return value, text.isNotNull() & value.isNull()


def empty_cells(text: Column, policy: str) -> tuple[Column, Column]:
    """What an empty cell of a bulk file is: `null`, `string` (an empty text), or `reject` (bad)."""
    value = F.when(text == "", None).otherwise(text) if policy == "null" else text
    return value, (text == "") if policy == "reject" else F.lit(False)
