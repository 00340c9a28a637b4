"""Scalar column expressions used by the dataset recipes and transforms.

All are native ``pyspark.sql.functions`` expressions (whole-stage codegen,
no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip01(col: Column | str) -> Column:
    """Clip to [0, 1] (null stays null)."""
    x = _c(col).cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(x, F.lit(1.0))))


def round_9(x: Column) -> Column:
    """``round(x, 9)``, the same number, without a decimal per row: inside (-1, 1) and clear
    of a tie the nearest integer of 1e9 x is exact, and so is its quotient. ``x`` should be
    a column, as it is read several times."""
    v = x * F.lit(1e9)
    clear = (F.abs(x) < 1.0) & (F.abs(v - F.floor(v).cast("double") - 0.5) > 1e-6)
    return F.when(clear, F.floor(v + 0.5).cast("double") / F.lit(1e9)).otherwise(F.round(x, 9))


def target_equals(col: Column | str, value) -> Column:
    """1 when the column equals the literal, else 0 (null -> 0)."""
    return F.when(_c(col) == F.lit(value), 1).otherwise(0).cast("int")


def target_shift(col: Column | str, by: int = -1) -> Column:
    """Target + by (statlog stores 1/2)."""
    return (_c(col) + F.lit(by)).cast("int")


def target_positive(col: Column | str) -> Column:
    """(x > 0) as int; callers filter null targets first."""
    return (_c(col).cast("double") > 0).cast("int")


def positive_flag(col: Column | str) -> Column:
    """text/number > 0 as a boolean level; null or unparsable -> false."""
    return F.coalesce(_c(col).cast("string").try_cast("double") > 0, F.lit(False))


def percent_to_double(col: Column | str) -> Column:
    """B10: '12.5%' -> 12.5; numbers pass through; blank/unparsable -> null."""
    text = F.trim(_c(col).cast("string"))
    return F.regexp_replace(text, "%$", "").try_cast("double")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days later - earlier, floored like pandas ``.dt.days``."""
    secs = (F.unix_timestamp(_c(later).cast("timestamp"))
            - F.unix_timestamp(_c(earlier).cast("timestamp")))
    return F.floor(secs / F.lit(86400)).cast("int")


def parse_date(col: Column | str, fmt: str | None = None) -> Column:
    """A4: text -> timestamp, null when unparsable (never raises under ANSI)."""
    c = _c(col).cast("string")
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


#: One-letter escapes and what they stand for.
ESCAPES = {"a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b", "\\": "\\", "'": "'", '"': '"', "\n": ""}
_ESCAPE = (r"(?s)(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|\\U00[01][0-9A-Fa-f]{5}|\\[0-7]{1,3}|\\.|[^\\]+|\\")


def decode_escapes(col: Column | str) -> Column:
    """A3: text with ``\\xNN``, ``\\uNNNN``, ``\\UNNNNNNNN``, octal and one-letter escapes
    decoded; neighbouring ``\\u`` escapes may form a surrogate pair. Unknown or broken
    escapes stay as they are."""
    c = _c(col).cast("string")

    def char(t: Column) -> Column:
        utf16 = lambda digits: F.decode(F.unhex(digits), "UTF-16BE")
        simple = F.lit(None).cast("string")
        for letter, value in ESCAPES.items():
            simple = F.when(F.substring(t, 2, 1) == F.lit(letter), F.lit(value)).otherwise(simple)
        kind = F.substring(t, 1, 2)
        return (F.when(~F.startswith(t, F.lit("\\")) | (F.length(t) == 1), t)
                .when((kind == "\\u") & (F.length(t) > 2), utf16(F.replace(t, F.lit("\\u"), F.lit(""))))
                .when((kind == "\\x") & (F.length(t) == 4), utf16(F.concat(F.lit("00"), F.substring(t, 3, 2))))
                .when((kind == "\\U") & (F.length(t) == 10), F.decode(F.unhex(F.substring(t, 3, 8)), "UTF-32"))
                .when(t.rlike(r"^\\[0-7]{1,3}$"), utf16(F.lpad(F.conv(F.substring(t, 2, 3), 8, 16), 4, "0")))
                .otherwise(F.coalesce(simple, t)))

    tokens = F.regexp_extract_all(c, F.lit(_ESCAPE), F.lit(0))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(tokens, char), "")).otherwise(c)
