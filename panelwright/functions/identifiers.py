"""Instrument identifiers and calendar dates in one canonical form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Exchange suffixes and the code they stand for.
EXCHANGE_CODES = {"XSHE": "SZ", "XSHG": "SH", "XBEJ": "BJ"}

# First digit of a bare six-digit code and its exchange (any other digit is SZ).
SHANGHAI_DIGITS = ("6", "9")
BEIJING_DIGITS = ("4", "8")


# Characters trimmed from identifiers.
BLANKS = " \t\n\r\f\v"


def normalise_symbol(symbol: Column) -> Column:
    """``CODE.EXCH`` from suffixed, prefixed or bare codes; anything else is returned trimmed.

    One rule set serves both feeds, so identifiers of all exchanges join. NULL stays NULL.
    """
    return canonical_symbol(F.btrim(symbol.cast("string"), F.lit(BLANKS)))


def canonical_symbol(s: Column) -> Column:
    """`normalise_symbol` of a text without blanks around it. Branches repeat the text, so it is built from cheap string functions only."""
    suffix = F.substring_index(s, ".", -1)
    known = F.create_map(*[F.lit(x) for pair in EXCHANGE_CODES.items() for x in pair])
    exchange = F.coalesce(F.try_element_at(known, F.upper(suffix)), F.upper(suffix))
    before_suffix = F.left(s, F.length(s) - F.length(suffix) - F.lit(1))
    prefix = F.upper(F.left(s, F.lit(2)))
    first = F.left(s, F.lit(1))
    bare = (F.length(s) == 6) & s.rlike("^[0-9]{6}$")
    inferred = (
        F.when(first.isin(*SHANGHAI_DIGITS), ".SH").when(first.isin(*BEIJING_DIGITS), ".BJ").otherwise(".SZ")
    )
    return (
        F.when(s.contains("."), F.concat_ws(".", before_suffix, exchange))
        .when(prefix.isin("SH", "SZ", "BJ"), F.concat_ws(".", F.substring(s, F.lit(3), F.length(s)), prefix))
        .when(bare, F.concat(s, inferred))
        .otherwise(s)
    )


DAY_NANOS = 86_400_000_000_000


def normalise_date(value: Column, kind: str | None = None) -> Column:
    """Day-precision date; what is not a date becomes NULL instead of failing the job.

    Tried in turn, on the value as text: yyyyMMdd (also as a number), nanoseconds since 1970 (as a 64-bit number), and ISO or
    slashed dates with or without a time. `kind` is the column's type where known: dates and timestamps are only cast.
    """
    if kind == "date" or (kind or "").startswith("timestamp"):
        return value.cast("date")
    s = F.btrim(value.cast("string"), F.lit(BLANKS))
    compact = F.concat_ws("-", F.substring(s, F.lit(1), F.lit(4)), F.substring(s, F.lit(5), F.lit(2)), F.substring(s, F.lit(7), F.lit(2)))
    nanos = s.try_cast("bigint")
    day = ((nanos - F.pmod(nanos, F.lit(DAY_NANOS))) / F.lit(DAY_NANOS)).try_cast("int")
    return (
        F.when(s.rlike("^[0-9]{8}$"), compact.try_cast("date"))
        .when(s.rlike("^[0-9]{16,19}$"), F.date_from_unix_date(day))
        .otherwise(F.replace(s, F.lit("/"), F.lit("-")).try_cast("date"))
    )
