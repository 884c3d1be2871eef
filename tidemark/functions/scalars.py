"""Small numeric, hashing and string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(value: Column) -> Column:
    """Two decimals, half to even; noise past ten decimals cannot tip a tie.

    Only large numbers and those near a tie are rounded as decimals, which costs many times as much.
    """
    hundredths = value * 100
    from_tie = F.abs(F.abs(hundredths - F.floor(hundredths)) - 0.5)
    return F.when((F.abs(value) < 1e6) & (from_tie > 1e-6), F.rint(hundredths) / 100 + F.lit(0.0)).otherwise(F.bround(F.round(value, 10), 2))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, truncated toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def other_side(term_a: Column, term_b: Column, known: Column) -> Column:
    """The member of a pair that is not ``known``."""
    return F.when(term_a == known, term_b).otherwise(term_a)


def md5_hex(text: Column) -> Column:
    return F.md5(text)


def conjunction(term: Column) -> Column:
    """``a b`` → ``(a AND b)``."""
    return F.concat(F.lit("("), F.replace(term, F.lit(" "), F.lit(" AND ")), F.lit(")"))


def session_url(session_id: Column, session_type: str, request_type: str) -> Column:
    # Fixed value: the address of the session page.
    return F.concat(
        F.lit("443/logmining/?sessionid="), session_id,
        F.lit(f"&sessionType={session_type}&requestType={request_type}"),
    )
