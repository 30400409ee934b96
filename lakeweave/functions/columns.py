"""Column-returning helpers (macros and scalar functions, P4 P5 F*).

All of them build Catalyst expressions, so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zpad(s: Column, n: int) -> Column:
    """Left-pad with zeros to at least ``n`` characters. Unlike plain ``lpad``
    it never cuts a longer value, so ids stay unique at any scale."""
    s = s.cast("string")
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def surrogate_key(cols: Iterable[str | Column]) -> Column:
    """md5 of the '|'-joined values, NULL spelled '_null_'."""
    parts = [F.coalesce(col_(c).cast("string"), F.lit("_null_")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def safe_divide(num: str | Column, den: str | Column) -> Column:
    """P5: 0.0 when the denominator is 0 or NULL; a NULL numerator stays NULL."""
    n, d = col_(num), col_(den)
    return F.when(d.isNull() | (d == 0), F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def uuid_from_md5(s: Column) -> Column:
    """UUID-shaped 8-4-4-4-12 hex string from md5(s)."""
    h = F.md5(s)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def ts_lit(value: str | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (the fixtures use NTZ timestamps). Built from
    text: a Python datetime literal would pass through the process and the
    session time zones and shift in a non-UTC session."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    else:
        value = dt.datetime.fromisoformat(value).isoformat(sep=" ")  # validate, normalise
    return F.lit(value).cast("timestamp_ntz")


def since(ts: str | Column, days: int, now: str | dt.datetime) -> Column:
    """``ts >= now - INTERVAL days``; ``now`` is injected, never the clock."""
    return col_(ts) >= ts_lit(now) - F.make_interval(days=F.lit(days))


# Interval arithmetic on TIMESTAMP_NTZ without a detour through the session
# time zone (a cast to TIMESTAMP, or date_trunc, would apply it).
EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(ts: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ts_lit(EPOCH_NTZ), col_(ts))


def from_epoch_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, ts_lit(EPOCH_NTZ))


def bucket_number(ts: str | Column, seconds: int) -> Column:
    """Epoch-aligned bucket number, in exact integer arithmetic (a double
    division would round a timestamp just before a boundary into the next
    bucket)."""
    us = epoch_micros(ts)
    step = F.lit(seconds * 1_000_000)
    return ((us - F.pmod(us, step)) / step).cast("bigint")


def trunc_seconds(ts: str | Column, seconds: int) -> Column:
    """Start of the fixed ``seconds`` bucket containing ``ts`` (epoch aligned)."""
    us = epoch_micros(ts)
    return from_epoch_micros(us - F.pmod(us, F.lit(seconds * 1_000_000)))


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 86_400_000_000


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1_000_000


def truncate_bucket(c: str | Column, width: int) -> Column:
    """F12 ``truncate(col, width)`` partition transform for integers."""
    x = col_(c)
    return x - F.pmod(x, F.lit(width))


def row_hash(cols: Iterable[str]) -> Column:
    """Stable content hash of a row (NULL-safe), for append-only checks."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


# Regular expressions for personal data and secrets, shared by the
# PII scanner, redaction and column tagging.
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SSN_RE = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
CARD_RE = r"\b(?:[0-9][ -]?){13,16}\b"
PHONE_RE = r"\+?[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?"
UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
