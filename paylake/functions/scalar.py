"""Scalar column functions. All JVM-side expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F01 ------------------------------------------------------------------
def month_start(d) -> Column:
    return F.trunc(_c(d), "MM")


def month_offset(start, end) -> Column:
    """Month boundaries crossed from ``start`` to ``end`` (Jan-31 -> Feb-01 = 1).

    Not ``months_between``/``datediff(MONTH)``, which count whole months.
    """
    s, e = _c(start), _c(end)
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


# F02 ------------------------------------------------------------------
def shift(d, n: int, unit: str = "day") -> Column:
    unit = unit.lower().rstrip("s")
    if unit == "day":
        return F.date_add(_c(d), n)
    if unit == "month":
        return F.add_months(_c(d), n)
    if unit == "year":
        return F.add_months(_c(d), 12 * n)
    if unit in ("hour", "minute", "second"):
        return _c(d) + F.expr(f"INTERVAL {int(n)} {unit.upper()}S")
    raise ValueError(f"unsupported unit {unit}")


# F03 ------------------------------------------------------------------
def day(ts) -> Column:
    return F.to_date(_c(ts))


# F04 ------------------------------------------------------------------
def hour_of_day(unix_seconds) -> Column:
    return F.floor(F.pmod(_c(unix_seconds), F.lit(86400)) / 3600)


def hour_cyclic(unix_seconds) -> tuple[Column, Column]:
    h = hour_of_day(unix_seconds)
    ang = h * F.lit(2 * math.pi) / 24
    return F.sin(ang), F.cos(ang)


# F05 ------------------------------------------------------------------
def degree_distance(lat, lon, lat2, lon2) -> Column:
    """Plain Euclidean distance in degrees, as the reference computes it."""
    return F.sqrt(F.pow(_c(lat) - _c(lat2), 2) + F.pow(_c(lon) - _c(lon2), 2))


# F06 ------------------------------------------------------------------
def log_amount(amt) -> Column:
    """log(1 + amt); null where undefined (amt <= -1)."""
    return F.log1p(_c(amt))


# F07 ------------------------------------------------------------------
def round_half_up(x, scale: int = 0) -> Column:
    return F.round(_c(x), scale)


def round_half_even(x, scale: int = 0) -> Column:
    return F.bround(_c(x), scale)


def round_avg(x, scale: int) -> Column:
    """Mean rounded to ``scale`` via a fixed 6-dp decimal step.

    Used for averages of decimal money/scores so the result does not depend
    on summation order (exact decimal sum, then HALF_UP).
    """
    return F.round(F.avg(_c(x)).cast("decimal(18,6)"), scale)


# F08 ------------------------------------------------------------------
def nullif(x, v) -> Column:
    return F.nullif(_c(x), F.lit(v) if not isinstance(v, Column) else v)


# F09 ------------------------------------------------------------------
def clamp(x, lo=None, hi=None) -> Column:
    out = _c(x)
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return out


# F10 ------------------------------------------------------------------
def sha256_hex(x) -> Column:
    return F.sha2(_c(x).cast("string"), 256)


# F11 ------------------------------------------------------------------
def bucket(x, n: int) -> Column:
    """0 .. n-1 from the first 32 bits of the value's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(_c(x).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n))


def pick(values: list, idx) -> Column:
    """0-based index into a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), _c(idx).cast("int") + 1)


def pad(x, n: int, ch: str = "0") -> Column:
    return F.lpad(_c(x).cast("string"), n, ch)


# F12 ------------------------------------------------------------------
def mask_card(cc) -> Column:
    s = _c(cc).cast("string")
    return F.concat(F.lit("***"), F.right(s, F.lit(4)))


# F13 ------------------------------------------------------------------
def json_field(c, path: str) -> Column:
    if not path.startswith("$"):
        path = "$." + path
    return F.get_json_object(_c(c), path)


def json_object(*cols) -> Column:
    return F.to_json(F.struct(*[_c(c) for c in cols]))


# F14 ------------------------------------------------------------------
def contains(arr, v) -> Column:
    return F.array_contains(_c(arr), v)


def size(arr) -> Column:
    return F.size(_c(arr))


# F15 ------------------------------------------------------------------
def to_number(x, default=None, dtype: str = "double") -> Column:
    v = _c(x).cast("string").try_cast(dtype)
    return F.coalesce(v, F.lit(default).cast(dtype)) if default is not None else v
