"""Projection / filter helpers.

Filters are written on the raw scan column where possible so that Catalyst
pushes them into the Parquet scan (``PushedFilters``) and prunes row groups.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylake.functions.scalar import _c


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d))


def window_bounds(as_of, n: int, unit: str = "day") -> tuple[dt.datetime, dt.datetime]:
    """[as_of - n units, as_of + 1 day) as naive datetimes (start of day)."""
    a = _as_date(as_of)
    if unit.startswith("day"):
        lo = a - dt.timedelta(days=n)
    elif unit.startswith("month"):
        m = a.month - 1 - n
        y = a.year + m // 12
        m = m % 12 + 1
        import calendar
        lo = dt.date(y, m, min(a.day, calendar.monthrange(y, m)[1]))
    else:
        raise ValueError(unit)
    hi = a + dt.timedelta(days=1)
    return dt.datetime(lo.year, lo.month, lo.day), dt.datetime(hi.year, hi.month, hi.day)


# P01 ------------------------------------------------------------------
def lookback(df: DataFrame, col: str, as_of, n: int, unit: str = "day",
             bounded: bool = True) -> DataFrame:
    """Rows with ``col`` on or after ``as_of - n`` (and not after ``as_of``).

    The reference compares with "now", so it never sees future rows; with an
    explicit ``as_of`` the upper bound keeps replays point-in-time. Bounds are
    literals of the column's own type so the predicate reaches the scan.
    """
    lo, hi = window_bounds(as_of, n, unit)
    dtype = dict(df.dtypes)[col]
    if dtype == "date":
        lo_l, hi_l = F.lit(lo.date()), F.lit(hi.date())
    elif dtype == "timestamp_ntz":
        lo_l, hi_l = F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")
    else:
        lo_l, hi_l = F.lit(lo).cast(dtype), F.lit(hi).cast(dtype)
    cond = F.col(col) >= lo_l
    if bounded:
        cond = cond & (F.col(col) < hi_l)
    return df.filter(cond)


# P02 ------------------------------------------------------------------
def on_day(df: DataFrame, ts: str, day) -> DataFrame:
    d = _as_date(day)
    lo = dt.datetime(d.year, d.month, d.day)
    hi = lo + dt.timedelta(days=1)
    dtype = dict(df.dtypes)[ts]
    cast = "timestamp_ntz" if dtype == "timestamp_ntz" else "timestamp"
    return df.filter((F.col(ts) >= F.lit(lo).cast(cast)) & (F.col(ts) < F.lit(hi).cast(cast)))


# P03 ------------------------------------------------------------------
def member_of(col, values) -> Column:
    return _c(col).isin(list(values))


# P05 ------------------------------------------------------------------
def safe_ratio(num, den) -> Column:
    return F.try_divide(_c(num).cast("double"), F.nullif(_c(den), F.lit(0)).cast("double"))


# P07 ------------------------------------------------------------------
def with_default(col, default) -> Column:
    return F.coalesce(_c(col), F.lit(default))


# P08 ------------------------------------------------------------------
NUMERIC_FEATURES = ["amt", "lat", "long", "merch_lat", "merch_long"]
INTEGER_FEATURES = ["city_pop", "unix_time"]


def coerce_features(df: DataFrame, required=None) -> DataFrame:
    """Numeric coercion: bad values -> null; integer features null -> 0.

    A missing required column is an error, raised at plan time.
    """
    required = list(required or (NUMERIC_FEATURES[:3] + ["city_pop", "unix_time"] + NUMERIC_FEATURES[3:]))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df
    for c in NUMERIC_FEATURES:
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("string").try_cast("double"))
    for c in INTEGER_FEATURES:
        if c in df.columns:
            out = out.withColumn(
                c, F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).cast("long"))
    return out


# P09 ------------------------------------------------------------------
OPEN_STATUSES = ("pending", "failed", "disputed")


def open_statuses(df: DataFrame, status_col: str = "status") -> DataFrame:
    return df.filter(F.col(status_col).isin(*OPEN_STATUSES))


def risky(df: DataFrame, score_col: str = "fraud_score", cut: float = 0.5) -> DataFrame:
    return df.filter(F.col(score_col) > F.lit(cut))


# P10 ------------------------------------------------------------------
def live(df: DataFrame, deleted_col: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(deleted_col).isNull())


# P11 ------------------------------------------------------------------
def split_rejected(df: DataFrame, col: str = "status") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(col).isNotNull()), df.filter(F.col(col).isNull())
