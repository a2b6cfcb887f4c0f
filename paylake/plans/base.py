"""What the query modules register with: the two tables of queries and SQL, table access, date windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paylake.plans import domain as D
from paylake.plans import star_sql  # noqa: F401  (its table expressions)

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def _in_utc(fn: Builder) -> Builder:
    """Build the plan with the session time zone set to UTC, then restore the
    caller's setting. The driver tables hold zone-less timestamps; the few
    derivations that turn them into instants (unix seconds, watermarked
    windows) must read them as UTC, as the oracle does. Spark binds the zone
    into each expression when the plan is analysed, so the built DataFrame
    keeps UTC semantics after the setting is restored."""
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = "spark.sql.session.timeZone"
        before = spark.conf.get(key)
        spark.conf.set(key, "UTC")
        try:
            return fn(spark, sf_dir)
        finally:
            spark.conf.set(key, before)
    wrapped.__name__ = getattr(fn, "__name__", "query")
    wrapped.__doc__ = fn.__doc__
    return wrapped


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = _in_utc(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def T(spark, sf_dir) -> D.Tables:
    return D.Tables(spark, sf_dir)


def _window(col: str, as_of: str, days: int) -> str:
    return (f"{col} >= CAST(DATE '{as_of}' - INTERVAL {days} DAY AS TIMESTAMP) "
            f"AND {col} < CAST(DATE '{as_of}' + INTERVAL 1 DAY AS TIMESTAMP)")


AS_TX, AS_EV, AS_IN = D.AS_OF_TX, D.AS_OF_EVENTS, D.AS_OF_INGEST
