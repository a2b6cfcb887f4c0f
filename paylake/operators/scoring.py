"""Rule scoring, decisions, batch model scoring, canary split."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
# Rule-based fraud score of the scoring service: base score, then
# (reason, condition, increment) in evaluation order; decision cut-offs.
BASE_SCORE = Decimal("0.10")
HIGH_RISK_COUNTRIES = ["NG", "RU"]
RULES = [
    ("high_amount", "amount > 1000", Decimal("0.15")),
    ("very_high_amount", "amount > 5000", Decimal("0.20")),
    ("high_velocity_24h", "tx_count_24h > 10", Decimal("0.25")),
    ("velocity_anomaly", "velocity_score > 0.7", Decimal("0.15")),
    ("high_customer_risk", "risk_score > 0.5", Decimal("0.20")),
    ("high_risk_country", "ip_country in (NG, RU)", Decimal("0.15")),
]
APPROVE_BELOW = 0.3
REVIEW_BELOW = 0.7
FRAUD_THRESHOLD = 0.5


def _conditions(amount: Column, tx24: Column, velocity: Column, risk: Column, country: Column) -> list[Column]:
    return [amount > 1000, amount > 5000, tx24 > 10, velocity > 0.7, risk > 0.5,
            country.isNotNull() & country.isin(*HIGH_RISK_COUNTRIES)]


# M10 -----------------------------------------------------------------
def rule_score(df: DataFrame, amount: str = "amount_usd", tx24: str = "tx_count_24h",
               velocity: str = "velocity_score", risk: str = "risk_score",
               country: str = "ip_country") -> DataFrame:
    """Deterministic rule score in decimal arithmetic (the source's random
    +-0.02 noise is dropped), clamped to [0, 1], plus ordered reason codes."""
    conds = _conditions(F.col(amount), F.coalesce(F.col(tx24), F.lit(0)),
                        F.coalesce(F.col(velocity), F.lit(0.0)), F.coalesce(F.col(risk), F.lit(0.0)),
                        F.col(country))
    score = F.lit(BASE_SCORE).cast("decimal(5,2)")
    for cond, (_, _, inc) in zip(conds, RULES):
        score = score + F.when(cond, F.lit(inc)).otherwise(F.lit(Decimal("0")))
    score = F.least(F.greatest(score, F.lit(Decimal("0"))), F.lit(Decimal("1"))).cast("decimal(5,4)")
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, (name, _, _) in zip(conds, RULES)]),
                       lambda x: x.isNotNull())
    return df.withColumns({"score": score, "reasons": reasons})


# M11 -----------------------------------------------------------------
def decide(score, lo: float = APPROVE_BELOW, hi: float = REVIEW_BELOW) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < lo, "approve").when(s < hi, "review").otherwise("block")


# M13 -----------------------------------------------------------------
def score_batch(df: DataFrame, model, version: str, inputs: list[str],
                threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """Apply a fitted ``PipelineModel`` to its raw ``inputs``; the pipeline
    engineers the features, exactly as in training (unparseable or missing
    inputs count as 0). Probability rounded to 4 dp, fraud when the
    *unrounded* probability is >= threshold; a null probability is not fraud
    and gets version 'error'."""
    from pyspark.ml.functions import vector_to_array

    absent = {f: F.lit(None).cast("string") for f in inputs if f not in df.columns}
    scored = model.transform(df.withColumns(absent) if absent else df)
    p = vector_to_array(F.col("probability")).getItem(1)
    out = scored.withColumn("_p", p)
    keep = [c for c in df.columns]
    return out.select(
        *keep,
        F.round(F.col("_p"), 4).cast("decimal(5,4)").alias("fraud_probability"),
        F.coalesce(F.col("_p") >= threshold, F.lit(False)).alias("is_fraud_predicted"),
        F.when(F.col("_p").isNull(), F.lit("error")).otherwise(F.lit(version)).alias("model_version"))


# M14 -----------------------------------------------------------------
def canary_bucket(id_col) -> Column:
    """Stable 0..99 bucket of an id (first 32 bits of its MD5)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))


def canary(df: DataFrame, id_col: str, pct: int = 5, current: str = "current", candidate: str = "canary") -> DataFrame:
    return df.withColumn("model_route", F.when(canary_bucket(id_col) < pct, candidate).otherwise(current))
