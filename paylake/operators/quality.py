"""Data-quality rules.

A rule is a named Column that yields an error message or null. Rules of a
check are combined into an array with the nulls removed, so one pass over
the data produces every error of every record, in rule order. All checks are
plain expressions inside whole-stage codegen; no Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
# Required fields and error message formats of the reference validator
# (French wording kept so dead-letter messages read the same).
REQUIRED_FIELDS = ["trans_num", "amt", "cc_num", "merchant", "category"]
MSG_MISSING = "Champ manquant ou null: {field}"
MSG_AMOUNT_NOT_NUMERIC = "Montant non numérique: {value}"
MSG_AMOUNT_NOT_POSITIVE = "Montant <= 0: {value}"
MSG_AMOUNT_TOO_LARGE = "Montant suspect (> 50k): {value}"
MSG_COORD_NOT_NUMERIC = "{field} non numérique: {value}"
MSG_COORD_OUT_OF_RANGE = "{field} hors limites: {value}"
MSG_CARD_TOO_SHORT = "N° carte trop court: {value}"
MSG_PROBA_NULL = "Probabilité null"
MSG_PROBA_RANGE = "Probabilité hors [0,1]: {value}"
AMOUNT_MAX = 50000
COORDINATE_BOUNDS = [("lat", -90, 90), ("long", -180, 180), ("merch_lat", -90, 90), ("merch_long", -180, 180)]
CARD_MIN_LENGTH = 13
MIN_PASS_RATE = 0.95
MAX_NULL_RATIO = 0.05
# Accepted values declared by the operational schema.
ACCEPTED_VALUES = {
    "kyc_status": ["pending", "verified", "rejected", "suspended"],
    "business_type": ["company", "individual", "nonprofit", "government"],
    "merchant_status": ["active", "suspended", "terminated"],
    "method_type": ["card", "bank_account", "wallet", "crypto"],
    "tx_status": ["pending", "authorized", "captured", "failed", "refunded", "disputed"],
    "device_type": ["mobile", "desktop", "tablet", "api", "other"],
    "refund_status": ["pending", "succeeded", "failed"],
    "dispute_status": ["needs_response", "under_review", "won", "lost"],
}
CLICK_EVENT_TYPES = ["page_view", "click", "form_submit", "checkout_start",
                     "checkout_complete", "checkout_abandon", "payment_method_select"]
CLICK_REQUIRED = ["event_type", "session_id", "timestamp"]
ALERT_REQUIRED = ["transaction_id", "score", "created_at"]
ALERT_DECISIONS = ["approve", "review", "block"]


# Messages of one record are joined with this separator and split back into
# an array: concat_ws/split stay inside whole-stage codegen, whereas a
# higher-order ``filter(array, x -> x is not null)`` is evaluated
# interpreted and drags every rule expression out of generated code.
SEP = "\u001f"


def _fmt(template: str, field: str | None = None, value: Column | None = None) -> Column:
    """Message template -> Column; ``{value}`` is the raw value as text (a
    separator character inside an untrusted value is replaced by a space)."""
    t = template.replace("{field}", field or "")
    if "{value}" not in t:
        return F.lit(t)
    pre, post = t.split("{value}", 1)
    return F.concat(F.lit(pre), F.translate(value.cast("string"), SEP, " "), F.lit(post))


@dataclass
class Rule:
    name: str
    message: Column  # error text or null


def _num(c: Column) -> Column:
    return c.cast("string").try_cast("double")


# V01 -----------------------------------------------------------------
def rule_required(df: DataFrame, fields=REQUIRED_FIELDS) -> list[Rule]:
    """Present and non-null; an empty string passes. A column missing from
    the frame fails on every row."""
    out = []
    for f in fields:
        msg = _fmt(MSG_MISSING, f)
        cond = F.col(f).isNull() if f in df.columns else F.lit(True)
        out.append(Rule(f"required_{f}", F.when(cond, msg)))
    return out


# V02 -----------------------------------------------------------------
def rule_amount(col: str = "amt", hi: float = AMOUNT_MAX, typed: str | None = None) -> list[Rule]:
    """Non-numeric, <= 0, > hi (hi itself passes). Null is skipped. ``typed``
    names a column that already holds the number.

    NaN passes the reference check silently (all comparisons false); here it
    is rejected as non-numeric.
    """
    raw = F.col(col)
    v = F.col(typed) if typed else _num(raw)
    bad = raw.isNotNull() & (v.isNull() | F.isnan(v))
    return [
        Rule("amount_numeric", F.when(bad, _fmt(MSG_AMOUNT_NOT_NUMERIC, value=raw))),
        Rule("amount_positive", F.when(~bad & (v <= 0), _fmt(MSG_AMOUNT_NOT_POSITIVE, value=raw))),
        Rule("amount_max", F.when(~bad & (v > hi), _fmt(MSG_AMOUNT_TOO_LARGE, value=raw))),
    ]


# V03 -----------------------------------------------------------------
def rule_coordinates(df: DataFrame | None = None, bounds=COORDINATE_BOUNDS, typed: dict[str, str] | None = None) -> list[Rule]:
    out = []
    for field, lo, hi in bounds:
        if df is not None and field not in df.columns:
            continue
        raw = F.col(field)
        v = F.col(typed[field]) if typed and field in typed else _num(raw)
        msg = (F.when(raw.isNull(), None)
               .when(v.isNull(), _fmt(MSG_COORD_NOT_NUMERIC, field, raw))
               .when(F.isnan(v) | ~v.between(lo, hi), _fmt(MSG_COORD_OUT_OF_RANGE, field, raw)))
        out.append(Rule(f"range_{field}", msg))
    return out


# V04 -----------------------------------------------------------------
def rule_min_length(col: str = "cc_num", n: int = CARD_MIN_LENGTH) -> list[Rule]:
    raw = F.col(col)
    return [Rule(f"min_length_{col}", F.when(raw.isNotNull() & (F.length(raw.cast("string")) < n),
                                             _fmt(MSG_CARD_TOO_SHORT, value=raw)))]


def schema_rules(df: DataFrame) -> list[Rule]:
    return rule_required(df)


NUMERIC_FIELDS = ["amt", *[f for f, _, _ in COORDINATE_BOUNDS]]


def typed_fields(df: DataFrame) -> dict[str, str]:
    return {c: f"_num_{c}" for c in NUMERIC_FIELDS if c in df.columns}


def business_rules(df: DataFrame, typed: dict[str, str] | None = None) -> list[Rule]:
    rules = []
    if "amt" in df.columns:
        rules += rule_amount("amt", typed=(typed or {}).get("amt"))
    rules += rule_coordinates(df, typed=typed)
    if "cc_num" in df.columns:
        rules += rule_min_length("cc_num")
    return rules


def messages_of(rules: list[Rule]) -> Column:
    """Non-null messages of ``rules`` in rule order, joined by ``SEP``
    ('' when there is none)."""
    if not rules:
        return F.lit("")
    return F.concat_ws(SEP, *[r.message for r in rules])


def split_messages(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, SEP))


def errors_of(rules: list[Rule]) -> Column:
    """Non-null messages of ``rules`` in rule order, as array<string>."""
    return split_messages(messages_of(rules))


# V05 -----------------------------------------------------------------
def validate(df: DataFrame) -> DataFrame:
    """Adds ``schema_errors``, ``rule_errors``, ``errors`` (schema first) and
    ``data_quality_status`` valid/rejected.

    Numbers are parsed once, in a projection of typed columns that the rules
    read; the two joined message strings are produced once, by a generator of
    one row: Catalyst pushes a filter on the status through projections, and
    would put every rule into it once more, but not through a generator."""
    typed = typed_fields(df)
    x = df.withColumns({t: _num(F.col(c)) for c, t in typed.items()}) if typed else df
    m = x.select("*", F.inline(F.array(F.struct(messages_of(schema_rules(df)).alias("_schema_msg"),
                                                messages_of(business_rules(df, typed)).alias("_rule_msg")))))
    out = m.withColumns({
        "schema_errors": split_messages(F.col("_schema_msg")),
        "rule_errors": split_messages(F.col("_rule_msg")),
        "data_quality_status": F.when((F.col("_schema_msg") == "") & (F.col("_rule_msg") == ""), "valid")
                                .otherwise("rejected"),
    })
    out = out.withColumn("errors", F.concat("schema_errors", "rule_errors"))
    return out.select(*df.columns, "schema_errors", "rule_errors", "errors", "data_quality_status")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (validated.filter(F.col("data_quality_status") == "valid"),
            validated.filter(F.col("data_quality_status") == "rejected"))


def verdict(df: DataFrame, key: str = "trans_num") -> DataFrame:
    v = validate(df)
    return v.select(key, "data_quality_status", F.size("errors").alias("n_errors"),
                    F.array_join("errors", "; ").alias("error_message"))


# V06 -----------------------------------------------------------------
def rule_probability(col: str = "fraud_probability") -> list[Rule]:
    p = F.col(col).cast("double")
    return [Rule("probability", F.when(p.isNull(), F.lit(MSG_PROBA_NULL))
                 .when(F.isnan(p) | ~p.between(0.0, 1.0), _fmt(MSG_PROBA_RANGE, value=p)))]


# V07 -----------------------------------------------------------------
def dq_log(validated: DataFrame, key: str = "trans_num", execution_date=None) -> DataFrame:
    """One row per record and check (schema, business rules) with the pass
    flag and the errors as JSON."""
    checks = F.array(
        F.struct(F.lit("schema_validation").alias("check_name"), F.lit("schema").alias("check_type"),
                 F.col("schema_errors").alias("errs")),
        F.struct(F.lit("business_rules").alias("check_name"), F.lit("rule").alias("check_type"),
                 F.col("rule_errors").alias("errs")))
    x = validated.select(F.col(key), F.explode(checks).alias("c"))
    passed = F.size("c.errs") == 0
    return x.select(
        F.col(key), F.col("c.check_name").alias("check_name"), F.col("c.check_type").alias("check_type"),
        passed.alias("passed"),
        F.to_json(F.struct(F.col("c.errs").alias("errors"))).alias("details"),
        F.lit(1).alias("records_checked"),
        F.when(passed, 1).otherwise(0).alias("records_passed"),
        F.when(passed, 1.0).otherwise(0.0).cast("decimal(5,4)").alias("pass_rate"),
        (F.lit(execution_date).cast("timestamp") if execution_date else F.current_timestamp()).alias("execution_date"))


def dq_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("check_name", "check_type").agg(
        F.sum("records_checked").cast("long").alias("records_checked"),
        F.sum("records_passed").cast("long").alias("records_passed"),
        F.round(F.sum("records_passed").cast("double") / F.sum("records_checked"), 4)
         .cast("decimal(5,4)").alias("pass_rate"))


# V08 -----------------------------------------------------------------
def quality_gate(validated: DataFrame, columns: list[str], min_pass: float = MIN_PASS_RATE,
                 max_null: float = MAX_NULL_RATIO) -> DataFrame:
    """One-row gate: pass rate, worst null ratio over ``columns``, verdict."""
    n = F.count(F.lit(1))
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(f"_n_{c}") for c in columns]
    g = validated.agg(n.alias("n"), F.sum((F.col("data_quality_status") == "valid").cast("long")).alias("n_valid"), *nulls)
    ratio = F.greatest(*[F.col(f"_n_{c}") / F.col("n") for c in columns]) if len(columns) > 1 \
        else F.col(f"_n_{columns[0]}") / F.col("n")
    g = g.select(F.col("n").alias("records"),
                 F.round(F.col("n_valid") / F.nullif(F.col("n"), F.lit(0)), 4).alias("pass_rate"),
                 F.round(ratio, 4).alias("max_null_ratio"))
    return g.withColumn("passed", (F.col("pass_rate") >= min_pass) & (F.col("max_null_ratio") <= max_null))


# V09-V11 ------------------------------------------------------------
def rule_accepted(col: str, values) -> Rule:
    return Rule(f"accepted_{col}", F.when(F.col(col).isNotNull() & ~F.col(col).isin(*values),
                                          F.concat(F.lit(f"{col} not accepted: "), F.col(col).cast("string"))))


def rule_range(col: str, lo=None, hi=None, lo_open: bool = False) -> Rule:
    c = F.col(col)
    bad = F.lit(False)
    if lo is not None:
        bad = bad | ((c <= lo) if lo_open else (c < lo))
    if hi is not None:
        bad = bad | (c > hi)
    return Rule(f"range_{col}", F.when(c.isNotNull() & bad, F.concat(F.lit(f"{col} out of range: "), c.cast("string"))))


def rule_length(col: str, n: int) -> Rule:
    return Rule(f"length_{col}", F.when(F.col(col).isNotNull() & (F.length(col) != n),
                                        F.concat(F.lit(f"{col} length != {n}: "), F.col(col))))


def rule_report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_name, n_checked, n_failed) for every rule, in one aggregation
    pass over ``df`` followed by an unpivot of the single result row."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(F.when(r.message.isNotNull(), 1).otherwise(0)).cast("long").alias(f"_f{i}")
             for i, r in enumerate(rules)]
    g = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule_name"), F.col(f"_f{i}").alias("n_failed"))
                                for i, r in enumerate(rules)]))
    return g.select(F.col("_n").alias("n_checked"), stack.alias("r")).select(
        "r.rule_name", "n_checked", "r.n_failed")


def gate_row_count(df: DataFrame, lo: int, hi: int | None = None, name: str = "row_count") -> DataFrame:
    n = F.count(F.lit(1))
    ok = (n >= lo) if hi is None else ((n >= lo) & (n <= hi))
    return df.agg(F.lit(name).alias("gate"), n.alias("n_rows"), ok.alias("passed"))


# V12 -----------------------------------------------------------------
def duplicates(df: DataFrame, key) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies")).filter(F.col("n_copies") > 1)


def key_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(key_name, n_duplicate_keys, n_rows) of every unique key declared."""
    out = None
    for name, (df, keys) in tables.items():
        row = duplicates(df, keys).agg(F.count(F.lit(1)).alias("n_duplicate_keys"),
                                       F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n_rows")) \
            .select(F.lit(name).alias("key_name"), "n_duplicate_keys", "n_rows")
        out = row if out is None else out.unionAll(row)
    return out


# V13 -----------------------------------------------------------------
def rule_one_of(col: str, values, name: str) -> Rule:
    return Rule(f"enum_{name}", F.when(~F.col(col).isin(*values), F.lit(f"{name} not accepted")))


def validate_clickstream(docs: DataFrame, json_col: str, schema) -> DataFrame:
    return validate_document(docs, json_col, schema, CLICK_REQUIRED, [rule_one_of("doc.event_type", CLICK_EVENT_TYPES, "event_type")])


def validate_alerts(docs: DataFrame, json_col: str, schema) -> DataFrame:
    s = F.col("doc.score")
    return validate_document(docs, json_col, schema, ALERT_REQUIRED, [
        Rule("range_score", F.when((s < 0) | (s > 1), F.lit("score out of range"))),
        rule_one_of("doc.decision", ALERT_DECISIONS, "decision")])


def validate_document(docs: DataFrame, json_col: str, schema, required: list[str],
                      rules: list[Rule]) -> DataFrame:
    """Parse a JSON document column with an explicit schema and check it.

    Unparseable documents and missing required keys become errors, not job
    failures (permissive parse).
    """
    parsed = docs.withColumn("doc", F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE"}))
    req = [Rule(f"required_{k}", F.when(F.col(f"doc.{k}").isNull(), F.lit(f"missing required key: {k}")))
           for k in required]
    errs = errors_of(req + list(rules))
    return parsed.withColumn("errors", errs).withColumn(
        "valid", F.size("errors") == 0)
