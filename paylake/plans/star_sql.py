"""The star fact as SQL: the common table expressions of the oracles."""

from __future__ import annotations

from paylake.plans import domain as D
from paylake.plans import star as S

CUR_LIST = D._sql_list(D.CURRENCIES)
RATES_SQL = "rates AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', 'USD', CAST({r} * {m} AS DECIMAL(18,8)), DATE '{day}')"
    for day, m in S.RATE_EPOCHS for c, r in S.SEED_RATES_TO_USD) + ") v(from_currency, to_currency, rate, effective_date))"
STG_SQL = f"""stg AS (
  SELECT * FROM (
    SELECT l_orderkey * 10 + l_linenumber AS transaction_sk, 'tx_' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS transaction_id,
           o_custkey AS customer_sk, l_suppkey AS merchant_sk,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
           {CUR_LIST}[l_orderkey % 8 + 1] AS currency_code,
           CASE WHEN l_linestatus = 'F' THEN 'captured' ELSE 'authorized' END AS status,
           CAST(CAST(l_discount AS DECIMAL(4,2)) * 10 AS DECIMAL(5,4)) AS fraud_score,
           {D._sql_list(D.DEVICE_TYPES)}[l_partkey % 5 + 1] AS device_type, CAST((l_partkey + l_linenumber) % 2 AS INTEGER) AS is_3d_secure,
           CAST(l_discount AS DECIMAL(4,2)) AS discount, l_shipdate AS created_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  QUALIFY row_number() OVER (PARTITION BY transaction_id
          ORDER BY created_at DESC, amount DESC, customer_sk DESC, merchant_sk DESC, currency_code DESC,
                   status DESC, fraud_score DESC, device_type DESC, is_3d_secure DESC, discount DESC) = 1)"""
STG_REFUNDS_SQL = """stg_refunds AS (
  SELECT * FROM (
    SELECT 'rf_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS refund_id,
           'tx_' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS transaction_id,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS amount,
           CASE WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'pending' END AS status, l_shipdate AS created_at
    FROM lineitem WHERE l_returnflag = 'R')
  QUALIFY row_number() OVER (PARTITION BY refund_id ORDER BY created_at DESC, amount DESC, status DESC) = 1)"""
STG_DISPUTES_SQL = """stg_disputes AS (
  SELECT * FROM (
    SELECT 'dp_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS dispute_id,
           'tx_' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS transaction_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
           CASE WHEN l_linestatus = 'F' THEN 'lost' ELSE 'under_review' END AS status, l_shipdate AS created_at
    FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.095)
  QUALIFY row_number() OVER (PARTITION BY dispute_id ORDER BY created_at DESC, amount DESC, status DESC) = 1)"""
FACT_FULL_SQL = f"""rf AS (SELECT transaction_id, MAX(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) AS refunded,
                SUM(CASE WHEN status = 'succeeded' THEN amount END) AS refunded_amount
         FROM stg_refunds GROUP BY 1),
dp AS (SELECT transaction_id, COUNT(*) AS n_disputes, MAX(CASE WHEN status = 'lost' THEN 1 ELSE 0 END) AS dispute_lost
       FROM stg_disputes GROUP BY 1),
iv AS (SELECT from_currency, rate, effective_date,
              lead(effective_date) OVER (PARTITION BY from_currency, to_currency ORDER BY effective_date) AS valid_to
       FROM rates WHERE to_currency = 'USD'),
full_fact AS (
  SELECT s.transaction_sk, s.transaction_id, s.customer_sk, s.merchant_sk, s.currency_code, s.amount, s.device_type, s.is_3d_secure, s.discount,
         CASE WHEN s.currency_code = 'USD' THEN CAST(1 AS DECIMAL(18,8)) ELSE iv.rate END AS fx_rate,
         CASE WHEN dp.n_disputes > 0 THEN 'disputed' WHEN rf.refunded = 1 THEN 'refunded' ELSE s.status END AS status,
         s.fraud_score, s.created_at, CAST(s.created_at AS DATE) AS transaction_date,
         COALESCE(rf.refunded_amount, CAST(0 AS DECIMAL(18,2))) AS refunded_amount,
         COALESCE(dp.dispute_lost, 0) AS dispute_lost
  FROM stg s LEFT JOIN rf ON s.transaction_id = rf.transaction_id
             LEFT JOIN dp ON s.transaction_id = dp.transaction_id
             LEFT JOIN iv ON s.currency_code = iv.from_currency AND CAST(s.created_at AS DATE) >= iv.effective_date
                          AND (iv.valid_to IS NULL OR CAST(s.created_at AS DATE) < iv.valid_to))"""
STAR_FACT = """
SELECT transaction_sk, transaction_id, customer_sk, merchant_sk, currency_code, amount,
       CAST(amount * fx_rate AS DECIMAL(18,2)) AS amount_usd, fx_rate, status, fraud_score, device_type, is_3d_secure,
       CASE WHEN status = 'captured' THEN CAST(CAST(amount * fx_rate AS DECIMAL(18,2)) * (1 - discount) AS DECIMAL(18,4))
            ELSE CAST(0 AS DECIMAL(18,4)) END AS revenue_usd,
       CASE WHEN fraud_score >= 0.7 THEN 1 ELSE 0 END AS is_high_fraud_risk,
       refunded_amount, dispute_lost, transaction_date,
       CAST(year(transaction_date) * 10000 + month(transaction_date) * 100 + day(transaction_date) AS INTEGER) AS date_sk
FROM full_fact"""

STAR_SQL = f"star AS ({STAR_FACT})"
# what the reports read
FACT_SQL = """fact_transaction AS (
  SELECT s.transaction_sk, s.transaction_id, s.customer_sk, s.merchant_sk, s.amount_usd, f.discount, s.fraud_score, s.is_high_fraud_risk,
         s.status, s.revenue_usd, f.created_at AS transaction_ts, s.transaction_date, s.device_type, s.is_3d_secure, s.currency_code
  FROM star s JOIN full_fact f ON s.transaction_sk = f.transaction_sk)"""

D.CTES.update({"stg": STG_SQL, "rates": RATES_SQL, "stg_refunds": STG_REFUNDS_SQL, "stg_disputes": STG_DISPUTES_SQL,
               "full_fact": FACT_FULL_SQL, "star": STAR_SQL, "fact_transaction": FACT_SQL})
D.NEEDS.update({"full_fact": ["stg", "stg_refunds", "stg_disputes", "rates"], "star": ["full_fact"], "fact_transaction": ["star"]})
