"""DuckDB oracle SQL for every registered query.

``BASE`` restates the driver-table mapping of ``lapsewise.sources.driver``
and the master join in plain SQL; each oracle appends one final SELECT.
Hygiene (SURVEY §7.4): doubles rounded to 6 digits, integers as BIGINT,
timestamps as text, deterministic tie-breaks with ``row_number``.
"""

from __future__ import annotations

import math

MONTHS = 6


def base(months: int = MONTHS) -> str:
    return f"""
WITH
ship AS (
  SELECT l_orderkey AS order_id, min(l_shipdate) AS carrier, max(l_shipdate) AS delivered
  FROM lineitem GROUP BY l_orderkey),
m_orders AS (
  SELECT o_orderkey AS order_id, o_orderkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp, o_orderdate AS order_approved_at,
         s.carrier AS order_delivered_carrier_date, s.delivered AS order_delivered_customer_date,
         o_orderdate + INTERVAL 1860 DAY AS order_estimated_delivery_date
  FROM orders LEFT JOIN ship s ON s.order_id = o_orderkey),
m_customers AS (
  SELECT o_orderkey AS customer_id,
         CASE WHEN o_orderkey % 10 = 0 THEN o_custkey ELSE -1 - o_orderkey END AS customer_unique_id,
         n_name AS customer_state, r_name AS customer_city
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey),
m_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_extendedprice AS price, l_extendedprice * l_tax AS freight_value
  FROM lineitem),
m_payments AS (
  SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
         l_returnflag AS payment_type, CAST(l_quantity AS INTEGER) AS payment_installments,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS payment_value,
         l_partkey AS tb_partkey, l_suppkey AS tb_suppkey, l_quantity AS tb_quantity,
         l_extendedprice AS tb_price, l_shipdate AS tb_shipdate
  FROM lineitem),
m_products AS (SELECT p_partkey AS product_id, p_brand AS product_category_name FROM part),
m_translation AS (
  SELECT DISTINCT p_brand AS product_category_name,
         lower(replace(p_brand, '#', '_')) AS product_category_name_english
  FROM part WHERE NOT p_brand LIKE '%3'),
m_reviews AS (
  SELECT 3 * d.doc_id + k AS review_id,
         CASE k WHEN 0 THEN 15 * d.doc_id WHEN 1 THEN 15 * d.doc_id + 7 ELSE 15 * (d.doc_id + 1) END AS order_id,
         CAST(coalesce(1 + 2 * l.quality + 2 * (1 - l.toxic),
                       CASE WHEN d.doc_id % 11 <> 0 THEN 1 + (d.doc_id + k) % 5 END) AS INTEGER) AS review_score,
         d.text AS review_comment_message,
         CASE WHEN (3 * d.doc_id + k) % 7 <> 0
              THEN TIMESTAMP '1995-01-01 00:00:00'
                   + to_days(CAST(((3 * d.doc_id + k) * 7919) % 2000 AS INTEGER))
         END AS review_answer_timestamp
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, range(3) AS copies(k)),
items_cat AS (
  SELECT i.*, t.product_category_name_english AS cat
  FROM m_items i LEFT JOIN m_products p ON i.product_id = p.product_id
                 LEFT JOIN m_translation t ON p.product_category_name = t.product_category_name),
cat_mode AS (
  SELECT order_id, cat FROM (
    SELECT order_id, cat,
           row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, cat) AS rn
    FROM items_cat WHERE cat IS NOT NULL GROUP BY order_id, cat) WHERE rn = 1),
items_agg AS (
  SELECT a.order_id, a.item_count, a.total_item_price, a.total_freight,
         m.cat AS product_category_english
  FROM (SELECT order_id, count(order_item_id) AS item_count,
               coalesce(sum(price), 0.0) AS total_item_price,
               coalesce(sum(freight_value), 0.0) AS total_freight
        FROM items_cat GROUP BY order_id) a
  LEFT JOIN cat_mode m ON a.order_id = m.order_id),
pay_agg AS (
  SELECT a.order_id, a.payment_value, a.payment_installments, f.payment_type
  FROM (SELECT order_id, coalesce(sum(payment_value), 0.0) AS payment_value,
               max(payment_installments) AS payment_installments
        FROM m_payments GROUP BY order_id) a
  LEFT JOIN (SELECT order_id, payment_type FROM (
               SELECT order_id, payment_type,
                      row_number() OVER (PARTITION BY order_id ORDER BY
                        payment_sequential NULLS FIRST, tb_partkey NULLS FIRST,
                        tb_suppkey NULLS FIRST, tb_quantity NULLS FIRST,
                        tb_price NULLS FIRST, tb_shipdate NULLS FIRST) AS rn
               FROM m_payments) WHERE rn = 1) f ON a.order_id = f.order_id),
rev_latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY
             (review_answer_timestamp IS NULL) DESC, review_answer_timestamp DESC, review_id DESC) AS rn
    FROM m_reviews) WHERE rn = 1),
master AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp,
         o.order_approved_at, o.order_delivered_carrier_date, o.order_delivered_customer_date,
         o.order_estimated_delivery_date,
         c.customer_unique_id, c.customer_state, c.customer_city,
         r.review_score, r.review_comment_message,
         i.item_count, i.total_item_price, i.total_freight, i.product_category_english,
         p.payment_value, p.payment_installments, p.payment_type
  FROM m_orders o
  LEFT JOIN rev_latest r ON o.order_id = r.order_id
  LEFT JOIN items_agg i ON o.order_id = i.order_id
  LEFT JOIN pay_agg p ON o.order_id = p.order_id
  LEFT JOIN m_customers c ON o.customer_id = c.customer_id),
cutoff AS (
  SELECT max(order_purchase_timestamp) - INTERVAL {int(months)} MONTH AS cutoff FROM m_orders),
win AS (
  SELECT * FROM master WHERE order_purchase_timestamp < (SELECT cutoff FROM cutoff)),
cnt AS (
  SELECT customer_unique_id, count(DISTINCT order_id) AS orders_placed
  FROM win WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id),
labelled AS (
  SELECT w.*, c.orders_placed, coalesce(c.orders_placed = 1, false) AS churned
  FROM win w LEFT JOIN cnt c ON w.customer_unique_id = c.customer_unique_id)
"""


def q(final: str, months: int = MONTHS) -> str:
    return base(months) + final


ORACLES: dict[str, str] = {}


def oracle(name: str, months: int = MONTHS):
    def deco(fn):
        ORACLES[name] = q(fn(), months)
        return fn
    return deco


@oracle("churn_rate_customer")
def _():
    return """
SELECT count(*) AS customers, CAST(sum(c) AS BIGINT) AS churned_customers,
       CAST(sum(1 - c) AS BIGINT) AS retained_customers, round(avg(c), 6) AS churn_rate
FROM (SELECT customer_unique_id, max(CAST(churned AS INTEGER)) AS c
      FROM labelled GROUP BY customer_unique_id)"""


@oracle("churn_label_orders")
def _():
    return """
SELECT order_id, customer_unique_id, orders_placed, churned FROM labelled"""


@oracle("observation_window")
def _():
    return """
SELECT order_id, customer_id, CAST(order_purchase_timestamp AS VARCHAR) AS order_purchase_timestamp,
       CAST((SELECT cutoff FROM cutoff) AS VARCHAR) AS cutoff
FROM m_orders WHERE order_purchase_timestamp < (SELECT cutoff FROM cutoff)"""


@oracle("observation_window_stored")
def _():
    return """
SELECT order_id, customer_id, CAST(order_purchase_timestamp AS VARCHAR) AS order_purchase_timestamp,
       CAST((SELECT cutoff FROM cutoff) AS VARCHAR) AS cutoff
FROM m_orders WHERE order_purchase_timestamp < (SELECT cutoff FROM cutoff)"""


WRITTEN_TABLES = {
    "orders": ("m_orders", ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
                            "order_delivered_carrier_date", "order_delivered_customer_date",
                            "order_estimated_delivery_date")),
    "order_items": ("m_items", ("order_id", "order_item_id", "product_id", "price", "freight_value")),
    "products": ("m_products", ("product_id", "product_category_name")),
    "category_translation": ("m_translation", ("product_category_name", "product_category_name_english")),
}


@oracle("written_figures")
def _():
    parts = [f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, "
             f"CAST({len(columns)} AS BIGINT) AS cols, count(*) - count({c}) AS null_count FROM {source}"
             for name, (source, columns) in WRITTEN_TABLES.items() for c in columns]
    return "\n" + "\nUNION ALL ".join(parts)


@oracle("censoring_report")
def _():
    return """
SELECT count(*) AS orders_before, count(DISTINCT customer_unique_id) AS customers_before,
       count(*) FILTER (WHERE order_purchase_timestamp < (SELECT cutoff FROM cutoff)) AS orders_after,
       count(DISTINCT customer_unique_id) FILTER (WHERE order_purchase_timestamp < (SELECT cutoff FROM cutoff)) AS customers_after,
       count(DISTINCT customer_unique_id)
         - count(DISTINCT customer_unique_id) FILTER (WHERE order_purchase_timestamp < (SELECT cutoff FROM cutoff)) AS customers_removed,
       round((count(DISTINCT customer_unique_id)
         - count(DISTINCT customer_unique_id) FILTER (WHERE order_purchase_timestamp < (SELECT cutoff FROM cutoff)))
         / greatest(count(DISTINCT customer_unique_id), 1), 6) AS removed_share
FROM master"""


@oracle("items_per_order")
def _():
    return """
SELECT order_id, item_count, round(total_item_price, 6) AS total_item_price,
       round(total_freight, 6) AS total_freight, product_category_english
FROM items_agg"""


@oracle("modal_category")
def _():
    return """
SELECT order_id, product_category_english FROM items_agg"""


@oracle("payments_per_order")
def _():
    return """
SELECT order_id, round(payment_value, 6) AS payment_value,
       CAST(payment_installments AS BIGINT) AS payment_installments, payment_type
FROM pay_agg"""


@oracle("latest_review")
def _():
    return """
SELECT order_id, review_id, CAST(review_score AS BIGINT) AS review_score,
       CAST(review_answer_timestamp AS VARCHAR) AS review_answer_timestamp
FROM rev_latest"""


@oracle("order_master_join")
def _():
    return """
SELECT order_id, customer_id, order_status,
       CAST(order_purchase_timestamp AS VARCHAR) AS order_purchase_timestamp,
       CAST(order_approved_at AS VARCHAR) AS order_approved_at,
       CAST(order_delivered_carrier_date AS VARCHAR) AS order_delivered_carrier_date,
       CAST(order_delivered_customer_date AS VARCHAR) AS order_delivered_customer_date,
       CAST(order_estimated_delivery_date AS VARCHAR) AS order_estimated_delivery_date,
       customer_unique_id, customer_state, customer_city,
       CAST(review_score AS BIGINT) AS review_score, review_comment_message,
       item_count, round(total_item_price, 6) AS total_item_price,
       round(total_freight, 6) AS total_freight, product_category_english,
       round(payment_value, 6) AS payment_value,
       CAST(payment_installments AS BIGINT) AS payment_installments, payment_type
FROM master"""


# --- features, imputation, encoding -------------------------------------------------

BEH = """,
beh AS (
  SELECT *,
    (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400000000.0 AS delivery_delay_days,
    coalesce((epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) > 0, false) AS is_late_delivery,
    (epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0 AS days_to_delivery,
    CASE WHEN payment_value > 0 THEN total_freight / payment_value END AS freight_ratio,
    coalesce(item_count = 1, false) AS is_single_item
  FROM labelled),
meds AS (
  SELECT median(delivery_delay_days) AS m_delay, median(days_to_delivery) AS m_days,
         median(review_score) AS m_rs, median(total_freight) AS m_tf,
         median(payment_value) AS m_pv, median(payment_installments) AS m_pi
  FROM beh),
imp0 AS (
  SELECT b.* REPLACE (
    coalesce(delivery_delay_days, m_delay) AS delivery_delay_days,
    coalesce(days_to_delivery, m_days) AS days_to_delivery,
    coalesce(CAST(review_score AS DOUBLE), m_rs) AS review_score,
    coalesce(freight_ratio, 0.0) AS freight_ratio,
    coalesce(total_freight, m_tf) AS total_freight,
    coalesce(payment_value, m_pv) AS payment_value,
    coalesce(CAST(payment_installments AS DOUBLE), m_pi) AS payment_installments)
  FROM beh b CROSS JOIN meds),
imp AS (
  SELECT * REPLACE (coalesce(delivery_delay_days > 0, false) AS is_late_delivery,
                    coalesce(item_count = 1, false) AS is_single_item)
  FROM imp0),
topcat AS (
  SELECT product_category_english AS lvl FROM labelled
  WHERE product_category_english IS NOT NULL
  GROUP BY product_category_english ORDER BY count(*) DESC, product_category_english LIMIT 15),
grp AS (
  SELECT *, CASE WHEN product_category_english IN (SELECT lvl FROM topcat)
                 THEN product_category_english ELSE 'other' END AS product_category_grouped
  FROM imp),
lv AS (
  SELECT src, lvl FROM (
    SELECT src, lvl, row_number() OVER (PARTITION BY src ORDER BY lvl) AS rn FROM (
      SELECT DISTINCT 'payment_type' AS src, payment_type AS lvl FROM grp WHERE payment_type IS NOT NULL
      UNION ALL SELECT DISTINCT 'customer_state', customer_state FROM grp WHERE customer_state IS NOT NULL
      UNION ALL SELECT DISTINCT 'product_category_grouped', product_category_grouped FROM grp))
  WHERE rn > 1),
dummies AS (
  SELECT g.order_id, lv.src || '_' || lv.lvl AS feature,
         CAST(coalesce(CASE lv.src WHEN 'payment_type' THEN g.payment_type
                                   WHEN 'customer_state' THEN g.customer_state
                                   ELSE g.product_category_grouped END = lv.lvl, false) AS DOUBLE) AS value
  FROM grp g CROSS JOIN lv)
"""


def qb(final: str, months: int = MONTHS) -> str:
    return base(months) + BEH + final


def _oracle_b(name):
    def deco(fn):
        ORACLES[name] = qb(fn())
        return fn
    return deco


@_oracle_b("behavioral_features")
def _():
    return """
SELECT order_id, round(delivery_delay_days, 6) AS delivery_delay_days, is_late_delivery,
       round(days_to_delivery, 6) AS days_to_delivery, round(freight_ratio, 6) AS freight_ratio,
       is_single_item
FROM beh"""


@_oracle_b("impute_median")
def _():
    return """
SELECT order_id, round(delivery_delay_days, 6) AS delivery_delay_days,
       round(days_to_delivery, 6) AS days_to_delivery, round(review_score, 6) AS review_score,
       round(freight_ratio, 6) AS freight_ratio, round(total_freight, 6) AS total_freight,
       round(payment_value, 6) AS payment_value, round(payment_installments, 6) AS payment_installments,
       is_late_delivery, is_single_item
FROM imp"""


BEH_COLUMNS = ("order_id customer_id order_status order_purchase_timestamp order_approved_at "
               "order_delivered_carrier_date order_delivered_customer_date "
               "order_estimated_delivery_date customer_unique_id customer_state customer_city "
               "review_score review_comment_message item_count total_item_price total_freight "
               "product_category_english payment_value payment_installments payment_type "
               "orders_placed churned delivery_delay_days is_late_delivery days_to_delivery "
               "freight_ratio is_single_item").split()


@_oracle_b("null_audit")
def _():
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
             f"round(count(*) FILTER (WHERE {c} IS NULL) / greatest(count(*), 1), 6) AS null_share FROM beh"
             for c in BEH_COLUMNS]
    return "\n" + "\nUNION ALL ".join(parts)


SUMMARY = ("delivery_delay_days", "is_late_delivery", "days_to_delivery", "freight_ratio",
           "is_single_item", "payment_installments", "review_score")


@_oracle_b("feature_summary")
def _():
    parts = [f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
             f"round(median(CAST({c} AS DOUBLE)), 6) AS median, "
             f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
             f"round(count(*) FILTER (WHERE {c} IS NULL) / greatest(count(*), 1), 6) AS null_share FROM beh"
             for c in SUMMARY]
    return "\n" + "\nUNION ALL ".join(parts)


@_oracle_b("top_categories")
def _():
    return """
SELECT product_category_english AS level, count(*) AS n,
       row_number() OVER (ORDER BY count(*) DESC, product_category_english) AS rank
FROM labelled WHERE product_category_english IS NOT NULL
GROUP BY product_category_english ORDER BY count(*) DESC, product_category_english LIMIT 15"""


@_oracle_b("rare_level_group")
def _():
    return """
SELECT order_id, product_category_grouped FROM grp"""


@_oracle_b("one_hot")
def _():
    return """
SELECT order_id, feature, value FROM dummies"""


MATRIX_NUMERIC = ("review_score", "item_count", "total_freight", "payment_value",
                  "payment_installments", "delivery_delay_days", "is_late_delivery",
                  "days_to_delivery", "freight_ratio", "is_single_item")


@_oracle_b("feature_matrix")
def _():
    parts = [f"SELECT order_id, '{c}' AS feature, round(CAST({c} AS DOUBLE), 6) AS value FROM grp"
             for c in MATRIX_NUMERIC]
    parts.append("SELECT order_id, 'label' AS feature, CAST(churned AS DOUBLE) AS value FROM grp")
    parts.append("SELECT order_id, feature, value FROM dummies")
    return "\n" + "\nUNION ALL ".join(parts)


# --- exploratory aggregates ---------------------------------------------------------

SEG = "CASE WHEN churned THEN 'Churned' ELSE 'Retained' END"


def _hist_sql(src: str, value: str) -> str:
    return f"""
, d AS ({src}),
rng AS (SELECT segment, count(*) AS total,
               CASE WHEN max(v) > min(v) THEN min(v) ELSE min(v) - 0.5 END AS lo,
               CASE WHEN max(v) > min(v) THEN max(v) ELSE max(v) + 0.5 END AS hi
        FROM d GROUP BY segment),
h AS (SELECT d.segment,
             CAST(least(greatest(floor((v - lo) * 60.0 / (hi - lo)), 0), 59) AS BIGINT) AS bin,
             count(*) AS n
      FROM d JOIN rng ON d.segment = rng.segment GROUP BY 1, 2)
SELECT h.segment, bin, round(lo + bin * ((hi - lo) / 60.0), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / 60.0), 6) AS bin_hi, n,
       round(n / (total * ((hi - lo) / 60.0)), 6) AS density
FROM h JOIN rng ON h.segment = rng.segment"""


EXPLORE = {
    "review_score_counts": """
SELECT CAST(review_score AS BIGINT) AS review_score, count(*) AS n
FROM labelled WHERE review_score IS NOT NULL GROUP BY review_score""",
    "score_share_by_segment": f"""
SELECT segment, review_score, n, round(n / sum(n) OVER (PARTITION BY segment), 6) AS proportion
FROM (SELECT {SEG} AS segment, CAST(review_score AS BIGINT) AS review_score, count(*) AS n
      FROM labelled WHERE review_score IS NOT NULL GROUP BY 1, 2)""",
    "score_share_pivot": f"""
SELECT review_score,
       round(max(CASE WHEN segment = 'Churned' THEN p END), 6) AS "Churned",
       round(max(CASE WHEN segment = 'Retained' THEN p END), 6) AS "Retained"
FROM (SELECT segment, review_score, n / sum(n) OVER (PARTITION BY segment) AS p
      FROM (SELECT {SEG} AS segment, CAST(review_score AS BIGINT) AS review_score, count(*) AS n
            FROM labelled WHERE review_score IS NOT NULL GROUP BY 1, 2))
GROUP BY review_score""",
    "punctuality": """
SELECT count(*) AS delivered_rows, count(delivery_delay_days) AS rows_with_delay,
       CAST(sum(CAST(coalesce(delivery_delay_days > 0, false) AS INTEGER)) AS BIGINT) AS late_n,
       round(avg(CAST(coalesce(delivery_delay_days > 0, false) AS INTEGER)), 6) AS late_share,
       CAST(sum(CAST(coalesce(delivery_delay_days <= 0, false) AS INTEGER)) AS BIGINT) AS early_n,
       round(avg(CAST(coalesce(delivery_delay_days <= 0, false) AS INTEGER)), 6) AS early_share
FROM beh WHERE order_status = 'F'""",
    "median_delay_by_segment": f"""
SELECT {SEG} AS segment, round(median(delivery_delay_days), 6) AS median_delivery_delay_days
FROM beh WHERE order_status = 'F' AND delivery_delay_days IS NOT NULL GROUP BY 1""",
    "delay_histogram": _hist_sql(
        f"SELECT {SEG} AS segment, greatest(least(delivery_delay_days, 60), -30) AS v FROM beh "
        "WHERE order_status = 'F' AND delivery_delay_days IS NOT NULL", "v"),
    "describe_by_segment": f"""
SELECT {SEG} AS segment, count(payment_value) AS count, round(avg(payment_value), 6) AS mean,
       round(stddev_samp(payment_value), 6) AS std, round(min(payment_value), 6) AS min,
       round(quantile_cont(payment_value, 0.25), 6) AS p25,
       round(quantile_cont(payment_value, 0.5), 6) AS p50,
       round(quantile_cont(payment_value, 0.75), 6) AS p75, round(max(payment_value), 6) AS max
FROM labelled GROUP BY 1""",
    "clip_quantile": f"""
SELECT order_id, l.segment, round(greatest(least(payment_value, cap), 0.0), 6) AS payment_value
FROM (SELECT *, {SEG} AS segment FROM labelled WHERE payment_value IS NOT NULL) l
JOIN (SELECT {SEG} AS segment, quantile_cont(payment_value, 0.99) AS cap
      FROM labelled WHERE payment_value IS NOT NULL GROUP BY 1) c ON l.segment = c.segment""",
    "payment_histogram": _hist_sql(f"""
SELECT l.segment, greatest(least(payment_value, cap), 0.0) AS v
FROM (SELECT *, {SEG} AS segment FROM labelled WHERE payment_value IS NOT NULL) l
JOIN (SELECT {SEG} AS segment, quantile_cont(payment_value, 0.99) AS cap
      FROM labelled WHERE payment_value IS NOT NULL GROUP BY 1) c ON l.segment = c.segment""", "v"),
    "customer_first_order": """
SELECT customer_unique_id, order_id, customer_state FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY
           (order_purchase_timestamp IS NULL), order_purchase_timestamp, order_id) AS rn
  FROM labelled) WHERE rn = 1""",
    "state_churn": """
SELECT customer_state, count(customer_unique_id) AS total_customers,
       CAST(sum(CAST(churned AS INTEGER)) AS BIGINT) AS churned_customers,
       round(sum(CAST(churned AS INTEGER)) / count(customer_unique_id), 6) AS churn_rate
FROM (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY
           (order_purchase_timestamp IS NULL), order_purchase_timestamp, order_id) AS rn
  FROM labelled) WHERE rn = 1)
GROUP BY customer_state""",
    "state_churn_topk": """
SELECT * FROM (
SELECT customer_state, count(customer_unique_id) AS total_customers,
       CAST(sum(CAST(churned AS INTEGER)) AS BIGINT) AS churned_customers,
       round(sum(CAST(churned AS INTEGER)) / count(customer_unique_id), 6) AS churn_rate
FROM (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY
           (order_purchase_timestamp IS NULL), order_purchase_timestamp, order_id) AS rn
  FROM labelled) WHERE rn = 1)
GROUP BY customer_state)
WHERE total_customers >= 100 ORDER BY churn_rate DESC, customer_state LIMIT 10""",
    "category_churn": """
SELECT product_category_english AS category, round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate,
       count(churned) AS order_count
FROM labelled WHERE product_category_english IN (SELECT lvl FROM topcat)
GROUP BY product_category_english""",
    "text_coverage": """
SELECT count(*) AS rows,
       CAST(sum(CAST(coalesce(regexp_matches(review_comment_message, '\\S'), false) AS INTEGER)) AS BIGINT) AS with_text,
       round(avg(CAST(coalesce(regexp_matches(review_comment_message, '\\S'), false) AS INTEGER)), 6) AS text_share,
       CAST(sum(1 - CAST(coalesce(regexp_matches(review_comment_message, '\\S'), false) AS INTEGER)) AS BIGINT) AS without_text
FROM labelled""",
    "comment_rate_by_segment": f"""
SELECT {SEG} AS segment,
       round(avg(CAST(coalesce(regexp_matches(review_comment_message, '\\S'), false) AS DOUBLE)), 6) AS comment_rate
FROM labelled GROUP BY 1""",
    "distinct_levels": """
SELECT 'payment_type' AS column_name, count(DISTINCT payment_type) AS levels FROM labelled
UNION ALL SELECT 'customer_state', count(DISTINCT customer_state) FROM labelled
UNION ALL SELECT 'product_category_english', count(DISTINCT product_category_english) FROM labelled""",
}

for _name, _final in EXPLORE.items():
    ORACLES[_name] = qb(_final)


# --- review text -------------------------------------------------------------------
# The lexicon tables below are generated from lapsewise.operators.text (same values).

TEXT = """,
lex(word, p, s) AS (VALUES
  ('good', 0.7, 0.6),
  ('great', 0.8, 0.75),
  ('excellent', 1.0, 1.0),
  ('best', 1.0, 0.3),
  ('perfect', 1.0, 1.0),
  ('love', 0.5, 0.6),
  ('happy', 0.8, 1.0),
  ('nice', 0.6, 1.0),
  ('fast', 0.2, 0.6),
  ('quick', 0.33, 0.5),
  ('recommend', 0.4, 0.5),
  ('satisfied', 0.5, 1.0),
  ('beautiful', 0.85, 1.0),
  ('easy', 0.43, 0.83),
  ('thanks', 0.2, 0.2),
  ('ok', 0.5, 0.5),
  ('bad', -0.7, 0.67),
  ('poor', -0.4, 0.6),
  ('terrible', -1.0, 1.0),
  ('awful', -1.0, 1.0),
  ('horrible', -1.0, 1.0),
  ('worst', -1.0, 1.0),
  ('worthless', -0.8, 0.9),
  ('stupid', -0.8, 1.0),
  ('idiot', -0.8, 1.0),
  ('disgusting', -1.0, 1.0),
  ('broken', -0.4, 0.4),
  ('damaged', -0.5, 0.5),
  ('late', -0.3, 0.6),
  ('slow', -0.3, 0.4),
  ('wrong', -0.5, 0.9),
  ('never', -0.1, 0.3),
  ('missing', -0.2, 0.05),
  ('angry', -0.5, 1.0),
  ('disappointed', -0.75, 0.75),
  ('useless', -0.5, 0.2),
  ('cheap', 0.1, 0.2),
  ('bom', 0.7, 0.6),
  ('boa', 0.7, 0.6),
  ('otimo', 0.8, 0.75),
  ('ótimo', 0.8, 0.75),
  ('excelente', 1.0, 1.0),
  ('perfeito', 1.0, 1.0),
  ('recomendo', 0.4, 0.5),
  ('ruim', -0.7, 0.67),
  ('péssimo', -1.0, 1.0),
  ('pessimo', -1.0, 1.0),
  ('horrível', -1.0, 1.0),
  ('atrasado', -0.3, 0.6),
  ('quebrado', -0.4, 0.4),
  ('bueno', 0.7, 0.6),
  ('malo', -0.7, 0.67),
  ('bien', 0.5, 0.5),
  ('mal', -0.5, 0.6),
  ('bon', 0.7, 0.6),
  ('mauvais', -0.7, 0.67),
  ('gut', 0.7, 0.6),
  ('schlecht', -0.7, 0.67)),
inten(word, m) AS (VALUES ('very', 1.3), ('really', 1.3), ('extremely', 1.5), ('so', 1.2), ('too', 1.2), ('quite', 1.1), ('muito', 1.3), ('muy', 1.3), ('très', 1.3), ('sehr', 1.3)),
negs(word) AS (VALUES ('not'), ('no'), ('never'), ('don''t'), ('isn''t'), ('wasn''t'), ('não'), ('nao'), ('nunca'), ('nem'), ('pas'), ('nicht'), ('kein'), ('keine')),
src AS (
  SELECT order_id AS k, review_comment_message AS txt FROM labelled
  WHERE coalesce(regexp_matches(review_comment_message, '\\S'), false)),
tk AS (
  SELECT k, unnest(toks) AS t, generate_subscripts(toks, 1) AS i
  FROM (SELECT k, regexp_extract_all(lower(txt), '[\\pL'']+') AS toks FROM src)),
tk2 AS (
  SELECT k, i, t, lag(t, 1) OVER w AS p1, lag(t, 2) OVER w AS p2
  FROM tk WINDOW w AS (PARTITION BY k ORDER BY i)),
sc AS (
  SELECT k,
    greatest(least(l.p * coalesce(n.m, 1.0)
      * CASE WHEN coalesce(tk2.p1 IN (SELECT word FROM negs), false)
               OR coalesce(tk2.p2 IN (SELECT word FROM negs), false) THEN -0.5 ELSE 1.0 END,
      1.0), -1.0) AS p,
    greatest(least(l.s * coalesce(n.m, 1.0), 1.0), 0.0) AS s
  FROM tk2 JOIN lex l ON tk2.t = l.word LEFT JOIN inten n ON tk2.p1 = n.word),
sagg AS (SELECT k, avg(p) AS pol, avg(s) AS subj FROM sc GROUP BY k),
sent AS (
  SELECT lb.*, coalesce(regexp_matches(review_comment_message, '\\S'), false) AS has_review_text,
         coalesce(a.pol, 0.0) AS sentiment_polarity, coalesce(a.subj, 0.0) AS sentiment_subjectivity
  FROM labelled lb LEFT JOIN sagg a ON lb.order_id = a.k),
oc AS (
  SELECT o.order_id, c.customer_unique_id FROM m_orders o JOIN m_customers c ON o.customer_id = c.customer_id),
one_order AS (SELECT customer_unique_id FROM oc GROUP BY customer_unique_id HAVING count(order_id) = 1),
neg AS (
  SELECT r.review_id, oc.order_id, oc.customer_unique_id, r.review_score, r.review_comment_message
  FROM oc JOIN m_reviews r ON oc.order_id = r.order_id
  WHERE oc.customer_unique_id IN (SELECT customer_unique_id FROM one_order)
    AND r.review_comment_message IS NOT NULL AND r.review_score <= 3)
"""


def qt(final: str, months: int = MONTHS) -> str:
    return base(months) + BEH + TEXT + final


_HASH = "md5('42:' || CAST({k} AS VARCHAR))"

TEXT_Q = {
    "sentiment_scores": """
SELECT order_id, has_review_text, round(sentiment_polarity, 6) AS sentiment_polarity,
       round(sentiment_subjectivity, 6) AS sentiment_subjectivity FROM sent""",
    "sentiment_by_segment": f"""
SELECT {SEG} AS segment,
       round(avg(CASE WHEN has_review_text THEN sentiment_polarity END), 6) AS polarity_text_rows,
       round(avg(sentiment_polarity), 6) AS polarity_all_rows,
       round(avg(CAST(has_review_text AS DOUBLE)), 6) AS text_rate
FROM sent GROUP BY 1""",
    "sentiment_describe": """
SELECT 'sentiment_polarity' AS feature, count(sentiment_polarity) AS count,
       round(avg(sentiment_polarity), 6) AS mean, round(stddev_samp(sentiment_polarity), 6) AS std,
       round(min(sentiment_polarity), 6) AS min, round(quantile_cont(sentiment_polarity, 0.25), 6) AS p25,
       round(quantile_cont(sentiment_polarity, 0.5), 6) AS p50,
       round(quantile_cont(sentiment_polarity, 0.75), 6) AS p75, round(max(sentiment_polarity), 6) AS max
FROM sent
UNION ALL
SELECT 'sentiment_subjectivity', count(sentiment_subjectivity),
       round(avg(sentiment_subjectivity), 6), round(stddev_samp(sentiment_subjectivity), 6),
       round(min(sentiment_subjectivity), 6), round(quantile_cont(sentiment_subjectivity, 0.25), 6),
       round(quantile_cont(sentiment_subjectivity, 0.5), 6),
       round(quantile_cont(sentiment_subjectivity, 0.75), 6), round(max(sentiment_subjectivity), 6)
FROM sent""",
    "review_sample": f"""
SELECT order_id, CAST(review_score AS BIGINT) AS review_score, review_comment_message
FROM labelled
WHERE churned AND review_score <= 3 AND coalesce(regexp_matches(review_comment_message, '\\S'), false)
ORDER BY {_HASH.format(k="order_id")}, order_id LIMIT 50""",
    "negative_churned_reviews": """
SELECT review_id, order_id, customer_unique_id, CAST(review_score AS BIGINT) AS review_score FROM neg""",
    "negative_review_sample": f"""
SELECT review_id, order_id, CAST(review_score AS BIGINT) AS review_score, review_comment_message
FROM neg ORDER BY {_HASH.format(k="review_id")}, review_id LIMIT 50""",
}

for _name, _final in TEXT_Q.items():
    ORACLES[_name] = qt(_final)


# --- split, metrics, thresholds, business ------------------------------------------

SCORE = """,
lab AS (SELECT order_id, customer_unique_id, CAST(churned AS INTEGER) AS label, item_count FROM labelled),
sp AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(order_id AS VARCHAR)), order_id)
                      <= ceil(count(*) OVER (PARTITION BY label) * CAST(0.2 AS DOUBLE))
                 THEN 'test' ELSE 'train' END AS fold
  FROM lab),
scored AS (
  SELECT *, (CAST(CAST(('0x' || substr(md5('7:' || CAST(order_id AS VARCHAR)), 1, 2)) AS BIGINT) AS DOUBLE)
             + CAST(100.0 AS DOUBLE) * CAST(coalesce(item_count = 1, false) AS INTEGER)) / CAST(355.0 AS DOUBLE) AS p_churn
  FROM sp),
test AS (SELECT * FROM scored WHERE fold = 'test'),
cnts AS (
  SELECT p_churn AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM test GROUP BY p_churn),
roc AS (
  SELECT s, pos, neg,
         sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
         sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
         sum(pos) OVER () AS P, sum(neg) OVER () AS N
  FROM cnts),
auc AS (
  SELECT CASE WHEN max(P) > 0 AND max(N) > 0
              THEN sum(pos * (N - cn + CAST(0.5 AS DOUBLE) * neg)) / (max(P) * max(N)) END AS roc_auc
  FROM roc),
roc_pts AS (
  SELECT s AS threshold, CASE WHEN N <> 0 THEN cn / N ELSE 0.0 END AS fpr,
         CASE WHEN P <> 0 THEN cp / P ELSE 0.0 END AS tpr FROM roc
  UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0),
youden AS (
  SELECT threshold, fpr, tpr, tpr - fpr AS j FROM roc_pts ORDER BY j DESC, threshold DESC LIMIT 1),
rcnts AS (
  SELECT CAST(1.0 AS DOUBLE) - p_churn AS s, count(*) FILTER (WHERE label = 0) AS pos,
         count(*) FILTER (WHERE label <> 0) AS neg
  FROM test GROUP BY 1),
pr AS (
  SELECT s AS threshold,
         CASE WHEN cp + cn <> 0 THEN cp / (cp + cn) ELSE 0.0 END AS precision,
         CASE WHEN P > 0 THEN cp / P ELSE 1.0 END AS recall
  FROM (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
               sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
               sum(pos) OVER () AS P FROM rcnts)),
pr_f1 AS (
  SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM pr),
grid(j, threshold) AS (VALUES (0, '0.05'::DOUBLE), (1, '0.060000000000000005'::DOUBLE), (2, '0.07'::DOUBLE), (3, '0.08000000000000002'::DOUBLE), (4, '0.09000000000000001'::DOUBLE), (5, '0.1'::DOUBLE), (6, '0.11000000000000001'::DOUBLE), (7, '0.12000000000000001'::DOUBLE), (8, '0.13'::DOUBLE), (9, '0.14'::DOUBLE), (10, '0.15000000000000002'::DOUBLE), (11, '0.16000000000000003'::DOUBLE), (12, '0.17000000000000004'::DOUBLE), (13, '0.18000000000000005'::DOUBLE), (14, '0.19'::DOUBLE), (15, '0.2'::DOUBLE), (16, '0.21000000000000002'::DOUBLE), (17, '0.22000000000000003'::DOUBLE), (18, '0.23000000000000004'::DOUBLE), (19, '0.24000000000000005'::DOUBLE), (20, '0.25000000000000006'::DOUBLE), (21, '0.26000000000000006'::DOUBLE), (22, '0.27'::DOUBLE), (23, '0.28'::DOUBLE), (24, '0.29000000000000004'::DOUBLE), (25, '0.30000000000000004'::DOUBLE), (26, '0.31000000000000005'::DOUBLE), (27, '0.32000000000000006'::DOUBLE), (28, '0.33'::DOUBLE), (29, '0.34'::DOUBLE), (30, '0.35000000000000003'::DOUBLE), (31, '0.36000000000000004'::DOUBLE), (32, '0.37000000000000005'::DOUBLE), (33, '0.38000000000000006'::DOUBLE), (34, '0.39000000000000007'::DOUBLE), (35, '0.4000000000000001'::DOUBLE), (36, '0.4100000000000001'::DOUBLE), (37, '0.42000000000000004'::DOUBLE), (38, '0.43000000000000005'::DOUBLE), (39, '0.44000000000000006'::DOUBLE), (40, '0.45000000000000007'::DOUBLE), (41, '0.4600000000000001'::DOUBLE), (42, '0.4700000000000001'::DOUBLE), (43, '0.4800000000000001'::DOUBLE), (44, '0.49000000000000005'::DOUBLE), (45, '0.5000000000000001'::DOUBLE), (46, '0.5100000000000001'::DOUBLE), (47, '0.5200000000000001'::DOUBLE), (48, '0.5300000000000001'::DOUBLE), (49, '0.5400000000000001'::DOUBLE), (50, '0.5500000000000002'::DOUBLE), (51, '0.5600000000000002'::DOUBLE), (52, '0.5700000000000002'::DOUBLE), (53, '0.5800000000000002'::DOUBLE), (54, '0.5900000000000002'::DOUBLE), (55, '0.6000000000000002'::DOUBLE), (56, '0.6100000000000001'::DOUBLE), (57, '0.6200000000000001'::DOUBLE), (58, '0.6300000000000001'::DOUBLE), (59, '0.6400000000000001'::DOUBLE), (60, '0.6500000000000001'::DOUBLE), (61, '0.6600000000000001'::DOUBLE), (62, '0.6700000000000002'::DOUBLE), (63, '0.6800000000000002'::DOUBLE), (64, '0.6900000000000002'::DOUBLE), (65, '0.7000000000000002'::DOUBLE), (66, '0.7100000000000002'::DOUBLE), (67, '0.7200000000000002'::DOUBLE), (68, '0.7300000000000002'::DOUBLE), (69, '0.7400000000000002'::DOUBLE), (70, '0.7500000000000002'::DOUBLE), (71, '0.7600000000000002'::DOUBLE), (72, '0.7700000000000002'::DOUBLE), (73, '0.7800000000000001'::DOUBLE), (74, '0.7900000000000001'::DOUBLE), (75, '0.8000000000000002'::DOUBLE), (76, '0.8100000000000002'::DOUBLE), (77, '0.8200000000000002'::DOUBLE), (78, '0.8300000000000002'::DOUBLE), (79, '0.8400000000000002'::DOUBLE), (80, '0.8500000000000002'::DOUBLE), (81, '0.8600000000000002'::DOUBLE), (82, '0.8700000000000002'::DOUBLE), (83, '0.8800000000000002'::DOUBLE), (84, '0.8900000000000002'::DOUBLE), (85, '0.9000000000000002'::DOUBLE), (86, '0.9100000000000003'::DOUBLE), (87, '0.9200000000000003'::DOUBLE), (88, '0.9300000000000002'::DOUBLE), (89, '0.9400000000000002'::DOUBLE), (90, '0.9500000000000002'::DOUBLE)),
sweep AS (
  SELECT j, threshold, tp, fp, pos - tp AS fn FROM (
    SELECT g.j, g.threshold,
           count(*) FILTER (WHERE t.label = 0 AND NOT (t.p_churn >= g.threshold)) AS tp,
           count(*) FILTER (WHERE t.label <> 0 AND NOT (t.p_churn >= g.threshold)) AS fp,
           count(*) FILTER (WHERE t.label = 0) AS pos
    FROM grid g CROSS JOIN test t GROUP BY g.j, g.threshold)),
sweep_m AS (
  SELECT j, threshold,
         CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
         CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM sweep),
cm AS (
  SELECT count(*) AS rows,
         count(*) FILTER (WHERE label = 1 AND p_churn >= 0.5) AS tp1,
         count(*) FILTER (WHERE label = 0 AND p_churn >= 0.5) AS fp1,
         count(*) FILTER (WHERE label = 0 AND NOT p_churn >= 0.5) AS tn1,
         count(*) FILTER (WHERE label = 1 AND NOT p_churn >= 0.5) AS fn1
  FROM test),
mets AS (
  SELECT CASE WHEN rows <> 0 THEN (tp1 + tn1) / rows ELSE 0.0 END AS accuracy,
         CASE WHEN tn1 + fn1 <> 0 THEN tn1 / (tn1 + fn1) ELSE 0.0 END AS precision,
         CASE WHEN tn1 + fp1 <> 0 THEN tn1 / (tn1 + fp1) ELSE 0.0 END AS recall,
         CASE WHEN 2 * tn1 + fn1 + fp1 <> 0 THEN 2 * tn1 / (2 * tn1 + fn1 + fp1) ELSE 0.0 END AS f1,
         CASE WHEN tp1 + fp1 <> 0 THEN tp1 / (tp1 + fp1) ELSE 0.0 END AS precision_churned,
         CASE WHEN tp1 + fn1 <> 0 THEN tp1 / (tp1 + fn1) ELSE 0.0 END AS recall_churned,
         CASE WHEN 2 * tp1 + fp1 + fn1 <> 0 THEN 2 * tp1 / (2 * tp1 + fp1 + fn1) ELSE 0.0 END AS f1_churned,
         (SELECT roc_auc FROM auc) AS roc_auc, CAST(0.5 AS DOUBLE) AS threshold
  FROM cm),
churn AS (
  SELECT count(*) AS customers, CAST(sum(c) AS BIGINT) AS churned_customers,
         CAST(sum(1 - c) AS BIGINT) AS retained_customers, avg(c) AS churn_rate
  FROM (SELECT customer_unique_id, max(CAST(churned AS INTEGER)) AS c FROM labelled GROUP BY 1)),
roi AS (
  SELECT scored_rows, flagged_retained, customers, flagged_full,
         flagged_full * CAST(25.0 AS DOUBLE) AS campaign_cost,
         flagged_full * CAST(0.15 AS DOUBLE) AS expected_conversions,
         flagged_full * CAST(0.15 AS DOUBLE) * CAST(560.0 AS DOUBLE) AS expected_revenue,
         CASE WHEN flagged_full <> 0 THEN
           (flagged_full * CAST(0.15 AS DOUBLE) * CAST(560.0 AS DOUBLE) - flagged_full * CAST(25.0 AS DOUBLE))
           / (flagged_full * CAST(25.0 AS DOUBLE)) * 100.0 END AS net_roi_pct
  FROM (SELECT count(*) AS scored_rows,
               count(*) FILTER (WHERE NOT p_churn >= (SELECT threshold FROM youden)) AS flagged_retained,
               (SELECT customers FROM churn) AS customers,
               CAST(floor(count(*) FILTER (WHERE NOT p_churn >= (SELECT threshold FROM youden))
                          / count(*) * (SELECT customers FROM churn)) AS BIGINT) AS flagged_full
        FROM test))
"""


def qs(final: str, months: int = MONTHS) -> str:
    return base(months) + BEH + SCORE + final


def _train_fitted(final: str) -> str:
    """As ``qb``, but medians, levels and top categories come from the training fold."""
    split = SCORE[:SCORE.index("scored AS")].rstrip().rstrip(",")
    train = "order_id IN (SELECT order_id FROM sp WHERE fold = 'train')"
    beh = (BEH.replace("FROM beh),", f"FROM beh WHERE {train}),")
           .replace("WHERE product_category_english IS NOT NULL\n", f"WHERE product_category_english IS NOT NULL AND {train}\n")
           .replace("FROM grp WHERE payment_type IS NOT NULL", f"FROM grp WHERE payment_type IS NOT NULL AND {train}")
           .replace("FROM grp WHERE customer_state IS NOT NULL", f"FROM grp WHERE customer_state IS NOT NULL AND {train}")
           .replace("product_category_grouped FROM grp)", f"product_category_grouped FROM grp WHERE {train})"))
    return base() + split + beh + final


ORACLES["feature_matrix_train"] = _train_fitted(ORACLES["feature_matrix"][len(qb("")):])

METRIC_Q = {
    "stratified_split": "SELECT order_id, CAST(label AS BIGINT) AS label, fold FROM sp",
    "class_distribution": """
SELECT fold, CAST(label AS BIGINT) AS label, n, round(n / sum(n) OVER (PARTITION BY fold), 6) AS share
FROM (SELECT fold, label, count(*) AS n FROM sp GROUP BY fold, label)""",
    "imbalance_weight": """
SELECT count(*) FILTER (WHERE label = 0) AS n_retained, count(*) FILTER (WHERE label = 1) AS n_churned,
       round(CASE WHEN count(*) FILTER (WHERE label = 1) <> 0 THEN
         CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*) FILTER (WHERE label = 1) END, 6) AS scale_pos_weight
FROM sp WHERE fold = 'train'""",
    "confusion_matrix": """
SELECT CAST(label AS BIGINT) AS actual, CAST(p_churn >= 0.5 AS BIGINT) AS predicted, count(*) AS n
FROM test GROUP BY 1, 2""",
    "classification_metrics": """
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(precision_churned, 6) AS precision_churned,
       round(recall_churned, 6) AS recall_churned, round(f1_churned, 6) AS f1_churned,
       round(roc_auc, 6) AS roc_auc, threshold
FROM mets""",
    "majority_baseline": """
SELECT round(CASE WHEN count(*) <> 0 THEN count(*) FILTER (WHERE label = m) / count(*) ELSE 0.0 END, 6) AS accuracy,
       round(CASE WHEN m = 0 AND count(*) <> 0 THEN count(*) FILTER (WHERE label = 0) / count(*) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN m = 0 AND count(*) FILTER (WHERE label = 0) <> 0 THEN 1.0 ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN m = 0 AND count(*) FILTER (WHERE label = 0) <> 0
                  THEN 2.0 * count(*) FILTER (WHERE label = 0) / (count(*) + count(*) FILTER (WHERE label = 0)) ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN m = 1 AND count(*) <> 0 THEN count(*) FILTER (WHERE label = 1) / count(*) ELSE 0.0 END, 6) AS precision_churned,
       round(CASE WHEN m = 1 AND count(*) FILTER (WHERE label = 1) <> 0 THEN 1.0 ELSE 0.0 END, 6) AS recall_churned,
       round(CASE WHEN m = 1 AND count(*) FILTER (WHERE label = 1) <> 0
                  THEN 2.0 * count(*) FILTER (WHERE label = 1) / (count(*) + count(*) FILTER (WHERE label = 1)) ELSE 0.0 END, 6) AS f1_churned,
       round(CASE WHEN count(*) FILTER (WHERE label = 1) > 0 AND count(*) FILTER (WHERE label <> 1) > 0 THEN 0.5 END, 6) AS roc_auc,
       CAST(0.5 AS DOUBLE) AS threshold
FROM test, (SELECT label AS m FROM sp WHERE fold = 'train' GROUP BY label ORDER BY count(*) DESC, label DESC LIMIT 1)
GROUP BY m""",
    "roc_auc": "SELECT round(roc_auc, 6) AS roc_auc FROM auc",
    "roc_curve": "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc_pts",
    "pr_curve": """
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM pr_f1""",
    "no_skill": "SELECT round(avg(CAST(label = 0 AS DOUBLE)), 6) AS no_skill FROM test",
    "threshold_grid": """
SELECT CAST(j AS BIGINT) AS j, round(threshold, 6) AS threshold, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep_m""",
    "threshold_best_f1": """
SELECT CASE WHEN f1 <= 0 THEN 0.5 ELSE round(threshold, 6) END AS threshold,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE round(precision, 6) END AS precision,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE round(recall, 6) END AS recall,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE round(f1, 6) END AS f1
FROM (SELECT * FROM sweep_m ORDER BY f1 DESC, j ASC LIMIT 1)""",
    "threshold_pr": """
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM (SELECT * FROM pr_f1 ORDER BY f1 DESC, threshold ASC LIMIT 1)""",
    "threshold_youden": """
SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(j, 6) AS j FROM youden""",
    "top_decile": """
SELECT order_id, round(CAST(1.0 AS DOUBLE) - p_churn, 6) AS p_retained FROM test
WHERE CAST(1.0 AS DOUBLE) - p_churn >= (SELECT quantile_cont(CAST(1.0 AS DOUBLE) - p_churn, 0.9) FROM test)""",
    "revenue_opportunity": """
SELECT count(*) FILTER (WHERE label = 0) AS actual_retained,
       count(*) FILTER (WHERE label = 0 AND NOT p_churn >= (SELECT threshold FROM youden)) AS retained_tp,
       count(*) FILTER (WHERE label = 0 AND p_churn >= (SELECT threshold FROM youden)) AS retained_fn,
       round(count(*) FILTER (WHERE label = 0 AND NOT p_churn >= (SELECT threshold FROM youden)) * CAST(560.0 AS DOUBLE), 6) AS potential_revenue,
       round(count(*) FILTER (WHERE label = 0 AND p_churn >= (SELECT threshold FROM youden)) * CAST(560.0 AS DOUBLE), 6) AS revenue_at_risk
FROM test""",
    "campaign_roi": """
SELECT scored_rows, flagged_retained, customers, flagged_full, round(campaign_cost, 6) AS campaign_cost,
       round(expected_conversions, 6) AS expected_conversions, round(expected_revenue, 6) AS expected_revenue,
       round(net_roi_pct, 6) AS net_roi_pct
FROM roi""",
    "findings_record": """
SELECT churn.customers, churned_customers, retained_customers, round(churn_rate, 6) AS churn_rate,
       round(roc_auc, 6) AS roc_auc, round(f1, 6) AS f1, round(f1_churned, 6) AS f1_churned, threshold,
       flagged_full, round(campaign_cost, 6) AS campaign_cost, round(expected_revenue, 6) AS expected_revenue,
       round(net_roi_pct, 6) AS net_roi_pct, printf('%.1f%%', churn_rate * 100.0) AS churn_rate_text
FROM churn, mets, roi""",
}

for _name, _final in METRIC_Q.items():
    ORACLES[_name] = qs(_final)


# --- remaining inventory items --------------------------------------------------------

MORE_Q = {
    "source_summary": """
SELECT 'orders' AS "table", count(*) AS rows, CAST(8 AS BIGINT) AS cols FROM m_orders
UNION ALL SELECT 'customers', count(*), 4 FROM m_customers
UNION ALL SELECT 'order_items', count(*), 5 FROM m_items
UNION ALL SELECT 'payments', count(*), 10 FROM m_payments
UNION ALL SELECT 'products', count(*), 2 FROM m_products
UNION ALL SELECT 'category_translation', count(*), 2 FROM m_translation
UNION ALL SELECT 'order_reviews', count(*), 5 FROM m_reviews""",
    "row_churn_rate": """
SELECT fold, count(*) AS rows, round(avg(CAST(label = 1 AS DOUBLE)), 6) AS churn_rate FROM sp GROUP BY fold""",
    "impute_train_median": """
, b2 AS (SELECT b.*, sp.fold FROM beh b JOIN sp ON b.order_id = sp.order_id),
tm AS (
  SELECT median(delivery_delay_days) AS m_delay, median(days_to_delivery) AS m_days,
         median(review_score) AS m_rs, median(total_freight) AS m_tf,
         median(payment_value) AS m_pv, median(payment_installments) AS m_pi
  FROM b2 WHERE fold = 'train')
SELECT order_id, round(coalesce(delivery_delay_days, m_delay), 6) AS delivery_delay_days,
       round(coalesce(days_to_delivery, m_days), 6) AS days_to_delivery,
       round(coalesce(CAST(review_score AS DOUBLE), m_rs), 6) AS review_score,
       round(coalesce(freight_ratio, 0.0), 6) AS freight_ratio,
       round(coalesce(total_freight, m_tf), 6) AS total_freight,
       round(coalesce(payment_value, m_pv), 6) AS payment_value,
       round(coalesce(CAST(payment_installments AS DOUBLE), m_pi), 6) AS payment_installments,
       coalesce(coalesce(delivery_delay_days, m_delay) > 0, false) AS is_late_delivery,
       coalesce(item_count = 1, false) AS is_single_item, fold
FROM b2 CROSS JOIN tm""",
    "event_churn_summary": """
, ev AS (SELECT * FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 29 DAY),
evc AS (SELECT user_id, count(DISTINCT event_id) AS n FROM ev WHERE user_id IS NOT NULL GROUP BY user_id),
evl AS (SELECT ev.user_id, coalesce(evc.n = 1, false) AS churned FROM ev LEFT JOIN evc ON ev.user_id = evc.user_id)
SELECT count(*) AS customers, CAST(sum(c) AS BIGINT) AS churned_customers,
       CAST(sum(1 - c) AS BIGINT) AS retained_customers, round(avg(c), 6) AS churn_rate
FROM (SELECT user_id, max(CAST(churned AS INTEGER)) AS c FROM evl GROUP BY user_id)""",
    "latest_conversation_turn": """
SELECT conv_id, turn, role FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY
           (turn IS NULL) DESC, turn DESC, role DESC) AS rn
  FROM conversations) WHERE rn = 1""",
}

for _name, _final in MORE_Q.items():
    ORACLES[_name] = qs(_final)

ORACLES["polarity_histogram"] = qt(_hist_sql(
    f"SELECT {SEG} AS segment, round(sentiment_polarity, 6) AS v FROM sent WHERE has_review_text", "v"))


# the kernel density from its linear bins, every bin at every point of the grid
ORACLES["polarity_density"] = qt(f"""
, vals AS (SELECT {SEG} AS segment, round(sentiment_polarity, 6) AS v FROM sent WHERE has_review_text),
grid AS (SELECT unnest(range(513)) AS i),
placed AS (SELECT segment, v, (v + 2.0::DOUBLE) / 0.0078125::DOUBLE AS at_,
                  least(CAST(floor((v + 2.0::DOUBLE) / 0.0078125::DOUBLE) AS INTEGER), 511) AS j FROM vals),
dealt AS (SELECT segment, j, 1 - (at_ - j) AS w FROM placed
          UNION ALL SELECT segment, j + 1, at_ - j FROM placed),
bins AS (SELECT segment, j, sum(w) AS w FROM dealt GROUP BY segment, j),
band AS (SELECT segment, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h
         FROM vals GROUP BY segment HAVING count(*) > 1 AND stddev_samp(v) > 1e-6)
SELECT segment, round(-2.0::DOUBLE + i * 0.0078125::DOUBLE, 6) AS x,
       round(sum(w * exp(-0.5 * pow((i - j) * 0.0078125::DOUBLE / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density
FROM bins JOIN band USING (segment), grid GROUP BY segment, i""")

ORACLES["opportunity_by_grain"] = qs("""
SELECT grain, level, actual_retained, retained_tp, retained_fn, scored_rows, flagged_retained, customers, flagged_full,
       round(retained_tp * 560.0::DOUBLE, 6) AS potential_revenue,
       round(retained_fn * 560.0::DOUBLE, 6) AS revenue_at_risk,
       round(flagged_full * 25.0::DOUBLE, 6) AS campaign_cost,
       round(flagged_full * 0.15::DOUBLE * 560.0::DOUBLE, 6) AS expected_revenue,
       round((flagged_full * 0.15::DOUBLE * 560.0::DOUBLE - flagged_full * 25.0::DOUBLE)
             / nullif(flagged_full * 25.0::DOUBLE, 0) * 100, 6) AS net_roi_pct
FROM (
  SELECT *, CAST(floor(flagged_retained / scored_rows * customers) AS BIGINT) AS flagged_full
  FROM (
    SELECT CASE g WHEN 1 THEN 'state' WHEN 2 THEN 'category' ELSE 'all' END AS grain,
           CASE g WHEN 1 THEN customer_state WHEN 2 THEN product_category_english END AS level, * EXCLUDE (g, customer_state, product_category_english)
    FROM (
      SELECT grouping(l.customer_state, l.product_category_english) AS g, l.customer_state, l.product_category_english,
             count(*) FILTER (WHERE label = 0) AS actual_retained,
             count(*) FILTER (WHERE label = 0 AND NOT p_churn >= (SELECT threshold FROM youden)) AS retained_tp,
             count(*) FILTER (WHERE label = 0 AND p_churn >= (SELECT threshold FROM youden)) AS retained_fn,
             count(*) AS scored_rows,
             count(*) FILTER (WHERE NOT p_churn >= (SELECT threshold FROM youden)) AS flagged_retained,
             count(DISTINCT t.customer_unique_id) AS customers
      FROM test t JOIN labelled l ON l.order_id = t.order_id
      GROUP BY GROUPING SETS ((l.customer_state), (l.product_category_english), ()))))""")


def _themes_sql(pool: str, rounds: int = 6) -> str:
    """Themes of ``pool`` (k, txt): vocabulary, surplus co-occurrence, rounds of label propagation, names."""
    propagation = "".join(f"""
l{r + 1} AS MATERIALIZED (
  SELECT term, arg_min(label, (-v, label)) AS label
  FROM (SELECT term, label, sum(weight) AS v
        FROM (SELECT src AS term, label, weight FROM graph JOIN l{r} ON l{r}.term = dst
              UNION ALL SELECT o.term, label, own FROM own o JOIN l{r} ON l{r}.term = o.term)
        GROUP BY term, label) GROUP BY term),""" for r in range(rounds))
    return f"""
, pool AS MATERIALIZED ({pool}),
ws AS MATERIALIZED (
  SELECT row_number() OVER () AS r, k,
         coalesce(list_filter(regexp_extract_all(lower(txt), '[\\pL'']+'), lambda t: length(t) >= 3), []) AS w
  FROM pool),
here AS MATERIALIZED (SELECT DISTINCT r, k, unnest(w) AS term FROM ws),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pool),
vocab AS MATERIALIZED (
  SELECT term FROM here GROUP BY term
  HAVING count(*) >= 5 AND count(*) >= 0.002::DOUBLE * (SELECT n FROM n) AND count(*) <= 0.25::DOUBLE * (SELECT n FROM n)),
at_place AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM ws),
near AS (
  SELECT DISTINCT x.r, least(x.t, y.t) AS a, greatest(x.t, y.t) AS b
  FROM at_place x, range(1, 5) AS d(d) JOIN at_place y ON y.r = x.r AND y.i = x.i + d.d WHERE x.t <> y.t),
pairs AS MATERIALIZED (
  SELECT a, b, count(*) AS c FROM near
  WHERE a IN (SELECT term FROM vocab) AND b IN (SELECT term FROM vocab) GROUP BY a, b),
both_ AS (SELECT a AS src, b AS dst, c FROM pairs UNION ALL SELECT b, a, c FROM pairs),
places AS MATERIALIZED (SELECT src, CAST(sum(c) AS DOUBLE) AS m FROM both_ GROUP BY src),
weighed AS (
  SELECT x.src, x.dst, CAST(floor((x.c - p.m * q.m / (SELECT sum(m) FROM places)) * 1000) AS BIGINT) AS weight
  FROM both_ x JOIN places p ON p.src = x.src JOIN places q ON q.src = x.dst WHERE x.c >= 3),
graph AS MATERIALIZED (
  SELECT src, dst, weight FROM weighed WHERE weight > 0
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 8),
own AS MATERIALIZED (SELECT src AS term, max(weight) AS own FROM graph GROUP BY src),
l0 AS MATERIALIZED (SELECT term, term AS label FROM own),{propagation}
inside AS (
  SELECT src AS term, x.label, sum(CASE WHEN x.label = y.label THEN weight ELSE 0 END) AS weight
  FROM graph JOIN l{rounds} x ON x.term = src JOIN l{rounds} y ON y.term = dst GROUP BY src, x.label),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS place FROM inside),
names AS (
  SELECT label, count(*) AS n_terms, string_agg(term, ', ' ORDER BY place) FILTER (WHERE place <= 3) AS theme
  FROM ranked GROUP BY label HAVING count(*) >= 3),
best AS (
  SELECT theme, n_terms, count(*) AS reviews_with_theme,
         arg_min(k, (-hits, k)) AS representative_id, max(hits) AS representative_hits
  FROM (SELECT theme, n_terms, k, count(*) AS hits
        FROM here JOIN ranked USING (term) JOIN names USING (label) GROUP BY ALL HAVING count(*) >= 2)
  GROUP BY theme, n_terms ORDER BY reviews_with_theme DESC, theme LIMIT 5)
SELECT *, round(reviews_with_theme / (SELECT n FROM n), 6) AS share,
       (SELECT min(p.txt) FROM pool p WHERE p.k = representative_id) AS representative_quote
FROM best"""


ORACLES["theme_counts"] = qt(_themes_sql("SELECT review_id AS k, review_comment_message AS txt FROM neg"))
ORACLES["review_themes_window"] = qt(_themes_sql(
    "SELECT order_id AS k, review_comment_message AS txt FROM labelled WHERE churned "
    "AND review_score <= 3 AND coalesce(regexp_matches(review_comment_message, '\\S'), false)"))
ORACLES["review_themes_all"] = qt(_themes_sql(
    "SELECT order_id AS k, review_comment_message AS txt FROM rev_latest "
    "WHERE review_comment_message IS NOT NULL"))

# every document's text at review grain
ORACLES["sentiment_all_reviews"] = qt("""
SELECT doc_id, has_review_text, round(coalesce(a.pol, 0.0), 6) AS sentiment_polarity,
       round(coalesce(a.subj, 0.0), 6) AS sentiment_subjectivity
FROM (SELECT doc_id, coalesce(regexp_matches(text, '\\S'), false) AS has_review_text FROM documents) d
LEFT JOIN sagg a ON d.doc_id = a.k""").replace(
    """  SELECT order_id AS k, review_comment_message AS txt FROM labelled
  WHERE coalesce(regexp_matches(review_comment_message, '\\S'), false)),""",
    """  SELECT doc_id AS k, text AS txt FROM documents
  WHERE coalesce(regexp_matches(text, '\\S'), false)),""")

ORACLES["window_bounds"] = f"""
SELECT CAST(m AS VARCHAR) AS last_order, CAST(m - INTERVAL {MONTHS} MONTH AS VARCHAR) AS cutoff,
       CAST(CAST(m AS DATE) AS VARCHAR) AS last_order_date,
       CAST(CAST(m - INTERVAL {MONTHS} MONTH AS DATE) AS VARCHAR) AS cutoff_date
FROM (SELECT max(o_orderdate) AS m FROM orders)"""

ORACLES["order_rows_per_customer"] = q("""
SELECT customer_unique_id, count(*) AS orders_placed
FROM m_items i JOIN m_orders o ON i.order_id = o.order_id JOIN m_customers c ON o.customer_id = c.customer_id
GROUP BY customer_unique_id""")

ORACLES["customer_place"] = """
SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)"""


# --- the learnt lexicon ---------------------------------------------------------------------------

_NEGATED = "('not', 'no', 'never', 'don''t', 'isn''t', 'wasn''t', 'não', 'nao', 'nunca', 'nem', 'pas', 'nicht', " \
           "'kein', 'keine')"


def _lexicon_sql(final: str) -> str:
    """told (order_id, review_score, txt, held_out), lexicon (term, …) and scored (a row a review)."""
    return q(f"""
, told AS MATERIALIZED (
  SELECT order_id, review_score, review_comment_message AS txt,
         CAST('0x' || substr(md5('42:' || coalesce(review_comment_message, '')), 1, 8) AS BIGINT)
           / 4294967296.0::DOUBLE < 0.2::DOUBLE AS held_out
  FROM rev_latest),
has AS (
  SELECT DISTINCT order_id, review_score >= 4 AS good, unnest(regexp_extract_all(lower(txt), '[\\pL'']+')) AS term
  FROM told WHERE NOT held_out AND (review_score >= 4 OR review_score <= 2)),
counts AS (
  SELECT term, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b
  FROM has WHERE length(term) >= 2 GROUP BY term),
sums AS (SELECT CAST(sum(g) AS DOUBLE) AS ag, CAST(sum(b) AS DOUBLE) AS ab FROM counts),
prior AS (SELECT *, 500.0::DOUBLE * (g + b) / (ag + ab) AS a FROM counts, sums),
rated AS (
  SELECT *, ln((g + a) / (ag + 501.0::DOUBLE - g - a)) - ln((b + a) / (ab + 501.0::DOUBLE - b - a)) AS d,
         1.0::DOUBLE / (g + a) + 1.0::DOUBLE / (b + a) AS var FROM prior),
lexicon AS MATERIALIZED (
  SELECT term, g AS n_good, b AS n_bad,
         d * (1 - var / (d * d)) / (1 + abs(d * (1 - var / (d * d)))) AS polarity,
         1 - 3.8416::DOUBLE * var / (d * d) AS subjectivity
  FROM rated WHERE g + b >= 5 AND d * d > 3.8416::DOUBLE * var),
toks AS (
  SELECT order_id, unnest(w) AS term, generate_subscripts(w, 1) AS i
  FROM (SELECT order_id, regexp_extract_all(lower(txt), '[\\pL'']+') AS w FROM told
        WHERE coalesce(regexp_matches(txt, '\\S'), false))),
scoped AS (
  SELECT order_id, term,
         coalesce(max(CASE WHEN term IN {_NEGATED} THEN 1 ELSE 0 END)
                  OVER (PARTITION BY order_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 1 AS negated
  FROM toks),
means AS (
  SELECT order_id, avg(polarity * CASE WHEN negated THEN -0.5 ELSE 1.0 END) AS p, avg(subjectivity) AS s
  FROM scoped JOIN lexicon USING (term) GROUP BY order_id),
scored AS (
  SELECT t.*, coalesce(regexp_matches(txt, '\\S'), false) AS has_review_text,
         coalesce(p, 0.0) AS sentiment_polarity, coalesce(s, 0.0) AS sentiment_subjectivity
  FROM told t LEFT JOIN means USING (order_id))
""" + final)


ORACLES["sentiment_lexicon"] = _lexicon_sql("""
SELECT term, n_good, n_bad, round(polarity, 6) AS polarity, round(subjectivity, 6) AS subjectivity FROM lexicon""")
ORACLES["sentiment_learnt"] = _lexicon_sql("""
SELECT order_id, held_out, has_review_text, round(sentiment_polarity, 6) AS sentiment_polarity,
       round(sentiment_subjectivity, 6) AS sentiment_subjectivity FROM scored""")
ORACLES["sentiment_agreement"] = _lexicon_sql("""
SELECT *, round(agreeing / nullif(n_signed, 0), 6) AS agreement
FROM (
  SELECT count(*) FILTER (WHERE review_score >= 4) AS n_good, count(*) FILTER (WHERE review_score <= 2) AS n_bad,
         round(avg(CASE WHEN review_score >= 4 THEN sentiment_polarity END), 6) AS mean_good,
         round(avg(CASE WHEN review_score <= 2 THEN sentiment_polarity END), 6) AS mean_bad,
         count(*) FILTER (WHERE round(sentiment_polarity, 9) <> 0) AS n_signed,
         count(*) FILTER (WHERE (review_score >= 4 AND round(sentiment_polarity, 9) > 0)
                             OR (review_score <= 2 AND round(sentiment_polarity, 9) < 0)) AS agreeing
  FROM scored WHERE held_out AND has_review_text AND (review_score >= 4 OR review_score <= 2))""")


# --- attribution by a fixed ensemble: the Shapley values from their definition --------------------

def _attribution_sql(final: str) -> str:
    """phi (order_id, feature, v) and margin (order_id, base, log_odds): every coalition of the features
    is valued by the path-dependent rule, and a feature's value is its weighted mean gain."""
    from lapsewise.plans.queries import FIXED_FEATURES, FIXED_TREES
    nodes = ",\n  ".join(str(r) for r in FIXED_TREES)
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(FIXED_FEATURES))
    n = len(FIXED_FEATURES)
    xs = " UNION ALL ".join(f"SELECT order_id, {i} AS f, CAST({c} AS DOUBLE) AS x FROM rows_"
                            for i, c in enumerate(FIXED_FEATURES))
    weights = ", ".join(f"({k}, {math.factorial(k) * math.factorial(n - 1 - k)} / {math.factorial(n)}.0)"
                        for k in range(n))
    return qb(f""",
nodes(tree, node, f, cut, l, r, value, cover) AS (VALUES
  {nodes}),
names(f, feature) AS (VALUES {names}),
weights(k, w) AS (VALUES {weights}),
rows_ AS (SELECT *, coalesce(regexp_matches(review_comment_message, '\\S'), false) AS has_review_text FROM imp),
xs AS ({xs}),
paths AS (
  WITH RECURSIVE p AS (
    SELECT tree, node, CAST([] AS STRUCT(f INTEGER, cut DOUBLE, is_left BOOLEAN, w DOUBLE)[]) AS conds
    FROM nodes WHERE node = 0
    UNION ALL
    SELECT c.tree, c.node, list_append(p.conds, struct_pack(
             f := CAST(n.f AS INTEGER), cut := CAST(n.cut AS DOUBLE), is_left := c.node = n.l,
             w := CAST(c.cover / n.cover AS DOUBLE)))
    FROM p JOIN nodes n ON n.tree = p.tree AND n.node = p.node
           JOIN nodes c ON c.tree = n.tree AND (c.node = n.l OR c.node = n.r))
  SELECT * FROM p),
leaves AS (
  SELECT row_number() OVER () AS leaf, n.value, conds
  FROM paths JOIN nodes n ON n.tree = paths.tree AND n.node = paths.node WHERE n.l < 0),
conds AS (SELECT leaf, c.f AS f, c.cut AS cut, c.is_left AS is_left, c.w AS w FROM (SELECT leaf, unnest(conds) AS c FROM leaves)),
met AS (
  SELECT x.order_id, c.leaf, c.f, bool_and((x.x <= c.cut) = c.is_left) AS o, product(c.w) AS w
  FROM conds c JOIN xs x ON x.f = c.f GROUP BY ALL),
coalitions AS (SELECT unnest(range({1 << n})) AS s),
games AS (
  SELECT order_id, leaf, s, product(CASE WHEN (s >> f) & 1 = 1 THEN CAST(o AS INTEGER) ELSE w END) AS g
  FROM met, coalitions GROUP BY ALL),
totals AS (
  SELECT order_id, s, sum(value * g) + (SELECT coalesce(sum(value), 0) FROM leaves WHERE len(conds) = 0) AS g
  FROM games JOIN leaves USING (leaf) GROUP BY ALL),
phi AS (
  SELECT a.order_id, n.feature, sum(w.w * (b.g - a.g)) AS v
  FROM totals a JOIN names n ON (a.s >> n.f) & 1 = 0
       JOIN totals b ON b.order_id = a.order_id AND b.s = a.s + (1 << n.f)
       JOIN weights w ON w.k = bit_count(a.s)
  GROUP BY ALL),
margin AS (
  SELECT order_id, max(CASE WHEN s = 0 THEN g END) AS base,
         max(CASE WHEN s = {(1 << n) - 1} THEN g END) AS log_odds FROM totals GROUP BY ALL)
""" + final)


def _fixed_oracles() -> None:
    from lapsewise.plans.queries import FIXED_FEATURES
    shap = ", ".join(f"round(max(CASE WHEN feature = '{c}' THEN v END), 6) AS shap_{c}" for c in FIXED_FEATURES)
    own = ", ".join(c if c == "has_review_text" else f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in FIXED_FEATURES)
    ORACLES["attribution_rows"] = _attribution_sql(f"""
SELECT r.order_id, churned, {own}, round(base, 6) AS base, round(log_odds, 6) AS log_odds,
       round(1 / (1 + exp(-log_odds)), 6) AS churn_prob, w.* EXCLUDE (order_id)
FROM rows_ r JOIN margin USING (order_id)
     JOIN (SELECT order_id, {shap} FROM phi GROUP BY order_id) w USING (order_id)""")
    ranked = """
, ranked AS (
  SELECT feature, round(m, 6) AS mean_abs_shap, row_number() OVER (ORDER BY m DESC, feature) AS rank
  FROM (SELECT feature, avg(abs(v)) AS m FROM phi GROUP BY feature))
"""
    ORACLES["attribution_ranking"] = _attribution_sql(ranked + "SELECT * FROM ranked")
    ORACLES["attribution_of_text"] = _attribution_sql(ranked + """
SELECT *, 'text' AS kind FROM ranked WHERE feature = 'has_review_text'
UNION ALL SELECT * FROM (SELECT *, 'structured' AS kind FROM ranked WHERE feature <> 'has_review_text'
                         ORDER BY rank LIMIT 2)""")


_fixed_oracles()

ORACLES["order_master_stored"] = ORACLES["order_master_join"]
