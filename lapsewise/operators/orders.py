"""Order-level spine: per-order aggregates of the 1:n sides and the master join.

Operators J-1 … J-6, J-13, A-1 … A-3, W-1 … W-3.

Scale notes
-----------
* Every 1:n side is reduced to one row per ``order_id`` with aggregates that
  combine map-side (count/sum/max, ``mode``'s per-key map, ``min_by``/
  ``max_by``), so a hot order with a third of all lines never lands whole in
  one task before the partial aggregation.
* "first payment" and "latest review" use ``min_by``/``max_by`` over an
  explicit total order instead of a window: with struct buffers Spark runs
  them as sort-based aggregates (spillable, partial per map task), so no
  order's rows need to meet in one window partition.
* The customer join runs on the narrow order spine; the three ``order_id``
  sides (already hash-partitioned by ``order_id`` by their aggregation) are
  attached last, so the wide rows carrying review text are never shuffled by
  another key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.operators.joins import left_attach

ORDER_COLUMNS = ("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                 "order_approved_at", "order_delivered_carrier_date",
                 "order_delivered_customer_date", "order_estimated_delivery_date")
CUSTOMER_COLUMNS = ("customer_unique_id", "customer_state", "customer_city")
REVIEW_COLUMNS = ("review_score", "review_comment_message")
ITEM_COLUMNS = ("item_count", "total_item_price", "total_freight", "product_category_english")
PAYMENT_COLUMNS = ("payment_value", "payment_installments", "payment_type")
MASTER_COLUMNS = ORDER_COLUMNS + CUSTOMER_COLUMNS + REVIEW_COLUMNS + ITEM_COLUMNS + PAYMENT_COLUMNS


def items_with_category(items: DataFrame, products: DataFrame | None,
                        translation: DataFrame | None, null_safe: bool = False) -> DataFrame:
    """J-1, J-2: items ⟕ products ⟕ category lookup (English name)."""
    out = items
    if products is not None:
        out = left_attach(out, products.select("product_id", "product_category_name"),
                          "product_id")
    if translation is not None:
        out = left_attach(out, translation.select("product_category_name",
                                                  "product_category_name_english"),
                          "product_category_name", null_safe=null_safe)
    return out


def items_per_order(items: DataFrame, products: DataFrame | None = None,
                    translation: DataFrame | None = None,
                    null_safe_lookup: bool = False) -> DataFrame:
    """A-1 + A-2: item count, price and freight sums, modal category per order.

    ``count`` skips NULL item ids; sums of all-NULL groups are 0.0 (pandas);
    the modal category ignores NULLs and takes the smallest value on ties.
    """
    enriched = items_with_category(items, products, translation, null_safe_lookup)
    cat = (F.col("product_category_name_english")
           if "product_category_name_english" in enriched.columns
           else F.lit(None).cast("string"))
    return (enriched.groupBy("order_id")
            .agg(F.count("order_item_id").alias("item_count"),
                 F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_item_price"),
                 F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("total_freight"),
                 F.mode(cat, True).alias("product_category_english")))


def payments_per_order(payments: DataFrame,
                       order_by: Sequence[str] = ("payment_sequential",)) -> DataFrame:
    """A-3: summed value (0.0 when all NULL), max installments, first type.

    The reference takes the physically first row of each group; Spark rows
    have no file order, so "first" is the smallest ``order_by`` tuple. A NULL
    type on that row is kept.
    """
    first_key = F.struct(*[F.col(c) for c in order_by])
    return (payments.groupBy("order_id")
            .agg(F.coalesce(F.sum("payment_value"), F.lit(0.0)).alias("payment_value"),
                 F.max("payment_installments").alias("payment_installments"),
                 F.min_by("payment_type", first_key).alias("payment_type")))


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str,
                   cols: Sequence[str] | None = None, undated_wins: bool = True) -> DataFrame:
    """W-1: one row per ``key``, the latest by ``ts`` then ``tie``.

    pandas ``sort_values`` puts missing times last and ``keep='last'`` then
    keeps an undated row over dated ones (``undated_wins``). An aggregate
    ``max_by`` over a struct ordering replaces the sort + dedupe.
    """
    cols = [c for c in (cols or df.columns) if c != key]
    null_rank = F.col(ts).isNull() if undated_wins else F.col(ts).isNotNull()
    order = F.struct(null_rank.alias("n"), F.col(ts).alias("t"), F.col(tie).alias("k"))
    return (df.groupBy(key)
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_row"))
            .select(key, *[F.col(f"_row.{c}").alias(c) for c in cols]))


def earliest_per_key(df: DataFrame, key: str, ts: str, tie: str,
                     cols: Sequence[str] | None = None) -> DataFrame:
    """W-2: one row per ``key``, the earliest by ``ts`` then ``tie``; undated rows lose."""
    cols = [c for c in (cols or df.columns) if c != key]
    order = F.struct(F.col(ts).isNull().alias("n"), F.col(ts).alias("t"), F.col(tie).alias("k"))
    return (df.groupBy(key)
            .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_row"))
            .select(key, *[F.col(f"_row.{c}").alias(c) for c in cols]))


def first_per_key(df: DataFrame, key: str) -> DataFrame:
    """W-3: an arbitrary row per key (only key-constant columns may be read)."""
    return df.dropDuplicates([key])


def latest_review(reviews: DataFrame, tie: str = "review_id") -> DataFrame:
    """W-1 on reviews: most recent answer per order, ties broken by ``tie``."""
    return latest_per_key(reviews, "order_id", "review_answer_timestamp", tie,
                          cols=[tie, "review_score", "review_comment_message",
                                "review_answer_timestamp"])


def attach_customers(spine: DataFrame, customers: DataFrame) -> DataFrame:
    """J-3: the narrow order spine ⟕ customer attributes (shuffles only narrow rows)."""
    return left_attach(spine.select(*ORDER_COLUMNS),
                       customers.select("customer_id", *CUSTOMER_COLUMNS), "customer_id")


def attach_order_sides(df: DataFrame, tables: dict[str, DataFrame],
                       payment_order: Sequence[str] = ("payment_sequential",),
                       review_tie: str = "review_id") -> DataFrame:
    """J-4 … J-6: latest review, item and payment aggregates by ``order_id``.

    The three sides are already hash-partitioned by ``order_id`` by their own
    aggregation, so the joins add one shuffle of ``df`` and none of the sides.
    """
    reviews = latest_review(tables["order_reviews"], review_tie).select("order_id",
                                                                        *REVIEW_COLUMNS)
    items = items_per_order(tables["order_items"], tables.get("products"),
                            tables.get("category_translation"))
    payments = payments_per_order(tables["payments"], payment_order)
    out = left_attach(df, reviews, "order_id")
    out = left_attach(out, items, "order_id")
    return left_attach(out, payments, "order_id")


def join_tables(tables: dict[str, DataFrame], orders: DataFrame | None = None,
                payment_order: Sequence[str] = ("payment_sequential",),
                review_tie: str = "review_id") -> DataFrame:
    """J-13: one row per order with customer, latest review, item and payment aggregates.

    ``orders`` overrides the spine (e.g. an already windowed one). Customers
    are joined to the narrow spine first, so the wide rows (with review text)
    are never re-shuffled by another key.
    """
    spine = orders if orders is not None else tables["orders"]
    df = attach_customers(spine, tables["customers"])
    return attach_order_sides(df, tables, payment_order, review_tie).select(*MASTER_COLUMNS)
