"""Explicit schemas of the nine marketplace tables (no inference at scale)."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


S, I, D, TS = StringType(), IntegerType(), DoubleType(), TimestampNTZType()

ORDERS = _s(("order_id", S), ("customer_id", S), ("order_status", S),
            ("order_purchase_timestamp", TS), ("order_approved_at", TS),
            ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
            ("order_estimated_delivery_date", TS))
ORDER_ITEMS = _s(("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
                 ("shipping_limit_date", TS), ("price", D), ("freight_value", D))
ORDER_REVIEWS = _s(("review_id", S), ("order_id", S), ("review_score", I),
                   ("review_comment_title", S), ("review_comment_message", S),
                   ("review_creation_date", TS), ("review_answer_timestamp", TS))
CUSTOMERS = _s(("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
               ("customer_city", S), ("customer_state", S))
PAYMENTS = _s(("order_id", S), ("payment_sequential", I), ("payment_type", S),
              ("payment_installments", I), ("payment_value", D))
PRODUCTS = _s(("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
              ("product_description_lenght", I), ("product_photos_qty", I),
              ("product_weight_g", D), ("product_length_cm", D), ("product_height_cm", D),
              ("product_width_cm", D))
CATEGORY_TRANSLATION = _s(("product_category_name", S), ("product_category_name_english", S))
SELLERS = _s(("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S),
             ("seller_state", S))
GEOLOCATION = _s(("geolocation_zip_code_prefix", S), ("geolocation_lat", D),
                 ("geolocation_lng", D), ("geolocation_city", S), ("geolocation_state", S))

SCHEMAS = {
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_reviews": ORDER_REVIEWS,
    "customers": CUSTOMERS,
    "payments": PAYMENTS,
    "products": PRODUCTS,
    "category_translation": CATEGORY_TRANSLATION,
    "sellers": SELLERS,
    "geolocation": GEOLOCATION,
}
