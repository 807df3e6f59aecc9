"""Driver test tables → the seven marketplace table shapes.

The test bed ships TPC-H-like parquet tables; this module derives from them
the order, item, payment, review, customer, product and category-lookup
tables the retention plan expects. Every derivation is a lazy DataFrame
expression over the whole input tables, so its cost grows with them.

Mapping (the same rules are written as SQL in ``lapsewise.plans.oracle``):

* orders: o_orderkey→order_id and customer_id, o_orderdate→purchase and
  approval time; carrier/customer delivery = min/max ``l_shipdate`` of the
  order's lines (orders without lines keep NULL); estimated delivery =
  purchase + 1860 days (about one order in ten then arrives late).
* customers: one record an order (customer_id = o_orderkey) with the place of
  its o_custkey (state = n_name, city = r_name). customer_unique_id: every
  tenth order belongs to the person o_custkey, who may have many; all others
  to a person of their own (-1 - o_orderkey).
* order_items: one row per lineitem; freight = extended price × tax.
* payments: one row per lineitem; value = price·(1−discount)·(1+tax),
  installments = quantity, type = return flag. (order, line number) is not
  unique, so the "first payment" order also uses part, supplier, quantity,
  price and ship date (``PAYMENT_ORDER``).
* products: p_partkey→product_id, p_brand→category; the lookup maps each
  brand to ``brand_<n>`` except brands ending in 3, which stay untranslated.
* order_reviews: documents ⟕ labels; three reviews a document, over all
  orders: of the orders 15·doc_id, 15·doc_id + 7 and 15·(doc_id + 1), so some
  orders have two; review_id = 3·doc_id + 0, 1, 2. score = 1 + 2·quality +
  2·(1−toxic) when labelled, else from the ids and NULL for every eleventh
  document; answer time derived from review_id and NULL for every seventh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

PAYMENT_ORDER = ("payment_sequential", "tb_partkey", "tb_suppkey", "tb_quantity",
                 "tb_price", "tb_shipdate")

ESTIMATE_DAYS = 1860


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def model_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda n: read_driver(spark, sf_dir, n)
    li = t("lineitem")

    ship = (li.groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.min("l_shipdate").alias("order_delivered_carrier_date"),
                 F.max("l_shipdate").alias("order_delivered_customer_date")))
    o = t("orders")
    orders = (o.select(F.col("o_orderkey").alias("order_id"),
                       F.col("o_orderkey").alias("customer_id"),
                       F.col("o_orderstatus").alias("order_status"),
                       F.col("o_orderdate").alias("order_purchase_timestamp"),
                       F.col("o_orderdate").alias("order_approved_at"),
                       (F.col("o_orderdate") + F.make_dt_interval(F.lit(ESTIMATE_DAYS)))
                       .alias("order_estimated_delivery_date"))
              .join(ship, "order_id", "left")
              .select("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                      "order_approved_at", "order_delivered_carrier_date",
                      "order_delivered_customer_date", "order_estimated_delivery_date"))

    # nation and region are fixed-size dimensions: the planner broadcasts them
    # from file statistics (size-checked by autoBroadcastJoinThreshold).
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    region = t("region").select("r_regionkey", "r_name")
    person = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey")).otherwise(-1 - F.col("o_orderkey"))
    customers = (o.select(F.col("o_orderkey").alias("customer_id"), person.alias("customer_unique_id"),
                          "o_custkey")
                 .join(t("customer").select("c_custkey", "c_nationkey"),
                       F.col("o_custkey") == F.col("c_custkey"), "left")
                 .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                 .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
                 .select("customer_id", "customer_unique_id",
                         F.col("n_name").alias("customer_state"),
                         F.col("r_name").alias("customer_city")))

    items = li.select(F.col("l_orderkey").alias("order_id"),
                      F.col("l_linenumber").alias("order_item_id"),
                      F.col("l_partkey").alias("product_id"),
                      F.col("l_extendedprice").alias("price"),
                      (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"))

    payments = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_quantity").cast("int").alias("payment_installments"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
        .alias("payment_value"),
        F.col("l_partkey").alias("tb_partkey"), F.col("l_suppkey").alias("tb_suppkey"),
        F.col("l_quantity").alias("tb_quantity"), F.col("l_extendedprice").alias("tb_price"),
        F.col("l_shipdate").alias("tb_shipdate"))

    part = t("part")
    products = part.select(F.col("p_partkey").alias("product_id"),
                           F.col("p_brand").alias("product_category_name"))
    translation = (part.select(F.col("p_brand").alias("product_category_name")).distinct()
                   .where(~F.col("product_category_name").endswith("3"))
                   .select("product_category_name",
                           F.lower(F.regexp_replace("product_category_name", "#", "_"))
                           .alias("product_category_name_english")))

    docs = t("documents").select("doc_id", "text")
    labels = t("labels").select("doc_id", "quality", "toxic")
    unlabelled = F.when(F.col("doc_id") % 11 != 0, 1 + (F.col("doc_id") + F.col("copy")) % 5)
    reviews = (docs.join(labels, "doc_id", "left")
               .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
               .withColumn("review_id", 3 * F.col("doc_id") + F.col("copy"))
               .select("review_id",
                       F.when(F.col("copy") == 2, 15 * (F.col("doc_id") + 1))
                       .otherwise(15 * F.col("doc_id") + 7 * F.col("copy")).alias("order_id"),
                       F.coalesce(1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic")), unlabelled).cast("int")
                       .alias("review_score"),
                       F.col("text").alias("review_comment_message"),
                       F.when(F.col("review_id") % 7 != 0,
                              F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
                              + F.make_dt_interval(((F.col("review_id") * 7919) % 2000).cast("int")))
                       .alias("review_answer_timestamp")))

    return {"orders": orders, "customers": customers, "order_items": items,
            "payments": payments, "products": products,
            "category_translation": translation, "order_reviews": reviews}
