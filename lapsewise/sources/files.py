"""S-1 … S-5: the nine marketplace CSV files.

Reads are lazy: ``load_raw_tables`` returns DataFrames with explicit schemas
(timestamps typed at read, S-3), after checking every file exists (S-2).
Review comments may hold quotes and line breaks; that table is read in byte
ranges by ``csv_ranges``, like the others in as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.sources.csv_ranges import read_quoted_csv
from lapsewise.sources.schemas import SCHEMAS

# File name per table key, as the public dataset ships them.
TABLE_FILES = {
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "products": "olist_products_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
    "sellers": "olist_sellers_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
}

# The seven tables the order-level plan joins (S-4); sellers and geolocation
# are loadable but never joined.
JOINED_TABLES = ("orders", "order_items", "order_reviews", "customers", "payments",
                 "products", "category_translation")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def check_files(spark: SparkSession, data_dir: str, keys=None) -> None:
    """S-2: raise ``FileNotFoundError`` naming the first missing file."""
    for key in keys or TABLE_FILES:
        path = f"{data_dir.rstrip('/')}/{TABLE_FILES[key]}"
        if not _exists(spark, path):
            raise FileNotFoundError(f"Expected data file not found: {path}")


#: Tables whose fields may hold line breaks.
MULTI_LINE = ("order_reviews",)


def read_table(spark: SparkSession, data_dir: str, key: str) -> DataFrame:
    """One CSV, its columns matched by header name and typed; unknown columns follow as text.

    A missing column raises ``ValueError``; a value that does not fit its type
    stops the query that reads it and names the column and the value.
    """
    path = f"{data_dir.rstrip('/')}/{TABLE_FILES[key]}"
    raw = read_quoted_csv(spark, path) if key in MULTI_LINE else (
        spark.read.option("header", True).option("escape", '"').csv(path))
    missing = [f.name for f in SCHEMAS[key] if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    typed = []
    for f in SCHEMAS[key]:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        value = c if kind == "string" else F.when(
            c.isNotNull() & c.try_cast(kind).isNull(),
            F.raise_error(F.concat(F.lit(f"{key}.{f.name}: not a {kind}: "), c)).cast(kind)).otherwise(
                c.try_cast(kind))
        typed.append(value.alias(f.name))
    known = {f.name for f in SCHEMAS[key]}
    return raw.select(*typed, *[F.col(f"`{c}`") for c in raw.columns if c not in known])


def load_raw_tables(spark: SparkSession, data_dir: str, keys=None) -> dict[str, DataFrame]:
    """S-1: dict of lazily read tables (all nine by default)."""
    keys = tuple(keys or TABLE_FILES)
    check_files(spark, data_dir, keys)
    return {k: read_table(spark, data_dir, k) for k in keys}


def source_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """S-11: one row per table ``(table, rows, cols)``; one count job per table."""
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(name).alias("table"), "rows",
                             F.lit(len(df.columns)).cast("bigint").alias("cols")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
