"""Deterministic stand-ins for the seven order tables over the driver's tables.

The original order dataset is not available offline, so the order, item,
payment, review, product, seller and translation tables are derived from
``orders``, ``lineitem``, ``part``, ``supplier``, ``nation`` and
``documents``. The same derivation is written in SQL for the oracle
(:mod:`orderpulse.plans.oracle`); both follow FIXTURES.md section 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.functions.columns import plus_days_hours
from orderpulse.sources.local import literal_table
from orderpulse.sources.tables import read_driver_tables

# Stand-in category translation (the fifth type, 'promo', is
# left untranslated on purpose so the fallback to the original name runs).
TRANSLATION = [
    ("economy", "electronics"),
    ("large", "housewares"),
    ("medium", "toys"),
    ("small", "auto"),
    ("standard", "stationery"),
]

# Fixed value: the whitespace-only comment (space, tab, no-break space,
# newline, ideographic space); only a Unicode-aware strip empties it.
WHITESPACE_COMMENT = "\u0020\t\u00a0\n\u3000"

# The six production months of the stand-in and the first
# month after the reference period.
FIRST_MONTH = "2001-02-01"
N_MONTHS = 6


def _orders(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    purchase = plus_days_hours(F.col("o_orderdate"), F.lit(0), k % 24)
    return o.select(
        k.alias("order_id"),
        purchase.alias("order_purchase_timestamp"),
        F.when(k % 17 == 0, F.lit(None))
        .otherwise(plus_days_hours(purchase, 1 + (k * 7) % 30, (k * 5) % 24))
        .alias("order_delivered_customer_date"),
        plus_days_hours(F.col("o_orderdate"), 12 + (k * 3) % 20, F.lit(0))
        .alias("order_estimated_delivery_date"),
        F.col("o_orderpriority"),
    )


def _reviews(so: DataFrame) -> DataFrame:
    k = F.col("order_id")
    first = so.where(k % 50 != 0).select(
        k,
        (k * 2).alias("review_id"),
        F.when(F.col("o_orderpriority").startswith("1") & (k % 3 == 0), 1 + (k % 5).cast("int"))
        .when(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"),
              1 + (k % 3).cast("int"))
        .when(k % 8 == 0, F.lit(3))
        .otherwise(4 + (k % 2).cast("int")).alias("review_score"))
    second = so.where(k % 10 == 3).select(
        k, (k * 2 + 1).alias("review_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"))
    return first.unionByName(second)


def comment_refs(rv: DataFrame, documents: DataFrame) -> DataFrame:
    """Which comment each review has: ``kind`` = 'null' (every third order),
    'ws' (whitespace only, every eleventh) or 'doc' (the text of document
    ``order_id % n_docs``; n_docs is a scalar subquery, evaluated once)."""
    k = F.col("order_id")
    n_docs = documents.select(F.count(F.lit(1))).scalar()
    kind = (F.when(k % 3 == 0, F.lit("null")).when(k % 11 == 0, F.lit("ws"))
            .otherwise(F.lit("doc")))
    return rv.select("review_id", "order_id", "review_score", (k % n_docs).alias("doc_id"),
                     kind.alias("kind"))


def _comments(rv: DataFrame, documents: DataFrame) -> DataFrame:
    """Reviews with their comment text (kept apart so that the feature
    build, which needs no text, never scans or joins the documents)."""
    refs = comment_refs(rv, documents)
    docs = documents.select(F.col("doc_id"), F.col("text"), F.col("n_chars"))
    rv = refs.join(docs, "doc_id", "left")
    comment = (F.when(F.col("kind") == "null", F.lit(None).cast("string"))
               .when(F.col("kind") == "ws", F.lit(WHITESPACE_COMMENT))
               .otherwise(F.col("text")))
    return rv.select("review_id", "order_id", "review_score",
                     comment.alias("review_comment_message"), "doc_id",
                     F.col("n_chars").alias("doc_n_chars"))


def _items(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100 + 0.5) / 100.0).alias("freight_value"),
    )


def _payments(lineitem: DataFrame) -> DataFrame:
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.when(rf == "A", "credit_card")
        .when((rf == "N") & (ls == "F"), "boleto")
        .when(rf == "N", "debit_card")
        .when(ls == "F", "voucher")
        .otherwise("not_defined").alias("payment_type"))


def _sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state")))


def _products(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k.alias("product_id"),
        F.when(k % 20 == 0, F.lit(None).cast("string")).otherwise(F.lower("p_type"))
        .alias("product_category_name"),
        F.when(k % 15 == 0, F.lit(None).cast("double"))
        .otherwise((F.col("p_size") % 6 + 1).cast("double")).alias("product_photos_qty"))


def standin_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven order tables plus ``review_comments`` (reviews with text), lazily."""
    t = read_driver_tables(spark, sf_dir, ["orders", "lineitem", "part", "supplier", "nation",
                                           "documents"])
    so = _orders(t["orders"])
    reviews = _reviews(so)
    return {
        "orders": so.drop("o_orderpriority"),
        "order_items": _items(t["lineitem"]),
        "order_payments": _payments(t["lineitem"]),
        "order_reviews": reviews,
        "review_comments": _comments(reviews, t["documents"]),
        "products": _products(t["part"]),
        "sellers": _sellers(t["supplier"], t["nation"]),
        "category_translation": literal_table(
            spark, TRANSLATION, "product_category_name string, product_category_name_english string"),
    }
