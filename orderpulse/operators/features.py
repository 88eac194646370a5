"""Order feature build: one row per reviewed order, 14 features + label.

Plan (all exchanges hash on ``order_id``):

* items -> left join sellers, left join (products left join translation)
  -> ONE ``groupBy(order_id)`` computing the 8 item measures, the seller
  state mode, the category mode and the minimum photo count;
* payments -> ``groupBy(order_id)`` mode; reviews -> ``groupBy(order_id)`` mean;
* orders inner reviews, left items, left payments.

The fused item aggregate is exact only when the dimension keys are unique
(a duplicate seller/product key would repeat item rows and inflate sums).
``order_features(..., fused=None)`` checks that with one small aggregate per
dimension and otherwise uses the unfused plan, where the dimension joins
only weight the modes, as in the reference recipe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse import CATEGORICAL_FEATURES, KEY, LABEL, NUMERIC_FEATURES
from orderpulse.functions.columns import binarize, floor_days

ITEM_MEASURES = ["number_of_items", "total_order_value", "avg_product_price",
                 "max_product_price", "min_product_price", "total_freight_value",
                 "avg_freight_value", "max_freight_value"]


def group_mode(df: DataFrame, key: str, col: str, alias: str | None = None) -> DataFrame:
    """Most frequent non-null value per key; ties -> smallest value.

    NULL when every value of the group is NULL; NULL keys are dropped.
    """
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.mode(col, True).alias(alias or col)))


def review_labels(reviews: DataFrame, cutoff: float = 4) -> DataFrame:
    """Mean review score per order and the positive flag (mean >= cutoff)."""
    agg = (reviews.where(F.col(KEY).isNotNull()).groupBy(KEY)
           .agg(F.avg("review_score").alias("review_score")))
    return (agg.where(F.col("review_score").isNotNull())
            .withColumn(LABEL, binarize("review_score", cutoff)))


def _item_measures() -> list:
    return [
        F.count("order_item_id").cast("double").alias("number_of_items"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_order_value"),
        F.avg("price").alias("avg_product_price"),
        F.max("price").alias("max_product_price"),
        F.min("price").alias("min_product_price"),
        F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("total_freight_value"),
        F.avg("freight_value").alias("avg_freight_value"),
        F.max("freight_value").alias("max_freight_value"),
    ]


def item_aggregates(items: DataFrame) -> DataFrame:
    """The 8 item measures per order (count = non-null item ids)."""
    return items.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(*_item_measures())


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id -> English category, falling back to the original name.

    Translation rows with a NULL name can never match (equi-join), unlike a
    pandas merge which pairs NULL with NULL: they are dropped explicitly.
    """
    tr = translation.where(F.col("product_category_name").isNotNull())
    return (products.join(tr, "product_category_name", "left")
            .select("product_id",
                    F.coalesce("product_category_name_english", "product_category_name")
                    .alias("product_category"),
                    "product_photos_qty"))


def dimensions_unique(tables: dict[str, DataFrame]) -> bool:
    """True when sellers, products and translations have unique join keys:
    one grouped job over the three tagged key columns."""
    keys = [("sellers", "seller_id"), ("products", "product_id"),
            ("category_translation", "product_category_name")]
    tagged = [tables[t].where(F.col(k).isNotNull())
              .select(F.lit(t).alias("_t"), F.col(k).cast("string").alias("_k"))
              for t, k in keys]
    allk = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return allk.groupBy("_t", "_k").count().where("count > 1").limit(1).count() == 0


def _fused_items(tables: dict[str, DataFrame]) -> DataFrame:
    items = tables["order_items"].select(KEY, "order_item_id", "product_id", "seller_id",
                                         "price", "freight_value")
    sellers = tables["sellers"].select("seller_id", "seller_state")
    prods = product_categories(tables["products"], tables["category_translation"])
    wide = (items.join(sellers, "seller_id", "left")
            .join(prods, "product_id", "left"))
    return (wide.where(F.col(KEY).isNotNull()).groupBy(KEY)
            .agg(*_item_measures(),
                 F.mode("seller_state", True).alias("seller_state"),
                 F.mode("product_category", True).alias("product_category"),
                 F.min("product_photos_qty").alias("min_product_photos_qty")))


def _unfused_items(tables: dict[str, DataFrame]) -> DataFrame:
    items = tables["order_items"]
    base = item_aggregates(items)
    sellers = tables["sellers"].select("seller_id", "seller_state")
    prods = product_categories(tables["products"], tables["category_translation"])
    st = group_mode(items.select(KEY, "seller_id").join(sellers, "seller_id", "left"),
                    KEY, "seller_state")
    ip = items.select(KEY, "product_id").join(prods, "product_id", "left")
    cat = (ip.where(F.col(KEY).isNotNull()).groupBy(KEY)
           .agg(F.mode("product_category", True).alias("product_category"),
                F.min("product_photos_qty").alias("min_product_photos_qty")))
    return base.join(st, KEY, "left").join(cat, KEY, "left")


def delivery_days(orders: DataFrame) -> DataFrame:
    """Floored elapsed days: delivered - purchase, delivered - estimated."""
    return orders.select(
        KEY,
        floor_days("order_delivered_customer_date", "order_purchase_timestamp")
        .alias("delivery_days"),
        floor_days("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("delivery_vs_estimated"),
        "order_purchase_timestamp")


def order_features(tables: dict[str, DataFrame], fused: bool | None = None,
                   cutoff: float = 4) -> DataFrame:
    """One row per order with a review: key, score, label, 14 features.

    ``fused=None`` (default) checks dimension key uniqueness first (three
    small aggregates over the dimension tables) and picks the fused plan
    only when it is exact. The purchase timestamp is carried for month
    tagging.
    """
    if fused is None:
        fused = dimensions_unique(tables)
    labels = review_labels(tables["order_reviews"], cutoff)
    items = _fused_items(tables) if fused else _unfused_items(tables)
    payments = group_mode(tables["order_payments"], KEY, "payment_type")
    orders = delivery_days(tables["orders"].where(F.col(KEY).isNotNull()))
    df = (orders.join(labels, KEY, "inner")
          .join(items, KEY, "left")
          .join(payments, KEY, "left"))
    return df.select(KEY, "review_score", LABEL, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES,
                     "order_purchase_timestamp")
