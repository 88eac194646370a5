"""orderpulse: order-satisfaction features, models and drift monitoring on Spark.

Every operator takes and returns lazy DataFrames; the layout is
``sources`` (readers, stand-in tables), ``functions`` (Column helpers),
``operators`` (feature build, sampling, metrics, drift, monitoring,
validation, ML), ``plans`` (the registered queries) and ``streaming``.
"""

# The model's feature, label and key names, in schema order.
NUMERIC_FEATURES = [
    "delivery_days", "delivery_vs_estimated", "number_of_items",
    "total_order_value", "avg_product_price", "max_product_price",
    "min_product_price", "total_freight_value", "avg_freight_value",
    "max_freight_value", "min_product_photos_qty",
]
CATEGORICAL_FEATURES = ["product_category", "seller_state", "payment_type"]
ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
LABEL = "is_positive_review"
KEY = "order_id"
