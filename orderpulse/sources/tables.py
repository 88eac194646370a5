"""Readers for the seven order tables and the driver's parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpulse.functions.columns import nan_to_null

# Explicit schemas: no inference pass, no type drift between files.
ORDER_SCHEMAS: dict[str, T.StructType] = {
    "orders": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("order_purchase_timestamp", T.StringType()),
        T.StructField("order_delivered_customer_date", T.StringType()),
        T.StructField("order_estimated_delivery_date", T.StringType()),
    ]),
    "order_items": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("order_item_id", T.IntegerType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("seller_id", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("freight_value", T.DoubleType()),
    ]),
    "order_payments": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("payment_type", T.StringType()),
    ]),
    "order_reviews": T.StructType([
        T.StructField("review_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("review_score", T.IntegerType()),
        T.StructField("review_comment_message", T.StringType()),
    ]),
    "products": T.StructType([
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_photos_qty", T.DoubleType()),
    ]),
    "sellers": T.StructType([
        T.StructField("seller_id", T.StringType()),
        T.StructField("seller_state", T.StringType()),
    ]),
    "category_translation": T.StructType([
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_category_name_english", T.StringType()),
    ]),
}

TIMESTAMP_COLUMNS = ["order_purchase_timestamp", "order_delivered_customer_date",
                     "order_estimated_delivery_date"]

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def _typed(name: str, df: DataFrame) -> DataFrame:
    """Coerce text timestamps (bad values -> NULL) and NaN doubles -> NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in TIMESTAMP_COLUMNS and isinstance(f.dataType, T.StringType):
            c = F.try_to_timestamp(c).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            c = nan_to_null(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_tables(spark: SparkSession, base: str, fmt: str = "csv",
                names: list[str] | None = None) -> dict[str, DataFrame]:
    """Read the seven order tables from ``base/<name>.<fmt>``.

    CSV uses ``multiLine`` because review comments contain newlines; such
    files do not split, so land them as Parquet once and read that after.
    """
    tables = {}
    for name in names or list(ORDER_SCHEMAS):
        schema = ORDER_SCHEMAS[name]
        path = f"{base.rstrip('/')}/{name}.{fmt}"
        if fmt == "csv":
            df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
                  .option("quote", '"').option("escape", '"').csv(path))
        else:
            df = spark.read.format(fmt).load(path).select(*[f.name for f in schema.fields])
        tables[name] = _typed(name, df)
    return tables


CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, paths: list[str], name: str, header: bool = True) -> DataFrame:
    """CSV files of an order table with two more columns: ``_corrupt_record``, the
    line as it stands where it does not fit the schema (a text in a number's
    place, too few or too many fields; null for good lines), and ``_file``."""
    schema = T.StructType([*ORDER_SCHEMAS[name].fields, T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("header", header).option("multiLine", True).option("quote", '"')
          .option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(paths))
    return _typed(name, df.withColumn("_file", F.col("_metadata.file_path")))


FILES = "name string, file string, n_good bigint, n_bad bigint"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def land_csv(spark: SparkSession, source: str, name: str, base: str, header: bool = True) -> DataFrame:
    """Land the CSV files under ``source`` that have not been landed yet; returns
    their (name, file, n_good, n_bad).

    Rows go typed to ``base/name`` by file, broken lines with their text beside
    them (:func:`read_landed` tells them apart), so a run that was cut short
    writes the same folders again. A file counts as landed once it stands in
    ``base/files``, which is written last.
    """
    done = _stored(spark, f"{base}/files", FILES).where(F.col("name") == name)
    there = spark.read.format("binaryFile").load(source).select(F.col("path").alias("file"))  # names only
    new = [r["file"] for r in there.join(done, "file", "left_anti").collect()]  # a row per file
    if not new:
        return spark.createDataFrame([], FILES)
    rows = read_csv_checked(spark, new, name, header).withColumn("file_key", F.md5("_file"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_key").parquet(f"{base}/{name}")
    files = spark.createDataFrame([(name, f) for f in new], "name string, file string").withColumn("file_key", F.md5("file"))
    counts = _landed(spark, base, name).groupBy("file_key").agg(
        F.count_if(F.col(CORRUPT).isNull()).alias("n_good"), F.count_if(F.col(CORRUPT).isNotNull()).alias("n_bad"))
    found = files.join(counts, "file_key", "left").fillna(0, ["n_good", "n_bad"]).select("name", "file", "n_good", "n_bad")
    found.coalesce(1).write.mode("append").parquet(f"{base}/files")
    return _stored(spark, f"{base}/files", FILES).where((F.col("name") == name) & F.col("file").isin(new))


def _landed(spark: SparkSession, base: str, name: str) -> DataFrame:
    typed = [T.StructField(f.name, T.TimestampNTZType() if f.name in TIMESTAMP_COLUMNS else f.dataType)
             for f in ORDER_SCHEMAS[name].fields]
    more = [T.StructField(c, T.StringType()) for c in (CORRUPT, "_file", "file_key")]
    return _stored(spark, f"{base}/{name}", T.StructType([*typed, *more]))


def read_landed(spark: SparkSession, base: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines with their file) of a landed table."""
    rows = _landed(spark, base, name)
    return (rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file", "file_key"),
            rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.col("_file").alias("file")))


def read_driver_tables(spark: SparkSession, sf_dir: str,
                       names: list[str] | None = None) -> dict[str, DataFrame]:
    """The driver's parquet tables, lazily (nothing is scanned here)."""
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")
            for n in (names or DRIVER_TABLES)}


def shape_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts per table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
             .select(F.lit(name).alias("table"), "n_rows",
                     F.lit(len(df.columns)).cast("int").alias("n_columns"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def land_observed(tables: dict[str, DataFrame], base: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """:func:`land_tables` with the shape report of the same jobs: the rows are
    counted as they are written, so no table is scanned for its counts."""
    out, shapes = {}, []
    for name, df in tables.items():
        seen = Observation(f"rows of {name}")
        out.update(land_tables({name: df.observe(seen, F.count(F.lit(1)).alias("n"))}, base))
        shapes.append((name, seen.get["n"], len(df.columns)))
    spark = next(iter(tables.values())).sparkSession
    return out, spark.createDataFrame(shapes, "`table` string, n_rows bigint, n_columns int")


def land_tables(tables: dict[str, DataFrame], base: str) -> dict[str, DataFrame]:
    """Write typed tables as Parquet once and return readers over the copies.

    multiLine CSV cannot be split across tasks, so every later scan of the
    raw files would be one task per file; the Parquet copies split, prune
    columns and push filters down.
    """
    out = {}
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        out[name] = df.sparkSession.read.parquet(path)
    return out
