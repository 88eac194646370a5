"""Small literal tables with real size statistics.

``createDataFrame`` over a Python list is an RDD scan whose size Spark
cannot estimate, which disables the size-checked broadcast of every join
above it. Building the rows as literals over a one-row range keeps the
plan's statistics, so Spark can broadcast what is provably small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = st.fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
