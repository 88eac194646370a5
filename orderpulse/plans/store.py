"""Materialised stage tables under the shared checkpoint folder.

The feature table (one row per reviewed order) and the drifted production
frame feed most registered queries. Each is written once per session as
Parquet under ``spark.checkpoint.dir`` and read back: lineage is cut (a lost
executor re-reads files instead of recomputing the feature build), later
scans get column pruning and filter pushdown, and query plans stay small.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderpulse.session import scratch_path

_RUN = uuid.uuid4().hex[:12]
_MEMO: dict[tuple, DataFrame] = {}


def materialize(spark: SparkSession, name: str, sf_dir: str,
                build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key in _MEMO:
        return _MEMO[key]
    tag = hashlib.md5(f"{key[1]}:{name}".encode()).hexdigest()[:10]
    path = scratch_path(spark, f"tables/{_RUN}/{name}-{tag}")
    build().write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    _MEMO[key] = df
    return df


_OBJ: dict[tuple, object] = {}


def memo(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], object]):
    """Once-per-session cache for non-table results (fitted models)."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _OBJ:
        _OBJ[key] = build()
    return _OBJ[key]


def stage_path(spark: SparkSession, name: str, sf_dir: str) -> str:
    tag = hashlib.md5(f"{os.path.abspath(sf_dir)}:{name}".encode()).hexdigest()[:10]
    return scratch_path(spark, f"tables/{_RUN}/{name}-{tag}")
