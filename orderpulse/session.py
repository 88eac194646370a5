"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark broadcasts a join side only when its estimated size is below
    # this bound; larger sides fall back to a shuffled join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state (label joins hold days of predictions) lives in RocksDB
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # honoured only when this call starts the JVM (local runs, tests)
    "spark.driver.memory": "12g",
}


def get_spark(master: str | None = None, app: str = "orderpulse",
              conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session. ``conf`` is set as given; the defaults above
    only where neither the launcher nor a running session has a value.

    ``master`` is only set when given, so a cluster launcher keeps its own. The
    number of shuffle partitions is left to the cluster.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    launched, running = SparkConf(), SparkSession.getActiveSession()
    for k, v in DEFAULT_CONF.items():
        if not launched.contains(k) and (running is None or running.conf.get(k, None) is None):
            b = b.config(k, v)
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; a scratch folder is
    created only when the setting is absent on a local master (local runs
    and tests). On a cluster an absent setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        # A machine-local folder is lost with its executor; only a local
        # master (one machine: tests, development) may fall back to one.
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="orderpulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return spark.conf.get("spark.checkpoint.dir", None) or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
