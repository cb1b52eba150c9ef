"""Sessions: configuration, and the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "16",
    "spark.ui.enabled": "false",
}
STREAMING = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.formatVersion": "5"}


def create_spark_session(app_name: str = "txnfeat", master: str = "local[*]", driver_memory: str = "4g", config: dict[str, str] | None = None) -> SparkSession:
    """The session with DEFAULTS, over which `config` wins. The master is left to the environment where SPARK_MASTER or MASTER is set."""
    builder = SparkSession.builder.appName(app_name)
    if not (os.environ.get("SPARK_MASTER") or os.environ.get("MASTER")):
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | {"spark.driver.memory": driver_memory} | (config or {})).getOrCreate()


get_spark_session = create_spark_session


def create_streaming_session(app_name: str = "txnfeat-streaming", shuffle_partitions: int = 4, config: dict[str, str] | None = None) -> SparkSession:
    """A session whose state is in RocksDB."""
    return create_spark_session(app_name, config=STREAMING | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | (config or {}))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, unless the environment already lets their Python find it."""
    root = Path(__file__).resolve().parents[1]
    seen = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p)]
    if any(p.resolve() == root for p in seen) or getattr(spark.sparkContext, "_txnfeat_shipped", False):
        return
    # Read by the driver only, which serves it to the executors.
    path = Path(tempfile.mkdtemp()) / "txnfeat.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in (root / "txnfeat").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._txnfeat_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where that is unset, a local master (tests) gets a temporary folder; a cluster, whose executors couldn't see it, raises ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="txnfeat-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
