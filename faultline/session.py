"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    for the input: AQE coalesces small partitions and splits skewed ones, so a
    generous start value is safe.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        # Rows that reach Python are whole files; keep batches of them small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Scratch folders handed out by this process, for ``clear_scratch``.
_HANDED_OUT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A local session without that setting, as in tests, uses its warehouse. On a cluster the setting is required: a default
    folder would be local to a machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediates, on storage every executor sees."""
    folder = f"{shared_root(spark)}/faultline/{purpose}-{uuid.uuid4().hex[:12]}"
    _HANDED_OUT.append(folder)
    return folder


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch folders handed out so far. Results that were not written elsewhere cannot be read any more."""
    remove(spark, *_HANDED_OUT)
    _HANDED_OUT.clear()


def remove(spark: SparkSession, *folders: str) -> None:
    """Remove scratch folders that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
