"""Spark session helper.

Every job in the library runs with the same few session rules:

* session time zone UTC and ``TIMESTAMP`` literals without zone, so that the
  shop tables (``timestamp_ntz`` in the parquet files) and literals agree;
* ANSI mode on, so overflows and bad casts fail instead of turning into nulls;
* adaptive query execution with skew-join splitting, so a hot key (a seller or
  user holding a third of all rows) is split at runtime; tasks of a shuffle are
  merged up to ``TASK_MB`` of its (compressed) bytes, or to what the session asks
  for if that is less: a task holds some ten times that in sorts and windows;
* streaming state kept in RocksDB, off the executor heap;
* Arrow batches to Python of at most 1,000 rows and 8 MB;
* no web UI.

``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session. Only a
local session without it gets a scratch folder; on a cluster the setting must
name a shared folder, else an error says so.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts can be long: bound what one Arrow batch holds on either side
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # streaming state (lockout counters, codes in force, window counts) in
    # RocksDB instead of executor heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


TASK_MB = 16  # Spark's own 64 let a task of a join or window stage hold over 1 GB


def get_session(master: str | None = None, app: str = "cartograph",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_session_rules(spark)
    return spark


def apply_session_rules(spark: SparkSession) -> None:
    """Apply the runtime-settable rules to a session made elsewhere, and make
    the library importable by the Python workers."""
    for key, value in SESSION_DEFAULTS.items():
        if key.startswith("spark.ui."):
            continue
        spark.conf.set(key, value)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if _bytes(spark.conf.get(size)) > TASK_MB << 20:
        spark.conf.set(size, f"{TASK_MB}m")
    ship_library(spark)


def _bytes(text: str) -> int:
    """Bytes of a size setting (``64MB``, ``8m``, ``67108864b``)."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


_SHIPPED: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile``,
    as ``--py-files`` would), so Arrow UDFs that call library helpers can
    import them on any worker."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="cartograph-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "cartograph"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir``. When it is unset, a local session gets a
    scratch folder of its own (kept for the life of the application); on a
    cluster the setting is required, because a folder of one machine is not
    visible to the others.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _SCRATCH:
            _SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="cartograph-ckpt-")
        configured = _SCRATCH[sc.applicationId]
    sc.setCheckpointDir(configured)
    return configured


def temporary(spark: SparkSession, path: str) -> str:
    """Have the folder ``path`` (made if need be) deleted when the driver ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


_SCRATCH: dict[str, str] = {}
