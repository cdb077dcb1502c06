"""Session settings, the shared scratch folder, and the package on the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SAFE_SETTINGS = {
    # A union of branches that adaptive execution re-plans may report a partitioning
    # it no longer has (seen on 4.1.2: one key in two groups), so it must not report any.
    "spark.sql.unionOutputPartitioning": "false",
    # split a skewed join also where a grouping on the same key follows it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot never compiles a method above this size; beyond it, split projections are faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # rows of long texts: bound what one Arrow batch holds, not only its row count
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **SAFE_SETTINGS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def on_one_machine(spark: SparkSession) -> bool:
    """True for ``local`` and ``local[n]``: driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, one machine (tests, a notebook) gets a temporary
    folder; a cluster gets an error, since its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not on_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _FALLBACK:
            _FALLBACK["dir"] = tempfile.mkdtemp(prefix="tidewater-")
        base = _FALLBACK["dir"]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def apply_safe_settings(spark: SparkSession) -> None:
    """Set what results depend on, in a session that somebody else built."""
    for key, value in SAFE_SETTINGS.items():
        spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Functions of the package travel to Python workers by name, so the workers must
    be able to import it wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidewater-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> None:
    """Make a given session ready for the operators."""
    apply_safe_settings(spark)
    ship_package(spark)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A :func:`shared_path` that is removed, with its checkpoint, when the driver ends."""
    path = shared_path(spark, purpose)
    for folder in (path, f"{path}.checkpoint"):
        atexit.register(_remove_quietly, spark, folder)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, and the
    work before it runs once instead of once per branch. It is removed when the
    driver ends; loops remove their earlier rounds with :func:`discard`.
    """
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    df.write.parquet(path)
    atexit.register(_remove_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        discard(spark, path)
    except Exception:  # noqa: BLE001 - the session is gone; its scratch folder is the cluster's to clear
        pass
