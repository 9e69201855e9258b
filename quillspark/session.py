"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None


def get_spark(app: str = "quillspark", cores: int | None = None) -> SparkSession:
    """A session with the settings the operators expect; a running session is reused."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "8g"))
    )
    if SparkSession.getActiveSession() is None and not os.environ.get("SPARK_MASTER"):
        n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
        builder = builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", str(max(8, n)))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can read and write.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder of this machine is used, and removed at exit.
    """
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return f"file://{_LOCAL_DIR}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark reaches; nothing if it isn't there."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables written since the last call. Results that read them must be kept elsewhere by then."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # noqa: BLE001 - the session has ended already, and its folder stays
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, removed by `release` or at exit."""
    if not _WRITTEN:
        atexit.unregister(_release_at_exit)
        atexit.register(_release_at_exit)
    path = f"{shared_dir(spark)}/quill_{name}_{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    It cuts the lineage, so a costly stage read by several consumers runs once, and the
    written files outlive a lost executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's cluster, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillspark-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = shutil.copytree(home, f"{folder}/src/quillspark", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/quillspark", "zip", os.path.dirname(copy)))
    _SHIPPED.add(context.applicationId)
