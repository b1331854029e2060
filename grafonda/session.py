"""Session set-up and the durable cut of a lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL: list[str] = []
_BUILT: dict[tuple, DataFrame] = {}


def visible_to_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, if it is not on their path already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))
    return spark


def local_session(name: str = "grafonda", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return visible_to_workers(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRAFONDA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory; columns and filters are pushed into this scan by Catalyst."""
    return visible_to_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a fresh temporary folder; on a cluster each executor
    would write to its own disk, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='grafonda-')}")
        atexit.register(shutil.rmtree, _LOCAL[0].removeprefix("file://"), ignore_errors=True)
    return _LOCAL[0]


def _remove() -> None:
    for spark, path in _WRITTEN:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone; the folder belongs to the cluster
            pass


atexit.register(_remove)


def materialise(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, partitioned `by` a column if given, and read back.

    The plan above starts from files that survive the loss of any executor, with known sizes
    and prunable columns. The table is removed when the driver's Python ends.
    """
    spark = visible_to_workers(df.sparkSession)
    path = f"{shared_dir(spark)}/grafonda/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.parquet(path)


def built(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """A table derived from `folder`, written once a session and read by every later query, until a file of the folder changes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    key = (spark.sparkContext.applicationId, folder, name, sum(hash((f.getPath().getName(), f.getModificationTime(), f.getLen())) for f in files))
    if key not in _BUILT:
        _BUILT[key] = materialise(make(), name, by)
    return _BUILT[key]


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for work that is heavy for its bytes, which size-based planning would put into too few tasks."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_task))


def released(spark: SparkSession) -> None:
    """Removes every table written by `materialise` so far; for callers that know their results to be stored."""
    _remove()
    _WRITTEN.clear()
    _BUILT.clear()
