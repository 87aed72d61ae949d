"""Session defaults and the shared folder for intermediate data."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_folders: set[tuple[str, str]] = set()
_local_folder: tempfile.TemporaryDirectory | None = None


def session(app: str = "coppice", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Session with adaptive execution on and any further settings from ``conf``.

    Cluster size, memory and credentials belong to ``spark-submit``, not here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _local_root() -> str:
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="coppice-")
        atexit.register(_local_folder.cleanup)
    return _local_folder.name


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one run's intermediate data.

    It lies in the folder that ``spark.checkpoint.dir`` names, which every executor
    reaches, and goes when the driver ends, if not before: what is read lazily cannot go
    earlier. Only a local master may do without that setting: a folder of this machine
    would be invisible to the executors of a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{_own_folder(spark, root.rstrip('/'))}/{purpose}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession, root: str) -> str:
    """This application's folder below the shared one, which its file system deletes when the driver ends."""
    application = spark.sparkContext.applicationId
    path = f"{root}/coppice-{application}"
    if (application, root) not in _own_folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _own_folders.add((application, root))
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`run_folder` named, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def create_file(spark: SparkSession, path: str) -> None:
    """Make an empty file, and the folders above it."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(file.getParent())
    system.create(file, True).close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return [status.getPath().getName() for status in system.listStatus(folder)]


def file_per_partition(spark: SparkSession) -> SparkSession:
    """A session of the same application whose scans take one file per partition, and
    split only larger ones; the given session keeps its settings.

    A scan otherwise packs small files together by their bytes and by the number of
    cores, and in a columnar file few bytes can be very many rows. Kept apart, the files
    a job wrote come back as the partitions they were written from.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return own
