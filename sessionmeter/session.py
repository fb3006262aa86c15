"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for right results, whatever session they are given.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # a repeated JSON key keeps its last value instead of making the line unreadable
    "spark.sql.variant.allowDuplicateKeys": "true",
}


_local_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to an existing session."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str, shuffle_partitions: int, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("sessionmeter")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach; a local one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def work_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh folder below the shared one, removed at the end."""
    path = work_path(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if there is one already."""
    from pyspark.errors import PySparkException

    files, target = _file_system(spark, path)
    try:
        if files.exists(target):
            return False
        files.create(target, False).close()
        return True
    except PySparkException:
        raise
    except Exception as err:  # the file came into being meanwhile
        if not files.exists(target):
            raise err
        return False


def modified_seconds(spark: SparkSession, path: str) -> float:
    """When a file was last written; now, if it is gone."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return time.time()
    return files.getFileStatus(target).getModificationTime() / 1000


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
