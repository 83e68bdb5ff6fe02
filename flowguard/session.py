"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowguard", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC time and adaptive execution; sizing is left to the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only where none is set, a folder of this application on `fs.defaultFS`."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_application_folder(spark))
    return context.getCheckpointDir()


def _application_folder(spark: SparkSession) -> str:
    """Made on the default file system and removed when the application ends."""
    context, hadoop = spark.sparkContext, spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileSystem.get(context._jsc.hadoopConfiguration())
    if files.getUri().getScheme() == "file" and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: the default file system is not shared by the executors")
    folder = files.makeQualified(hadoop.Path(f"/tmp/flowguard-{context.applicationId}"))
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return folder.toString()


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder below the checkpoint folder, removed at the end; what is read from it must be written elsewhere before."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        remove_folder(spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: what was derived from it is out of date when this differs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True), []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame that several later jobs read, so a lost executor never replays its inputs."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)
