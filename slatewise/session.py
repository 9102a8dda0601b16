"""Session settings shared by the tests, the benchmark and the command-line checks."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "slatewise", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session. On a cluster the session comes from spark-submit and this function is not used."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The storage that driver and executors share, as named by ``spark.checkpoint.dir``.

    Where it is unset, a session inside one process gets a folder of its own; on a cluster that would be a folder of each
    machine, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared storage."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage into the shared storage."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=eager)


#: By thread, the tables that the innermost ``scratch`` removes.
_TAKEN_DOWN: dict[int, list[str]] = {}


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` inside are removed at the end, and shuffles let go of: for steps whose result is with the driver by then."""
    paths: list[str] = []
    thread = threading.get_ident()
    outer, _TAKEN_DOWN[thread] = _TAKEN_DOWN.get(thread), paths
    try:
        yield
    finally:
        del _TAKEN_DOWN[thread]
        if outer is not None:
            _TAKEN_DOWN[thread] = outer
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        release(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared storage: lineage is cut, and joins know its size."""
    path = work_folder(df.sparkSession, name)
    if (paths := _TAKEN_DOWN.get(threading.get_ident())) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files that nothing refers to any more: Spark removes them once the driver's garbage is collected, which a
    driver with little of it puts off while rounds of shuffles pile up on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
