"""Session helpers."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "crowdread", cores: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python line of every expression doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _one_machine_dir() -> str:
    return tempfile.mkdtemp(prefix="run-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``; only a session on one machine may
    leave it unset, and a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _one_machine_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs written inside go at their end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


_open = threading.local()


class Temporary:
    """The tables staged inside a ``with`` are removed at its end, but for those kept, which belong to the block around it, if any."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Temporary:
        self.around = getattr(_open, "block", None)
        _open.block = self
        return self

    def __exit__(self, *error: object) -> None:
        _open.block = self.around
        self.release()

    def keep(self, table: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not table]
        if self.around is not None:
            self.around.tables.append(table)
        return table

    def release(self, tables: list[DataFrame] | None = None) -> None:
        """Removes these tables, or all that are left."""
        gone = list(self.tables if tables is None else tables)
        self.tables = [t for t in self.tables if not any(t is g for g in gone)]
        for table in gone:
            release(table)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Cuts the lineage for work that reads its input many times; a lost executor costs a read
    of files instead of a new computation.
    """
    path = shared_dir(df.sparkSession, name)
    with shuffles_given_back(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.staged_path = path
    if getattr(_open, "block", None) is not None:
        _open.block.tables.append(out)
    return out


def release(table: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
