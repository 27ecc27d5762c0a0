"""Tables written once in the shared folder and read back, so that a lost executor costs a read."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def one_machine_folder() -> str:
    return tempfile.mkdtemp(prefix="run-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a session on one machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = one_machine_folder()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own. Shuffle files of the writing job are given back at its end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
