"""Files for people and other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from crowdread.schema import EXPORT_COLUMNS

CSV = {"header": True, "quote": '"', "escape": '"'}


def export_view(df: DataFrame) -> DataFrame:
    """The listed columns that exist."""
    return df.select(*[c for c in EXPORT_COLUMNS if c in df.columns])


def export_comments(df: DataFrame, path: str) -> None:
    """CSV with a header line; quotes, blanks and line breaks inside texts are kept."""
    view = export_view(df)
    view.write.mode("overwrite").options(**CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
