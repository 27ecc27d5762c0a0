"""How operators come by a term matcher."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crowdread.functions.labels import Terms
from crowdread.functions.matching import COUNTED, SCANNED, ScannedTerms, TextTerms, scan_terms


def lowered(df: DataFrame, text: str, terms: Terms | None = None) -> tuple[DataFrame, Terms]:
    """The given matcher, or one that searches the lower-cased text term by term."""
    if terms is not None:
        return df, terms
    return df.withColumn(f"_{text}_low", F.lower(text)), TextTerms(f"_{text}_low")


def scanned(
    df: DataFrame, text: str, terms: Terms | None = None, lists: Sequence[str] = (*SCANNED, *COUNTED)
) -> tuple[DataFrame, Terms]:
    """The given matcher, or one from a single pass over the lower-cased text that knows these lists."""
    if terms is not None:
        return df, terms
    scan = f"_{text}_scan"
    return df.withColumn(scan, scan_terms(F.lower(text), lists=lists)), ScannedTerms(scan)


def tidy(df: DataFrame) -> DataFrame:
    """Without the helper columns of this package, which start with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])
