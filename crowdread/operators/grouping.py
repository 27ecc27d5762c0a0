"""Grouped work that stays spread when one group holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdread.session import staged

SPREAD = 32
CHUNK_BITS = 20


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first n rows of each group, with their rank.

    Rows are ranked within salted parts of the group first, and only the first n of each part
    meet, so a group brings at most ``SPREAD`` times n rows to one task, whatever n is.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order_inputs(df, keys)), F.lit(SPREAD)))
    by_part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    part = salted.withColumn("_part_rank", F.row_number().over(by_part))
    df = part.filter(F.col("_part_rank") <= n).drop("_salt", "_part_rank")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def order_inputs(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Plain columns that differ between rows of a group: numbers, so that no text is hashed for its salt, or else strings."""
    numbers = ("bigint", "int", "double", "boolean")
    found = [F.col(c) for c, t in df.dtypes if t in numbers and c not in keys]
    return found or [F.col(c) for c, t in df.dtypes if t == "string" and c not in keys]


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join of rows with a table that has one row per key.

    A plain join: where the table is small Spark sends it to all tasks and the rows stay where they are; else the adaptive
    skew join splits the partition of a hot key on the side of the rows, and the one row of the key goes to
    each part.
    """
    return rows.join(per_key, list(keys), how)


def number_rows(
    rows: DataFrame, keys: Sequence[str], position: str, out: str = "ordinal"
) -> DataFrame:
    """Number the rows of each group from 0 in the order of ``position``.

    ``position`` is a whole number, not negative, different within the group. A group is cut
    into chunks of 2^20 positions, so no window holds more rows than that; counts per chunk,
    added up over chunks and over 2^20 chunks, give each chunk its first number.
    """
    keys = list(keys)
    cut = rows.withColumn("_chunk", F.shiftrightunsigned(position, CHUNK_BITS))
    sizes = (
        cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
        .withColumn("_block", F.shiftrightunsigned("_chunk", CHUNK_BITS))
    )
    within = Window.partitionBy(*keys, "_block").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy(*keys, "_block").agg(F.sum("_n").alias("_block_n"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, "_block", F.coalesce(F.sum("_block_n").over(over), F.lit(0)).alias("_block_first")
    )
    firsts = (
        sizes.withColumn("_chunk_first", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(blocks, [*keys, "_block"])
        .select(*keys, "_chunk", (F.col("_chunk_first") + F.col("_block_first")).alias("_first"))
    )
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(position)
    return (
        cut.join(firsts, [*keys, "_chunk"])
        .withColumn(out, F.col("_first") + F.row_number().over(in_chunk) - 1)
        .drop("_chunk", "_first")
    )



def number_in_order(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "ordinal"
) -> DataFrame:
    """Number the rows of each group from 0 in the order of columns of any kind.

    Rows are dealt by ranges of keys and order and written once, so a hot group spreads over
    ranges; each range counts from where the ranges before it end. Without keys all rows are
    one group.
    """
    keys = list(keys)
    dealt = staged(
        rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    # One row per group and range.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return (
        dealt.withColumn("_in_range", within - 1).join(firsts, [*keys, "_range"])
        .withColumn(out, F.col("_first") + F.col("_in_range"))
        .drop("_range", "_in_range", "_first")
    )
