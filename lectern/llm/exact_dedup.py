"""Exact dedup: frequent digests are settled map-side by a broadcast, the rest by an ordinary shuffle.

Misra-Gries counters (``DataFrameStatFunctions.freqItems``, which keeps 1/support counters a
partition) name every digest that holds over ``support`` of the rows. One aggregation over those
digests verifies them and finds their winners; at most 1/support rows are then broadcast. Copies of
a winner are settled where they are read, so no key with more than ``support`` of the rows is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, checkpoint, col, fresh

#: Digests with more than this share of the rows are settled map-side; 1/SUPPORT bounds the broadcast.
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}][{SPACE}]+|[\\x09-\\x0D]", " ")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def winners(hashed: DataFrame, id_col: str, key: str, support: float = SUPPORT) -> DataFrame:
    """The frequent digests with the exact smallest id and number of rows: 1/support rows at most."""
    short = F.xxhash64(col(key))
    found = hashed.select(short.alias("h")).stat.freqItems(["h"], support)
    candidates = found.select(F.explode("h_freqItems").alias("h"))
    verified = (
        hashed.withColumn("h", short)
        .join(F.broadcast(candidates), "h", "left_semi")
        .groupBy(key)
        .agg(F.min(col(id_col)).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return verified.where(F.col("group_size") > 1)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT, narrow: bool = False) -> DataFrame:
    """df with text_sha256, keep_id, group_size and kept; narrow=True returns only id_col besides these.

    Of rows with equal normalised text the one with the smallest id is kept (ids that are null come
    last); of rows that repeat the id too, any one. A null text equals an empty one; long texts are compared whole. An empty table
    gives an empty result. Columns of df with the new names are replaced.
    """
    new = ["text_sha256", "keep_id", "group_size", "kept"]
    df = df.drop(*[c for c in df.columns if c.lower() in new and c not in (id_col, text_col)])
    key, keep, size, first = fresh(df, "digest_", "keep_", "size_", "first_")
    hashed = checkpoint(df.select(col(id_col), digest(col(text_col)).alias(key)))
    frequent = winners(hashed, id_col, key, support).select(col(key), F.col("keep_id").alias(keep), F.col("group_size").alias(size))
    base = hashed if narrow else df.withColumn(key, digest(col(text_col)))
    settled = base.join(F.broadcast(frequent), key, "left")
    is_copy = col(size).isNotNull() & ~col(id_col).eqNullSafe(col(keep))
    group = Window.partitionBy(col(key))
    ordinary = settled.where(~is_copy).select(
        *map(col, base.columns),
        F.coalesce(col(keep), F.min(col(id_col)).over(group)).alias(keep),
        F.coalesce(col(size), F.count(F.lit(1)).over(group)).alias(size),
        (F.row_number().over(group.orderBy(col(id_col).asc_nulls_last())) == 1).alias(first),
    )
    copies = settled.where(is_copy).select(*map(col, base.columns), col(keep), col(size), F.lit(False).alias(first))
    return ordinary.unionByName(copies).select(
        *[col(c) for c in base.columns if c != key],
        col(keep).alias("keep_id"),
        col(size).alias("group_size"),
        col(first).alias("kept"),
        col(key).alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with the columns of df, whatever their names: of equal texts (null and empty ones too) one row, an empty table's none."""
    return exact_dedup(df, id_col, text_col, support).where("kept").select(*map(col, df.columns))
