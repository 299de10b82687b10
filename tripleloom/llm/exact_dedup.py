"""Operator 7, exact dedup: group by 128-bit content hash, keep one stable id, compare bytes inside groups.

The grouping key is the hash together with the normalised text, so equal hashes of different bytes part there; copies
meet in the map-side partial aggregate, and a group that holds a third of all rows reaches the shuffle as one row per
task. Members find their group again by the hash and the SHA-256 of the bytes, a join whose hot keys Spark can split.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z. Repeated rows are
members like any other. A null id loses to every other id; a group of null ids has keep_id null and keeps all its rows.
Rows that share the staying id and the text all stay. Columns other than id and text are ignored. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of


def digest128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = digest128
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group stays. digest: the content hash; a weak one only costs speed.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    norm = docs.select(F.col(id_col).alias("__id"), ascii_lower(text_of(text_col)).alias("__norm"))
    hashed = norm.withColumn("__digest", digest(F.col("__norm")))
    groups = (
        hashed.groupBy("__digest", "__norm")
        .agg(best("__id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.col("__digest").alias("__d"), F.sha2("__norm", 256).alias("__s"), "keep_id", "group_size")
    )
    rows = hashed.select("__id", "__digest", F.sha2("__norm", 256).alias("text_sha256"))
    joined = rows.join(groups, (rows["__digest"] == groups["__d"]) & (rows["text_sha256"] == groups["__s"]))
    return joined.select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, one per group, with all their columns; among rows of one id the smallest row stays."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    others = [c for c in docs.columns if c != id_col]
    row = F.struct(F.col(id_col).isNull().alias("__null") if keep == "smallest" else F.col(id_col).isNotNull().alias("__null"), F.col(id_col), *[F.col(c) for c in others])
    norm = ascii_lower(text_of(text_col))
    hashed = docs.select(row.alias("__row"), norm.alias("__norm")).withColumn("__digest", digest128(F.col("__norm")))
    one = hashed.groupBy("__digest", "__norm").agg(best("__row").alias("__row"))
    return one.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
