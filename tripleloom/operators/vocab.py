"""Vocabularies and embedding lookup. Ids start at 1; 0 is what a vocabulary doesn't know."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_word
from .kg import small

UNKNOWN = "<UNKNOWN_ID>"


#: Words are numbered in parts by so many first characters.
LEADING = 3


def _numbered(words: DataFrame, descending: bool = False) -> DataFrame:
    """Ids along the order of the words: each part's words are numbered on their own, from where the parts before it end.

    Only the parts' counts meet in one task.
    """
    by = lambda c: F.desc(c) if descending else F.asc(c)
    words = words.withColumn("part", F.substring("token", 1, LEADING))
    sizes = words.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("n"))
    starts = sizes.select("p", (F.sum("n").over(Window.orderBy(by("p"))) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(by("token")))
    # null-safe, so that no filter for nulls parts the two readings of the words' aggregate: it is shuffled once
    return words.withColumn("at", within).join(starts, F.col("part").eqNullSafe(F.col("p"))).select("token", (F.col("start") + F.col("at")).cast("int").alias("id"))


def word_vocabulary(tokens: DataFrame, min_count: int = 3) -> DataFrame:
    """token, id of lower-cased words with a letter or digit that come at least min_count times, descending by word. tokens: token."""
    words = tokens.where(is_word(F.col("token"))).groupBy(F.lower("token").alias("token")).count().where(F.col("count") >= min_count)
    return _numbered(words.select("token"), descending=True)


def label_vocabulary(labels: DataFrame) -> DataFrame:
    """token, id of the distinct lower-cased labels that aren't empty. labels: token."""
    return _numbered(labels.where("token <> ''").select(F.lower("token").alias("token")).distinct())


def encode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds id, 0 for unknown tokens."""
    v = vocabulary.select(F.col("token").alias("v"), F.col("id").alias("vid"))
    return tokens.join(small(v), F.lower("token") == F.col("v"), "left").withColumn("id", F.coalesce("vid", F.lit(0))).drop("v", "vid")


def decode(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    v = vocabulary.select(F.col("token").alias("vt"), F.col("id").alias("vid"))
    return ids.join(small(v), F.col("id") == F.col("vid"), "left").withColumn("token", F.coalesce("vt", F.lit(UNKNOWN))).drop("vt", "vid")


def lookup(tokens: DataFrame, vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """Adds vec: that of the key, else of the row with a null key in vectors(key, vec), else zeros."""
    other = vectors.where(F.col(key).isNull()).select(F.col("vec").alias("other")).limit(1)
    default = other.collect()  # one vector
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    default = F.lit(default[0]["other"]).cast("array<float>") if default else zeros
    v = vectors.select(F.col(key).alias("vk"), "vec")
    return tokens.join(small(v), F.col(key) == F.col("vk"), "left").withColumn("vec", F.coalesce("vec", default)).drop("vk")
