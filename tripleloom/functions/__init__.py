"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY, MISSING = "<empty>", "<missing label>"


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row: generated, so that what uses them, filters too, isn't merged with their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def spread(df: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """df, dealt over all cores where its input has less than split_bytes for each of them, as a file of one row group is one task; larger input stays as scanned."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split_bytes else df


def parts(df: DataFrame) -> int:
    """Partitions for rows that are few and take long each, so that they aren't put together by their bytes."""
    session = df.sparkSession
    return max(3 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def ratio(n: Column, d: Column) -> Column:
    """n / d, null when d is 0."""
    return F.when(d != 0, n / d)


def local_id(identifier: Column) -> Column:
    """The part after the last colon; trailing colons don't count."""
    return F.substring_index(F.rtrim(identifier, F.lit(":")), ":", -1)


def clean_text(text: Column) -> Column:
    """Outer control characters and spaces off; separators inside become single spaces, one for one."""
    bare = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.regexp_replace(bare, r"[\x01|\t\n\r\p{Z}]", " ")


def is_word(token: Column) -> Column:
    """Whether a token holds a letter or a digit."""
    return token.rlike(r"[\p{L}\d]")


def hash_bucket(*key: Column, buckets: int = 10_000) -> Column:
    """A bucket that any engine with md5 finds alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") % buckets
