"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the operators define them (Java regular expressions).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Python functions of this subpackage travel to the executors by value, so these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; the fast built-in does it for texts that are all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """array<string> of the words of a text that is not null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often a lambda in body reads it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tripleloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there and lost executors cost no recomputation.

    Tables lie in a folder of the application, which goes when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tripleloom-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _hadoop(spark, folder)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise wrote and nothing will read again, and the shuffle files of their plans."""
    for df in tables:
        p, fs = _hadoop(df.sparkSession, df.stored_at)
        fs.delete(p, True)
    if tables:
        sweep(tables[0].sparkSession)
