"""Knowledge-base rows: typing, property trees and the pairs of configured relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import clean_text

#: Up to so many bytes, as held in memory, a relation table or its pairs are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its size is known to be small. What isn't a local table is kept (memory, then disk), so that measuring it computes it once."""
    if df._jdf.queryExecution().optimizedPlan().nodeName() != "LocalRelation":
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        df = df.select("*")  # reads what is kept, whose statistics are its size
    return F.broadcast(df) if _bytes(df) <= BROADCAST_BYTES else df


def _first_text(name: str, lang: str) -> Column:
    return clean_text(F.coalesce(F.try_element_at(F.filter(name, lambda x: x["lang"] == lang), F.lit(1))["text"], F.lit("")))


def type_entities(rows: DataFrame, lang: str = "en") -> DataFrame:
    """id, description, label, sitelink, aliases in one language, and the properties as a tree."""
    top = F.filter("properties", lambda p: p["parent"].isNull())
    # of several with one idx the last counts
    last = F.filter(top, lambda p, i: ~F.exists(F.slice(top, i + 2, F.size(top)), lambda q: q["idx"] == p["idx"]))
    kids = lambda p: F.transform(
        F.filter("properties", lambda c: c["parent"] == p["idx"]), lambda c: F.struct(clean_text(c["key"]).alias("key"), clean_text(c["value"]).alias("value"), c["datatype"].alias("datatype"))
    )
    tree = F.transform(last, lambda p: F.struct(clean_text(p["key"]).alias("key"), clean_text(p["value"]).alias("value"), p["datatype"].alias("datatype"), kids(p).alias("children")))
    return rows.select(
        "id", _first_text("descriptions", lang).alias("description"), _first_text("labels", lang).alias("label"), _first_text("sitelinks", lang).alias("sitelink"),
        F.transform(F.filter("aliases", lambda x: x["lang"] == lang), lambda x: clean_text(x["text"])).alias("aliases"), tree.alias("properties"),
    )


def relation_pairs(rows: DataFrame, config: DataFrame) -> DataFrame:
    """relation, source, dest: distinct top-level properties of the typed entities, cleaned, whose key is a configured relation."""
    props = type_entities(rows).select("id", F.inline("properties"))
    found = props.join(small(config.select(F.col("id").alias("key")).distinct()), "key")
    return found.select(F.col("key").alias("relation"), F.col("id").alias("source"), F.col("value").alias("dest")).distinct()


def with_config(pairs: DataFrame, config: DataFrame) -> DataFrame:
    """Names and class of each relation; of several config rows with one id the first counts."""
    first = config.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("class_idx"))).where("rn = 1").drop("rn")
    return pairs.join(small(first.withColumnRenamed("id", "relation")), "relation")


def group_pairs(pairs: DataFrame) -> DataFrame:
    """relation with the sorted array of its pairs; for the export of configured relations, which are few and small."""
    return pairs.groupBy("relation").agg(F.sort_array(F.collect_list(F.struct("source", "dest"))).alias("entities"))
