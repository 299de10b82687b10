"""From raw documents to packed training sequences: each stage works on what the one before kept.

Stages return the columns of their input. Null texts are empty and go with the first stage, as they have too few words.
Rows that share an id, or have none, are documents of their own throughout; rows that repeat whole leave one. Ties go to
the smallest id, then the smallest row. Columns of any name pass through; n_chars, if there, is that of the new text.
Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import discard, materialise
from tripleloom.llm.exact_dedup import survivors
from tripleloom.llm.mixing import mix_sources
from tripleloom.llm.ngram_join import jaccard_components
from tripleloom.llm.packing import pack
from tripleloom.llm.quality_rules import quality_rules

#: SQL cannot express the packing's token ids; tests/llm holds each stage and all in a row against brute force.
ORACLE_SQL = None
#: Where a word ends and white space follows.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def carried(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs out of rows' struct `carried`, with a new text and its length where n_chars tells it."""
    out = {c: F.col("carried")[c] for c in docs.columns}
    if text is not None:
        rows = rows.select("carried", text.alias("text"))
        out["text"] = F.col("text")
        if "n_chars" in out:
            out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in out.items()])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines leave the texts, rejected documents leave the table."""
    return carried(quality_rules(docs, carry=docs.columns).where("kept"), docs, F.col("cleaned_text"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    return survivors(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts stays, the one with the smallest id, then the smallest stored row number: five words, similarity 0.8."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("carried")), "near-rows")
    found = jaccard_components(rows.select("row", "carried.text"), id_col="row", width=5, percent=80)
    # a component is named after its smallest row
    others = materialise(found.where("row <> component_id").select(F.col("row").alias("r"), "component_id"), "near-others")
    members = others.unionByName(others.select(F.col("component_id").alias("r"), "component_id").distinct())
    members = materialise(members.join(rows.select("row", "carried.doc_id"), F.col("r") == F.col("row")).select("r", "doc_id", "component_id"), "near-members")
    discard(others)
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r")).alias("best"))
    drop = members.join(best.select(F.col("component_id").alias("c"), F.col("best.r").alias("stays")), F.col("component_id") == F.col("c")).where("r <> stays").select("r")
    return carried(rows.join(drop, F.col("row") == F.col("r"), "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in the mix's order. A source's line ends inside one document, which then gives its text up to that word's end."""
    rows = mix_sources(docs, carry=docs.columns)
    rows = rows.select("carried", "size", "taken", "mix_words", F.posexplode("places").alias("copy", "place"))
    rows = rows.withColumn("part", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
    text = F.col("carried.text")
    cut = F.array_join(F.slice(F.split(text, WORD_END), F.lit(1), F.col("part").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("part") == F.col("size"), text).otherwise(cut)).select("carried", "text", "place", "mix_words")
    # equal shares of the mix, one after the other
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionById(n, F.floor(F.col("place") / F.col("mix_words") * n).cast("int")).sortWithinPartitions("place")
    return carried(rows, docs, F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", clean),
    ("exact_dedup", dedup_exact),
    ("ngram_jaccard", dedup_near),
    ("mix_sources", mix),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
            discard(*stored)
            stored = [docs]
    return docs
