"""The stateless part of extraction as a stream: sentences, entities, pairs and known facts of arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import annotate, distant


def document_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def known_mentions(docs: DataFrame, kg: DataFrame) -> DataFrame:
    """Known pairs in the sentences of a stream of documents; the knowledge base is the static side of the join."""
    return distant.known_in_sentences(distant.sentence_pairs(annotate.annotate(docs)), kg)
