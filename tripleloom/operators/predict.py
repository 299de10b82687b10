"""Extraction: documents to triples with probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import PREDICT_LENGTH, sentence_rows
from .features import directed, entity_pairs, prune_types, with_features
from .kg import small
from .models import THRESHOLD, two_stage

UNKNOWN_CLASS = "<unknown_class>"


def candidate_points(docs: DataFrame, corefs: bool = False) -> DataFrame:
    """Directed entity pairs with features from all sentences of prediction length; paths may be empty."""
    return with_features(directed(entity_pairs(sentence_rows(docs, PREDICT_LENGTH, corefs), paths=True)))


def name_predicates(points: DataFrame, config: DataFrame) -> DataFrame:
    names = config.select(F.col("class_idx").alias("c"), F.col("id").alias("rid"))
    rows = points.join(small(names), F.col("class_idx") == F.col("c"), "left").drop("c")
    return rows.withColumn("predicate", F.coalesce("rid", F.concat(F.lit(f"{UNKNOWN_CLASS}: "), F.col("class_idx").cast("string")))).drop("rid")


def extract_relations(docs: DataFrame, config: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD, corefs: bool = False) -> DataFrame:
    """Triples with sentence, source and the three probabilities. score adds filter_probability and class_probabilities."""
    scored = score(candidate_points(docs, corefs)).withColumn("p", two_stage(F.col("filter_probability"), F.col("class_probabilities"), threshold))
    rows = scored.withColumn("class_idx", F.col("p.class_idx")).where("class_idx <> 0")
    rows = name_predicates(prune_types(rows, config), config)
    return rows.select(
        F.col("subject"), F.col("predicate").alias("predictedPredicate"), F.col("object").alias("obj"), F.col("sent").alias("sentence"), F.col("doc_id").cast("string").alias("source"),
        F.col("p.probability").alias("probability"), F.col("p.filter_prob").alias("filterProbability"), F.col("p.class_prob").alias("classificationProbability"),
    )


def known_classes(extractions: DataFrame) -> DataFrame:
    return extractions.where(~F.contains("predictedPredicate", F.lit(UNKNOWN_CLASS)))
