"""From a knowledge base, a relation config and a corpus to models and triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import local_id
from ..operators import annotate, distant, evaluate, features, kg, models, predict, sampling, vectorize, vocab
from .stage import Stage


class RelationExtraction:
    """The stages preprocess, train and full over one work directory.

    docs: doc_id, text, or annotated documents (schemas.CORPUS), whose entities corefs spreads along their mentions. vectors: word, vec. The vocabularies of tags and the word vectors go to the executors as
    dictionaries: a fixed embedding table and a few dozen tags.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, config: DataFrame, wikidata: DataFrame, vectors: DataFrame, work: str, *, lang: str = "en", epochs: int = 5, threshold: float = models.THRESHOLD, suffix: str = "", corefs: bool = False, seed: int = 7, annotator: Callable[[DataFrame], DataFrame] | None = None) -> None:
        if epochs < 0 or not 0 <= threshold <= 1:
            raise ValueError("epochs must be 0 or more and the threshold within 0 and 1")
        self.spark, self.docs, self.config, self.work, self.epochs, self.threshold, self.suffix, self.seed = spark, docs, config, f"{work}/{lang}", epochs, threshold, suffix, seed
        self.vectors_df, self.corefs, self.annotator = vectors, corefs, annotator
        stage = lambda name, build: Stage(spark, f"{self.work}/{name}", build)
        self.pairs = stage("relation_entity_pairs", lambda: kg.relation_pairs(wikidata, config))
        self.sentences = stage("training_sentences", self._training)
        self.points = stage("features", self._points)
        tags = lambda col: vocab.label_vocabulary(self.points.get().select(F.explode(col).alias("token")))
        self.pos = stage("pos_encoder", lambda: tags("pos"))
        self.types = stage("netype_encoder", lambda: vocab.label_vocabulary(self.points.get().select(F.explode(F.array("ent1_type", "ent2_type")).alias("token"))))
        self.deps = stage("dep_encoder", lambda: tags("dependency_path.dependency"))
        self.vectors = stage("vector_features", lambda: sampling.balance_negatives(self._assemble(self.points.get()), [F.col(c) for c in ("doc_id", "sent_id", "subject", "object")], "class_idx"))
        self._net = None

    def _annotated(self) -> DataFrame:
        return self._pairs_in(self.docs)

    def _pairs_in(self, docs: DataFrame) -> DataFrame:
        return distant.sentence_pairs(annotate.sentence_rows(docs, corefs=self.corefs))

    def _training(self) -> DataFrame:
        sents, pairs = self._annotated(), self.pairs.get()
        positive = distant.positive_sentences(sents, pairs)
        n_docs, n_pos = self.docs.count(), positive.count()
        probe = sampling.sample(self.docs, 0.01, [F.col("doc_id")])
        n_probe = probe.count()
        probe = self._pairs_in(probe)
        per_doc = distant.negative_sentences(probe, pairs, self.config.withColumnRenamed("id", "relation")).count() / n_probe if n_probe else 0.0
        fraction = distant.negative_fraction(n_pos, per_doc, n_docs)
        some = self._pairs_in(sampling.sample(self.docs, fraction, [F.col("doc_id")]))
        negative = distant.negative_sentences(some, pairs, self.config.withColumnRenamed("id", "relation"))
        return distant.training_sentences(positive, negative)

    def _points(self) -> DataFrame:
        sents = features.in_training(self._annotated().drop("pairs"), self.sentences.get(), self.config)
        points = features.directed(features.with_features(features.prune_paths(features.entity_pairs(sents, paths=True))))
        return features.prune_types(features.label_points(points), self.config).drop("e1", "e2", "path", "sent", "tokens", "heads")

    def _dictionaries(self) -> list[dict]:
        return [{r["token"]: r["id"] for r in s.get().collect()} for s in (self.pos, self.types, self.deps)]

    def _assemble(self, points: DataFrame) -> DataFrame:
        return vectorize.assemble(points, self.vectors_df, *self._dictionaries())

    def preprocess(self) -> DataFrame:
        return self.vectors.get()

    def train(self) -> None:
        rows = sampling.split(self.preprocess(), [F.col("doc_id"), F.col("sent_id")]).where("is_train")
        path = f"{self.work}/filter_model{self.suffix}"
        if not sources.exists(self.spark, f"{path}/metadata/_SUCCESS"):
            models.fit_filter(rows, "vector", "class_idx").write().overwrite().save(path)
        if self._net is None:
            key = [F.col(c) for c in ("doc_id", "sent_id", "subject", "object")]
            balanced = sampling.balance_classes(rows.drop("copy").where("class_idx > 0"), key, "class_idx")
            self._net = models.fit_network(balanced, self.config.count() + 1, "vector", "class_idx", epochs=self.epochs, checkpoints=f"{self.work}/classification_model{self.suffix}")

    def score(self, points: DataFrame) -> DataFrame:
        model = LogisticRegressionModel.load(f"{self.work}/filter_model{self.suffix}")
        return models.class_probabilities(models.filter_probability(self._assemble(points), model), self._net)

    def extract(self, docs: DataFrame | None = None) -> DataFrame:
        self.train()
        return predict.extract_relations(self.docs if docs is None else docs, self.config, self.score, self.threshold, self.corefs)

    def full(self) -> DataFrame:
        path = f"{self.work}/extractions"
        if not sources.exists(self.spark, f"{path}/_SUCCESS"):
            sources.write_extractions(self.extract(), path)
        return sources.read_extractions(self.spark, path)

    def evaluate_model(self, points: DataFrame, name: str, n_most: int = 100) -> DataFrame:
        """Judged points of one file against what is extracted from their snippets: the table by relation, and the debug rows beside it."""
        folder = f"{self.work}/evaluation/{name}"
        kept = Stage(self.spark, f"{folder}/points", lambda: points.withColumn("point_id", F.monotonically_increasing_id())).get()
        texts = texts_of_points = kept.select(F.col("point_id").alias("doc_id"), evaluate.merged_snippet().alias("text"))
        if self.annotator:  # asked once; a text that it fails on has no sentences
            texts = Stage(self.spark, f"{folder}/annotated", lambda: self.annotator(texts_of_points)).get()
        linked = annotate.sentence_rows(texts, annotate.PREDICT_LENGTH).select(F.col("doc_id").alias("point_id"), F.explode(F.transform("entities", lambda e: local_id(e["id"]))).alias("id"))
        linked = linked.groupBy("point_id").agg(F.collect_set("id").alias("linked"))
        found = Stage(self.spark, f"{folder}/predictions", lambda: predict.known_classes(self.extract(texts))).get()
        found = found.select(F.col("source").cast("long").alias("point_id"), "subject", F.col("predictedPredicate").alias("predicate"), "obj", "probability")
        judged = Stage(self.spark, f"{folder}/judged", lambda: evaluate.judged_predictions(kept, linked, found)).get()
        sources.write_tsv(evaluate.debug_rows(judged), f"{folder}/debug")
        table = evaluate.model_evaluation(judged, n_most)
        sources.write_tsv(table, f"{folder}/result")
        return table

    def evaluate_data(self) -> DataFrame:
        found = self.full().select("subject", F.col("predictedPredicate").alias("predicate"), "obj", "probability")
        known = self.pairs.get().select(F.col("source").alias("subject"), F.col("relation").alias("predicate"), F.col("dest").alias("obj"))
        table = evaluate.data_evaluation(found, known, self.config.select(F.col("id").alias("predicate")))
        sources.write_tsv(table, f"{self.work}/evaluation/data")
        return table
