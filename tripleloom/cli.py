"""Command line: work through the stages to the depth asked for."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import sources
from .operators import models
from .plans.relation_extraction import RelationExtraction


def bounded(low: float, high: float, open_low: bool = False):
    def check(value: str) -> float:
        x = float(value)
        if not (low < x if open_low else low <= x) or x > high:
            raise argparse.ArgumentTypeError(f"{value} isn't between {low} and {high}")
        return x

    return check


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tripleloom", description=__doc__)
    for name in ("corpus_path", "relation_config", "wiki_data", "temp_data_path", "word2vec_path"):
        p.add_argument(name)
    p.add_argument("--sample-size", type=bounded(0, 1, True), default=1.0)
    p.add_argument("--probability-cutoff", type=bounded(0, 1), default=models.THRESHOLD)
    p.add_argument("--corefs", action="store_true")
    p.add_argument("--demo-server", action="store_true")
    p.add_argument("--data-evaluation", action="store_true")
    p.add_argument("--model-evaluation-files", nargs="*", default=[])
    p.add_argument("--annotator-url", help="service that annotates the texts of model evaluation")
    p.add_argument("--epochs", type=int, default=5)
    p.add_argument("--language", choices=("en", "sv"), default="en")
    p.add_argument("--stage", choices=("preprocess", "train", "full"), default="full")
    p.add_argument("--name", default="tripleloom")
    p.add_argument("--model-suffix", default="")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(a.name).getOrCreate()
    docs = sources.read_corpus(spark, a.corpus_path, a.sample_size)
    config, wikidata = sources.read_relation_config(spark, a.relation_config), sources.read_wikidata(spark, a.wiki_data)
    vectors = sources.read_word2vec(spark, f"{a.word2vec_path}/model.opt.vocab", f"{a.word2vec_path}/model.opt.vecs")
    annotator = (lambda texts: sources.annotate_remote(texts, a.annotator_url)) if a.annotator_url else None
    plan = RelationExtraction(spark, docs, config, wikidata, vectors, a.temp_data_path, lang=a.language, epochs=a.epochs, threshold=a.probability_cutoff, suffix=a.model_suffix, corefs=a.corefs, annotator=annotator)
    plan.preprocess()
    if a.stage != "preprocess":
        plan.train()
    if a.stage == "full":
        plan.full()
    if a.data_evaluation:
        plan.evaluate_data()
    for path in a.model_evaluation_files:
        plan.evaluate_model(sources.read_evaluation_points(spark, path), path.rsplit("/", 1)[-1])
    if a.demo_server:
        from .serve import serve

        serve(spark, plan, a.language)


if __name__ == "__main__":
    main()
