"""Filter and classification models, two-stage scoring and metrics.

The filter is Spark ML's logistic regression. The classifier is a dense network 512-256 with ReLU, dropout and Adam,
trained in numpy inside the partitions and averaged between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..sources import exists

THRESHOLD = 0.75


def fit_filter(points: DataFrame, features: str = "vector", label: str = "label", max_iter: int = 10) -> LogisticRegressionModel:
    """Whether a point is any relation at all: label 0 against the rest."""
    rows = points.select(array_to_vector(F.col(features)).alias("features"), (F.col(label) != 0).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=0.0, fitIntercept=True).fit(rows)


def filter_probability(points: DataFrame, model: LogisticRegressionModel, features: str = "vector") -> DataFrame:
    scored = model.transform(points.withColumn("features", array_to_vector(F.col(features)))).withColumn("filter_probability", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


class Network:
    """Dense ReLU layers and a softmax; Adam; dropout while training only."""

    def __init__(self, sizes: list[int], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(2 / (a + b)), (a, b)).astype(np.float32) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b, np.float32) for b in sizes[1:]]
        self.moments: tuple[list[np.ndarray], list[np.ndarray]] | None = None
        self.steps = 0

    def forward(self, x: np.ndarray, rng=None, drop: float = 0.0) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = out[-1] @ w + b
            if i < len(self.w) - 1:
                x = np.maximum(x, 0)
                if rng is not None and drop:
                    x *= (rng.random(x.shape) > drop) / (1 - drop)
            out.append(x)
        e = np.exp(out[-1] - out[-1].max(1, keepdims=True))
        out[-1] = e / e.sum(1, keepdims=True)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, batch: int = 256, rate: float = 1e-3, drop: float = 0.5, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.w, *self.b]
        # moments go on from call to call
        m, v = self.moments = self.moments or ([np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                acts = self.forward(x[rows], rng, drop)
                delta = acts[-1].copy()
                delta[np.arange(len(rows)), y[rows]] -= 1
                delta /= len(rows)
                gw, gb = [], []
                for i in range(len(self.w) - 1, -1, -1):
                    gw.insert(0, acts[i].T @ delta + decay * self.w[i])
                    gb.insert(0, delta.sum(0))
                    if i:
                        delta = (delta @ self.w[i].T) * (acts[i] > 0)
                self.steps = t = self.steps + 1
                for j, (p, g) in enumerate(zip(params, [*gw, *gb], strict=True)):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)


def fit_network(points: DataFrame, n_classes: int, features: str = "vector", label: str = "label", hidden: tuple[int, ...] = (512, 256), epochs: int = 5, seed: int = 3, checkpoints: str | None = None) -> Network:
    """Parameter averaging: each round every partition trains an epoch from the common parameters; rows of class 0 are left out.

    checkpoints: a folder that keeps the network after each epoch, and from whose last one training goes on.
    """
    if epochs < 1:
        raise ValueError("a network of 0 epochs has nothing to predict with")
    rows = points.where(F.col(label) != 0).select(F.col(features).cast("array<float>").alias("x"), F.col(label).cast("int").alias("y"))
    spark = points.sparkSession
    first, net = 0, Network([len(rows.first()["x"]), *hidden, n_classes], seed)
    for done in range(epochs, 0, -1) if checkpoints else ():
        if exists(spark, f"{checkpoints}/epoch-{done}/_SUCCESS"):
            first, net = done, load_network(spark, f"{checkpoints}/epoch-{done}")
            break
    for epoch in range(first, epochs):
        shared = points.sparkSession.sparkContext.broadcast((net.w, net.b))  # the network's own size

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            local, n = Network([1, 1]), 0
            w, b = shared.value
            local.w, local.b = [x.copy() for x in w], [x.copy() for x in b]
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    local.train(x, batch.column("y").to_numpy(), 1, seed + epoch)
                    n += batch.num_rows
            if n:
                parts = [*local.w, *local.b]
                yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([(p.astype(np.float64) * n).tobytes() for p in parts], pa.binary()), pa.array([n] * len(parts), pa.int64())], names=["part", "sum", "n"])

        def total(t: pa.Table) -> pa.Table:
            out = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("sum"))
            return pa.table([t.column("part").slice(0, 1), pa.array([out.tobytes()], pa.binary()), pa.array([sum(t.column("n").to_pylist())], pa.int64())], names=["part", "sum", "n"])

        kinds = "part int, sum binary, n long"
        sums = rows.mapInArrow(run, kinds).withColumn("group", F.spark_partition_id() % 16).groupBy("part", "group").applyInArrow(total, kinds).groupBy("part").applyInArrow(total, kinds)
        flat = [*net.w, *net.b]
        new = {r["part"]: np.frombuffer(r["sum"], np.float64) / r["n"] for r in sums.collect()}  # one row a layer
        flat = [new[i].reshape(p.shape).astype(np.float32) for i, p in enumerate(flat)]
        net.w, net.b = flat[: len(net.w)], flat[len(net.w) :]
        if checkpoints:
            save_network(spark, net, f"{checkpoints}/epoch-{epoch + 1}")
    return net


def save_network(spark: SparkSession, net: Network, path: str) -> None:
    """A row for each layer's weights and each layer's biases."""
    rows = [(i, list(p.shape), bytearray(p.astype("<f4").tobytes())) for i, p in enumerate([*net.w, *net.b])]
    spark.createDataFrame(rows, "part int, shape array<int>, floats binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network:
    parts = [np.frombuffer(r["floats"], "<f4").reshape(r["shape"]).copy() for r in spark.read.parquet(path).orderBy("part").collect()]  # two rows a layer
    net = Network([1, 1])
    net.w, net.b = parts[: len(parts) // 2], parts[len(parts) // 2 :]
    return net


def class_probabilities(points: DataFrame, net: Network, features: str = "vector") -> DataFrame:
    """Adds class_probabilities (array<double>)."""
    shared = points.sparkSession.sparkContext.broadcast((net.w, net.b))
    schema = points.select("*", F.lit(None).cast("array<double>").alias("class_probabilities")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Network([1, 1])
        local.w, local.b = shared.value
        for batch in batches:
            x = np.stack([np.asarray(v, np.float32) for v in batch.column(features).to_pylist()]) if batch.num_rows else np.zeros((0, local.w[0].shape[0]), np.float32)
            p = local.forward(x)[-1].astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names, "class_probabilities"])

    return points.mapInArrow(run, schema)


def two_stage(filter_p: Column, probabilities: Column, threshold: float = THRESHOLD) -> Column:
    """struct(class_idx, probability, filter_prob, class_prob): class 0 below the threshold of either stage."""
    best = F.array_max(probabilities)
    both = filter_p * best

    def row(c, p, q):
        return F.struct(c.cast("int").alias("class_idx"), p.alias("probability"), filter_p.alias("filter_prob"), q.alias("class_prob"))

    return (
        F.when(filter_p < threshold, row(F.lit(0), 1 - filter_p, F.lit(0.0))).when(both < threshold, row(F.lit(0), 1 - both, best))
        .otherwise(row(F.array_position(probabilities, best) - 1, both, best))
    )


def binary_curve(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 100) -> DataFrame:
    """threshold (bin's lower end), tp, fp, precision, recall, f1: scores binned first, so the windows see `bins` rows."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    per = scored.groupBy(b.alias("bin")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).withColumn("all_p", F.sum("p").over(Window.partitionBy()))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("all_p"))
    return per.select((F.col("bin") / bins).alias("threshold"), "tp", "fp", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def area_under_pr(curve: DataFrame) -> DataFrame:
    """auprc: the trapezoids under binary_curve's precision over recall, from recall 0 with the first precision."""
    down = Window.orderBy(F.desc("threshold"))  # a row for each bin
    p0 = F.coalesce(F.lag("precision").over(down), F.col("precision"))
    rows = curve.select(((F.col("recall") - F.lag("recall", 1, 0.0).over(down)) * (F.col("precision") + p0) / 2).alias("part"))
    return rows.agg(F.sum("part").alias("auprc"))


def area_under_roc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """auroc: the share of positive-negative pairs in the right order, ties half, from one row for each distinct score."""
    per = scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    # scores are ordered in parts that round alike; only the parts' sums meet in one task
    per = per.withColumn("part", F.round(score, 4))
    sums = per.groupBy(F.col("part").alias("q")).agg(F.sum("n").alias("all"))
    starts = sums.select("q", (F.sum("all").over(Window.orderBy("q")) - F.col("all")).alias("start"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(score)) - F.col("n")
    per = per.withColumn("within", within).join(starts, F.col("part").eqNullSafe(F.col("q")))
    per = per.withColumn("wins", F.col("p") * (F.col("start") + F.col("within") + F.col("n") / 2))
    return per.agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(ratio(F.col("w"), F.col("p") * F.col("n")).alias("auroc"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(label, prediction).agg(F.count("*").alias("n"))


def class_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class_idx, tp, n_label, n_predicted, precision, recall, f1 from the confusion counts."""
    c = confusion(pred, label, prediction)
    rows = c.select(F.col(label).alias("class_idx"), F.col("n").alias("l"), F.lit(0).cast("long").alias("q"), F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("t"))
    rows = rows.unionByName(c.select(F.col(prediction).alias("class_idx"), F.lit(0).cast("long").alias("l"), F.col("n").alias("q"), F.lit(0).cast("long").alias("t")))
    per = rows.groupBy("class_idx").agg(F.sum("t").alias("tp"), F.sum("l").alias("n_label"), F.sum("q").alias("n_predicted"))
    p, r = ratio(F.col("tp"), F.col("n_predicted")), ratio(F.col("tp"), F.col("n_label"))
    return per.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))
