"""Readers and writers of the relation-extraction files. Paths are Hadoop URIs of any file system Spark knows."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_corpus(spark: SparkSession, path: str, sample: float = 1.0, seed: int = 7) -> DataFrame:
    """Articles of a corpus, all or a seeded share, with the annotation columns that it has."""
    has = set(spark.read.parquet(path).columns)
    docs = spark.read.schema(StructType([f for f in schemas.CORPUS if f.name in has])).parquet(path).where("type = 'ARTICLE'")
    return docs if sample >= 1 else docs.sample(False, sample, seed)


def read_relation_config(spark: SparkSession, path: str) -> DataFrame:
    """name, id, subject_type, object_type, class_idx: tab-separated lines, classes from 1 in their order."""
    text = spark.read.text(path, wholetext=True)  # a file of a few lines
    rows = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "row")).where("row <> ''")
    part = F.split("row", "\t")
    order = Window.orderBy("line")
    return rows.select(*[F.get(part, i).alias(n) for i, n in enumerate(schemas.RELATION_CONFIG.fieldNames())], F.row_number().over(order).alias("class_idx"))


def read_wikidata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WIKIDATA).parquet(path)


def read_evaluation_points(spark: SparkSession, path: str) -> DataFrame:
    """Judged points; ids that the linker left false read as the string false."""
    return spark.read.schema(schemas.EVALUATION_POINT).json(path)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EXTRACTION).json(path)


def write_extractions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_relations(df: DataFrame, path: str) -> None:
    """Pairs of the configured relations, one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """Parquet, and JSON beside it for reading by eye."""
    df.write.mode("overwrite").parquet(path)
    df.write.mode("overwrite").json(f"{path}_json")


def write_tsv(df: DataFrame, path: str) -> None:
    """A report: one tab-separated file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def link_ids(points: DataFrame, mapping: DataFrame, columns: tuple[str, ...] = ("sub", "obj", "pred")) -> DataFrame:
    """Adds wd_<column> by an id-mapping table(source_id, wd_id); what it lacks becomes the string false."""
    for c in columns:
        m = mapping.select(F.col("source_id").alias("m_id"), F.col("wd_id").alias("m_wd"))
        points = points.join(m, F.col(c) == F.col("m_id"), "left").withColumn(f"wd_{c}", F.coalesce("m_wd", F.lit("false"))).drop("m_id", "m_wd")
    return points


def read_word2vec(spark: SparkSession, vocab: str, vectors: str, rows_a_task: int = 50_000) -> DataFrame:
    """word, vec from a vocabulary file (a count, then a word a line) and a file of an int32 length and float32 rows.

    Rows have one length, so each task opens the file at its own rows: it may have any size, and the driver reads its
    length only. The vectors' file system is one that pyarrow opens (local, hdfs, s3, gs).
    """
    from pyarrow.fs import FileSystem

    def at(path: str):
        fs, p = FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
        return fs.open_input_file(p)

    words = spark.read.text(vocab, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "word")).where("line > 0 and word <> ''")
    with at(vectors) as f:
        dim, size = int(np.frombuffer(f.read(4), "<i4")[0]), f.size()
    n = (size - 4) // (4 * dim)

    def cut(batches):
        for batch in batches:
            for start in batch.column("id").to_pylist():
                with at(vectors) as f:
                    f.seek(4 + start * 4 * dim)
                    flat = np.frombuffer(f.read(min(rows_a_task, n - start) * 4 * dim), "<f4")
                lines = np.arange(start + 1, start + 1 + len(flat) // dim, dtype=np.int32)
                yield pa.record_batch([pa.array(lines), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat))], names=["row", "vec"])

    rows = spark.range(0, n, rows_a_task, max(1, -(-n // rows_a_task))).mapInArrow(cut, "row int, vec array<float>")
    return words.join(rows, F.col("line") == F.col("row")).select("word", "vec")


def write_word2vec(rows: list[tuple[str, list[float]]], folder: str) -> tuple[str, str]:
    """The two files from words and vectors; for fixtures."""
    os.makedirs(folder or tempfile.mkdtemp(), exist_ok=True)
    v, m = f"{folder}/model.opt.vocab", f"{folder}/model.opt.vecs"
    with open(v, "w", encoding="utf-8") as f:
        f.write("\n".join([str(len(rows)), *(w for w, _ in rows)]))
    with open(m, "wb") as f:
        f.write(np.int32(len(rows[0][1])).tobytes() + np.array([x for _, x in rows], "<f4").tobytes())
    return v, m


def annotate_remote(docs: DataFrame, url: str, timeout_s: float = 60.0, connect_s: float = 5.0) -> DataFrame:
    """Documents (doc_id, text) with the annotation columns of schemas.CORPUS that a service gives for the posted text, and error.

    A text whose request fails (no connection, time-out, another status than 200, no JSON) stays as a row with null
    annotation and the error's text; the others' error is null.
    """
    import json
    from urllib.parse import urlsplit

    from pyspark.sql.pandas.types import to_arrow_schema

    given = [f for f in schemas.CORPUS if f.name not in ("doc_id", "text")]
    names = [f.name for f in given]
    schema = StructType([docs.schema["doc_id"], docs.schema["text"], *given, StructField("error", StringType())])
    arrow = to_arrow_schema(schema)
    to = urlsplit(url)

    def post(text: str) -> dict:
        import http.client

        kind = http.client.HTTPSConnection if to.scheme == "https" else http.client.HTTPConnection
        c = kind(to.hostname, to.port, timeout=connect_s)
        try:
            c.connect()
            c.sock.settimeout(timeout_s)
            c.request("POST", (to.path or "/") + (f"?{to.query}" if to.query else ""), text.encode("utf-8"), {"Content-Type": "text/plain; charset=utf-8"})
            reply = c.getresponse()
            if reply.status != 200:
                raise OSError(f"status {reply.status}")
            found = json.loads(reply.read())
            return {n: found.get(n) for n in names}
        finally:
            c.close()

    def one(doc_id, text) -> dict:
        import http.client

        row = dict.fromkeys(names) | {"doc_id": doc_id, "text": text, "error": None}
        try:
            # a reply that doesn't have the columns' types is an error of its document, not of the batch
            return pa.Table.from_pylist([row | post(text or "")], schema=arrow).to_pylist()[0]
        except (OSError, ValueError, TypeError, AttributeError, http.client.HTTPException, pa.ArrowException) as e:
            return row | {"error": f"{type(e).__name__}: {e}"}

    def run(batches):
        for batch in batches:
            rows = [one(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def evidence_documents(points: DataFrame) -> DataFrame:
    """point_id, evidence (its place from 0), url, text: a document for each piece of evidence of judged points that has a text."""
    rows = points.select("point_id", F.posexplode("evidences").alias("evidence", "e"))
    return rows.select("point_id", "evidence", F.col("e.url").alias("url"), F.col("e.snippet").alias("text")).where("text is not null")
