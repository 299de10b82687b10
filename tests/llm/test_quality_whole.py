"""All trusted documents fit the models and set the thresholds."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from test_models import brute_kn
from tripleloom.llm import kn_quality
from tripleloom.llm.kn_quality import classify_quality


def test_every_trusted_document_counts(spark, monkeypatch):
    """Each half's model against brute force, in several rounds; thresholds from every trusted document; a row for each row."""
    monkeypatch.setattr(kn_quality, "ROUND_WORDS", 500)
    rng = np.random.default_rng(3)
    vocab, share = [f"w{i}" for i in range(300)], 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(vocab, 30, p=share / share.sum())), "ab"[i % 2]) for i in range(90)]
    rows += [(200, "new words here " * 10, None), rows[85], rows[3], (None, rows[4][1], "a"), (201, None, "a")]
    trusted = range(80)
    half = {r.id: r.half for r in spark.range(80).select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("half")).collect()}
    logp = [brute_kn([t for i, t, _ in rows if half.get(i) == k])[0] for k in (0, 1)]

    def want(i, t):
        by = [logp[1 - half[i]]] if i in half else logp
        return -sum(f(t) for f in by) / len(by) / (len((t or "").split()) + 1)

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = classify_quality(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), min_held=10, quantile=0.9).collect()
    assert Counter((r.doc_id, r.lang, r.n_tokens) for r in got) == Counter((i, x, len((t or "").split()) + 1) for i, t, x in rows)
    texts = {i: t for i, t, _ in rows}
    assert all(abs(math.log(r.perplexity) - want(r.doc_id, texts[r.doc_id])) < 2e-3 for r in got)
    for lang in ("a", "b", None):
        held = sorted(want(i, t) for i, t, x in rows if i in half and lang in (x, None))
        quantile = held[math.ceil(0.9 * len(held)) - 1]
        assert all(abs(math.log(r.threshold) - quantile) < 2e-3 for r in got if r.lang == lang)


def test_trusted_text_in_one_half(spark):
    """One trusted document: its model judges all, nothing is held out, all stay."""
    rows = [(i, f"some words of text {i} " * 8, "a") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = classify_quality(docs, spark.createDataFrame([(2,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3] and all(r.kept and r.perplexity > 1 for r in got)
