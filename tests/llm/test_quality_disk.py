"""Neither the models' n-grams nor the texts' are ever stored whole."""

import math
from collections import Counter
from pathlib import Path

import numpy as np

from test_models import brute_kn
from tripleloom.llm import common, kn_quality
from tripleloom.llm.kn_quality import classify_quality, perplexities


def test_stored_tables_stay_below_the_input(spark, sf_dir, monkeypatch):
    """What the operator has in the shared folder at any time is less than the documents' own files; every document is judged."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    stored, most = {}, [0]

    def materialise(df, name):
        out = common.materialise(df, name)
        stored[out.stored_at] = sum(p.stat().st_size for p in Path(out.stored_at.removeprefix("file:")).rglob("*.parquet"))
        most[0] = max(most[0], sum(stored.values()))
        return out

    def discard(*tables):
        common.discard(*tables)
        for df in tables:
            stored.pop(df.stored_at)

    monkeypatch.setattr(kn_quality, "materialise", materialise)
    monkeypatch.setattr(kn_quality, "discard", discard)
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    trusted = spark.read.parquet(f"{larger}/labels.parquet").where("quality = 1").select("doc_id")
    assert classify_quality(docs, trusted).count() == docs.count()
    files = Path(f"{larger}/documents.parquet")
    assert most[0] < sum(p.stat().st_size for p in ([files] if files.is_file() else files.rglob("*.parquet")))


def test_hot_words_over_all_shards(spark, monkeypatch):
    """Words dealt over many shards, rare words outside the table, repeated texts, many rounds and sendings: as by brute force."""
    for name, value in (("SHARD", 60), ("OFTEN", 1), ("TABLE_BITS", 3), ("ROUND_WORDS", 300), ("HELD", 50), ("EACH", 1)):
        monkeypatch.setattr(kn_quality, name, value)
    rng = np.random.default_rng(0)
    vocab, share = [f"w{i}" for i in range(300)], 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(vocab, 30, p=share / share.sum())) for _ in range(60)]
    texts += texts[:3]
    others = [" ".join(rng.choice([*vocab, "new"], 40, p=[*(0.9 * share / share.sum()), 0.1])) for _ in range(20)] + ["", "w0 w0 w0 w0", texts[0], texts[0]]
    logp = brute_kn(texts)[0]
    rows = spark.createDataFrame(list(enumerate(others)), "id long, text string").repartition(3)
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    dealt, hot = kn_quality.dealt, []
    monkeypatch.setattr(kn_quality, "dealt", lambda *a, **b: hot.append(len(a[4].value)) or dealt(*a, **b))
    got = perplexities(rows, train).collect()
    assert Counter(r.id for r in got) == Counter(range(len(others))) and hot[0] > 2
    for r in got:
        assert math.isclose(r.log_perplexity * r.n_tokens, -logp(others[r.id]), rel_tol=1e-6, abs_tol=1e-6)
