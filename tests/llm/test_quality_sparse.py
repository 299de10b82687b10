import random

from tripleloom.llm.kn_quality import classify_quality


def test_language_with_few_labels(spark):
    """20 labels and 10 % junk in one language, none and 10 % junk in a null one: the junk goes, the rest stays."""
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(80)]
    good = lambda: " ".join(rng.choices(vocab, range(1, 81), k=60))
    junk = lambda: " ".join(f"{rng.choice('qxz')}{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, good(), "aa") for i in range(300)]
    for lang, first in (("bb", 300), (None, 500)):
        rows += [(first + i, junk() if i % 10 == 0 else good(), lang) for i in range(200)]
    labels = [*range(300), *[i for i in range(300, 500) if i % 10 == 1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = classify_quality(docs, spark.createDataFrame([(i,) for i in labels], "doc_id long")).collect()
    bad = {r.doc_id: r.kept for r in got if r.doc_id >= 300 and r.doc_id % 10 == 0}
    assert len(bad) == 40 and not any(bad.values())
    assert sum(r.kept for r in got) >= 0.97 * (len(rows) - 40)
