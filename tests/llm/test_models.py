import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tripleloom.llm import kn_quality, lm_score
from tripleloom.llm.kn_quality import classify_quality
from tripleloom.llm.lm_score import score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), "\n"]


@pytest.mark.parametrize("table", ["edge", "corpus", "empty"])
@pytest.mark.parametrize("bits", [20, 3])
def test_base_score(table, bits, request, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD_BITS", bits)  # few words in the table: the others take the join
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for d, t in rows)
    got = score_documents(docs).collect()
    assert Counter((r[0], r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    if table == "corpus":
        for flag in (False, True):
            assert sum(r.score for r in got if r.held_out == flag) > sum(r.base_score for r in got if r.held_out == flag)


def test_score_does_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    """The same scores from 1 and 64 partitions; held-out text scores above word frequencies, also with several shards a round."""
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    scores = []
    for n, shard in ((1, lm_score.SHARD), (64, lm_score.SHARD), (16, 15_000)):
        monkeypatch.setattr(lm_score, "SHARD", shard)
        monkeypatch.setattr(lm_score, "SHARD_UNITS", 0)
        got = score_documents(docs.repartition(n)).collect()
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
        scores.append({r.doc_id: r.score for r in got})
    assert scores[0] == pytest.approx(scores[1], abs=1e-4)


def test_units_grow():
    assert [lm_score.n_units(n) for n in (0, 10**6, 10**8)] == [2048, 2048, 53**2 - 256]
    assert lm_score.n_units(10**10) > 24_000 and lm_score.n_units(10**12) > 9 * lm_score.n_units(10**10)


def test_score_is_normalised():
    model = lm_score.Model(np.arange(1, lm_score.UNITS + lm_score.GROUPS + 1, dtype=float))
    rng = np.random.default_rng(0)
    n = lm_score.UNITS + lm_score.GROUPS
    slots = rng.integers(0, n, 400)
    for _ in range(5):
        model.step(slots, np.arange(400))
    context = [5, 900, 17, 3]
    all_last = np.concatenate([[*context, s] for s in range(n)])
    p = model.log10(all_last, np.tile(np.arange(5), n)).reshape(n, 5)[:, 4]
    assert abs((10.0**p).sum() - 1) < 1e-3


def test_contrast_learns_pairs():
    """On text where each word fixes the next, the model gets far better than word frequencies."""
    model = lm_score.Model(np.where(np.arange(lm_score.UNITS + lm_score.GROUPS) < 40, 1000.0, 0.0))
    slots = np.tile(np.arange(40), 2000)
    start = np.arange(len(slots))
    before = model.log10(slots[:4000], start[:4000]).mean()
    for at in range(0, len(slots), lm_score.STEP):
        model.step(slots[at : at + lm_score.STEP], start[at : at + lm_score.STEP])
    assert model.log10(slots[:4000], start[:4000]).mean() > before + 0.3


def brute_kn(texts):
    """log p(text) by the recursion of the interpolated modified model."""
    pad = lambda t: ["<s>", "<s>", *WORD.findall(t.translate(LOW)), "</s>"]
    three = Counter(tuple(w[i : i + 3]) for w in map(pad, texts) for i in range(len(w) - 2))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def discounts(c):
        n = [sum(1 for v in c.values() if v == k) for k in range(5)]
        if not all(n[1:]):
            return [0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        found = 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]
        assert all(0 < d < k for k, d in enumerate(found, 1)) and found[2] > 1
        return found

    tables = []
    for c in (one, two, three):
        d, by = discounts(c), {}
        for g, v in c.items():
            x = by.setdefault(g[:-1], [0, 0.0])
            x[0] += v
            x[1] += d[min(v, 3) - 1]
        tables.append((c, d, by))

    def p(g):
        c, d, by = tables[len(g) - 1]
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(one) + 1)
        if g[:-1] not in by:
            return lower
        total, left = by[g[:-1]]
        v = c.get(g, 0)
        return ((v - d[min(v, 3) - 1] if v else 0) + left * lower) / total

    def logp(t):
        w = pad(t or "")
        return sum(math.log(p(tuple(w[i : i + 3]))) for i in range(len(w) - 2))

    return logp, p, [g[0] for g in one]


def test_kneser_ney(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab, 30, p=np.arange(1, 61) / 1830)) for _ in range(60)]
    others = [" ".join(rng.choice([*vocab, "new"], n)) for n in (1, 5, 40, 200)] + ["", None, "new new new", texts[3], "W3 w5"]
    logp, p, types = brute_kn(texts)
    assert abs(sum(p(("w59", "w58", x)) for x in [*types, "never"]) - 1) < 1e-9
    rows = spark.createDataFrame(list(enumerate(others)), "id long, text string").selectExpr("id", "coalesce(text, '') text")
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    for bits in (21, 4):  # nearly all n-grams in the table, or nearly all by the join
        monkeypatch.setattr(kn_quality, "TABLE_BITS", bits)
        got = {r.id: r.log_perplexity * r.n_tokens for r in kn_quality.perplexities(rows, train).collect()}
        for i, t in enumerate(others):
            assert abs(got[i] + logp(t)) < 1e-3 * (1 + abs(logp(t))), (i, got[i], logp(t))


def test_classifier(spark, edge, empty, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    got = classify_quality(spark.read.parquet(f"{larger}/documents.parquet"), labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.5 * len(bad)
    trusted = edge.where("doc_id < 9").select("doc_id")
    out = classify_quality(edge, trusted).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in edge.collect())
    assert classify_quality(empty, trusted).count() == 0
    none = classify_quality(edge, trusted.where("false")).collect()
    assert all(r.kept for r in none) and len(none) == len(out)
