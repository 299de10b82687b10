import random

from tripleloom.llm.substring_dedup import substring_dedup


def prose(rng, n, short):
    """Sentences of 2 to 7 words, or of 25 to 40."""
    out = []
    while len(out) < n:
        out += [rng.choice("abcdefghij") + str(rng.randrange(10**7)) for _ in range(rng.randint(2, 7) if short else rng.randint(25, 40))]
        out[-1] += "."
    return out[:n]


def test_passages_inside_lines(spark):
    """Passages of 51 to 120 words, pasted mid-line into two documents from any word to any word, go whole from the later one."""
    rng = random.Random(9)
    rows, own = [], {}
    for i in range(60):
        words = prose(rng, 200, i % 2 == 0)
        n = rng.randint(51, 120)
        at = rng.randrange(200 - n)
        passage = words[at : at + n]
        for j in (0, 1):
            left, right = prose(rng, 30, i % 3 == 0), prose(rng, 30, i % 3 == 0)
            rows.append((2 * i + j, " ".join([*left, *passage, *right])))
            own[2 * i + j] = [*left, *(passage if j == 0 else []), *right]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {d: r.text.split() for d, r in out.items()} == own
    assert all(r.n_removed == r.doc_id % 2 for r in out.values())


def test_shorter_runs_stay(spark):
    rng = random.Random(4)
    common = prose(rng, 30, False)[:24]
    texts = [" ".join([*prose(rng, 40, False)[:39], *common, *prose(rng, 40, False)]) for _ in range(4)]
    out = substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.n_removed == 0 and r.text == texts[r.doc_id] for r in out)


def test_periodic_text(spark):
    """A text that repeats itself keeps a first stretch."""
    period = [f"p{i}" for i in range(7)]
    out = substring_dedup(spark.createDataFrame([(0, " ".join(period * 60)), (1, "x " * 3000)], "doc_id long, text string")).collect()
    assert all(len(r.text.split()) >= 20 and r.removed_chars > 0 for r in out)
