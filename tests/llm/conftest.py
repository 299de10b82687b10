import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, `end` int"


def edge_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["The", "the", "Of", "éa", "Ñu"]
    prose = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 120))) + "." for _ in range(12)]
    near = prose[0].split()
    near[7] = "changed"
    texts = [*prose, " ".join(near), prose[1], prose[1].upper(), prose[1], "", None, "   \n\t ", "one", "Two words", "a b c d", "a b c d e", "\n\n", "x " * 3000, "Ünïcode ÀB ab", "😀 b 😀 b"]
    texts += ["the cat sat on the mat and\n" * 30, "same line here with more than eight words inside it.\nother", "same line here with more than eight words inside it.\nanother", "y" * 50_000, " ".join(prose) * 10]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "é", None]), len(t or ""), "clash", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None, None, None, None), (3, "another text under an id that is taken", "en", "a", 3, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(spark):
    """The same without repeated or missing ids."""
    seen = {r[0]: r for r in reversed(edge_rows()) if r[0] is not None}
    return spark.createDataFrame(sorted(seen.values(), key=lambda r: r[0]), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
