"""What the relation operators send between tasks, besides their results."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import annotate, distant, features, vectorize


def texts(spark, *more):
    return spark.createDataFrame([(1, "alphabet countries of the big universe. universe and alphabet were here. nothing"), (2, "cosmology of countries"), *more], "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


CONFIG = [("a", "P1", "*", "*", 1), ("b", "P2", "*", "*", 2)]


def training(spark):
    rows = [(1, 0, "P1", ["universe>alphabet"], True), (1, 0, "P2", ["alphabet>countries"], False)]
    return spark.createDataFrame(rows, "doc_id long, sent_id int, relation string, entity_pairs array<string>, positive boolean")


def test_points_of_training_sentences_alone(spark):
    """Labels by hand; sentences meet what they train before their pairs are enumerated, not after."""
    config = spark.createDataFrame(CONFIG, "name string, id string, subject_type string, object_type string, class_idx int")
    sents = features.in_training(annotate.sentences(texts(spark)), training(spark), config)
    assert [(r.doc_id, r.sent_id) for r in sents.collect()] == [(1, 0)]
    points = features.label_points(features.directed(features.entity_pairs(annotate.annotate_sentences(sents), paths=True)))
    got = Counter((r.class_idx, r.point_type, r.relation) for r in points.collect())
    assert got == {(1, "pos", "P1"): 1, (0, "nearpos", "neg"): 5, (0, "neg", "neg"): 6}
    above = plan(points).split("Join")[0]
    assert "ent1_is_subject" in above and "Generate" in above


@pytest.mark.parametrize("unknown", [True, False])
def test_vectors_travel_before_pairs(spark, unknown):
    """The same vectors, whether the lexicon comes to the sentences or to the points; rows without a key and repeated ones too."""
    docs = texts(spark, (None, "universe the alphabet"), (2, "cosmology of countries"))
    vec = {"the": [1.0, 2.0], "universe": [3.0, 4.0], "alphabet": [5.0, 6.0]} | ({"__UNKNOWN__": [9.0, 9.0]} if unknown else {})
    model = spark.createDataFrame(list(vec.items()), "word string, vec array<float>")
    names = ({"noun": 1, "det": 2}, {"person": 1, "location": 2, "organization": 3}, {"noun": 1, "det": 2})
    points = lambda s: features.directed(features.with_features(features.entity_pairs(s, paths=True)))
    sents = annotate.annotate(docs)
    key = ["doc_id", "sent_id", "subject", "object", "vector"]
    late = vectorize.assemble(points(sents), model, *names).select(key)
    early = vectorize.assemble(points(vectorize.with_lexicon(sents, model, words=F.col("tokens"))), model, *names).select(key)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(early) == rows(late) and len(rows(early)) == 6 + 2 + 2 + 4
    assert early._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0].count("Join") == 0


def test_coreference_reads_once_and_meets_nearby(spark):
    """Copies by brute force, with nested, long, proper and null mentions; one shuffle; entities of a document don't meet all of its mentions."""
    import random

    rng = random.Random(7)
    mentions, entities = [(1, None, 0, 900, "NOMINAL"), (None, "c", 0, 9, "NOMINAL"), (2, "c", 5, 400, None), (2, "c", 300, 310, "PRONOMINAL")], [(None, "x", "L", 1, 2), (2, "far", "L", 395, 400), (3, "alone", None, 0, 1)]
    for _ in range(60):
        at, n = rng.randrange(900), rng.choice([1, 3, 70, 200])
        mentions.append((1, f"c{rng.randrange(9)}", at, at + n, rng.choice(["PROPER", "NOMINAL", "PRONOMINAL"])))
        entities.append((1, f"e{rng.randrange(20)}", "L", s := rng.randrange(1000), s + rng.randrange(1, 4)))
    want = set(entities)
    for d, i, label, s, e in entities:
        for chain in {m[1] for m in mentions if m[0] == d is not None and m[1] and m[2] <= s and m[3] >= e}:
            want |= {(d, i, label, m[2], m[3]) for m in mentions if m[:2] == (d, chain) and m[4] not in ("PROPER", None)}
    m = spark.createDataFrame(mentions, "doc_id long, chain string, m_start int, m_end int, mtype string")
    e = spark.createDataFrame(entities, "doc_id long, id string, label string, start int, end int")
    out = annotate.propagate_coreference(m, e)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    physical = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert physical.count("Exchange hashpartitioning") == 1 and "Join" not in physical


def test_negative_pairs_are_written_once_a_sentence(spark):
    """What a sentence's relations share stands below the generator of the relations."""
    sents = distant.sentence_pairs(annotate.linked(texts(spark)))
    known = spark.createDataFrame([("P1", "universe", "alphabet")], "relation string, source string, dest string")
    out = distant.negative_sentences(sents, known, spark.createDataFrame([("P1",), ("P2",)], "relation string"))
    got = {(r.doc_id, r.sent_id, r.relation): r.entity_pairs for r in out.collect()}
    every = ["alphabet>countries", "alphabet>universe", "countries>universe"]
    assert got[1, 0, "P2"] == every and got[1, 0, "P1"] == [every[0], every[2]] and (1, 1, "P1") not in got and got[1, 1, "P2"] == [every[1]]
    assert got[2, 0, "P1"] == got[2, 0, "P2"] == ["cosmology>countries"]
    assert "every" in plan(out)
