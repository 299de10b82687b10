"""Hand-made cases of the relation-extraction operators, sources, stages and the server."""

import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from tripleloom import cli, serve, sources
from tripleloom.functions import clean_text, local_id, ratio
from tripleloom.operators import annotate, distant, evaluate, features, kg, models, sampling, vectorize, vocab
from tripleloom.plans.relation_extraction import RelationExtraction
from tripleloom.plans.stage import Stage
from tripleloom.streaming import document_stream, known_mentions


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_functions(spark):
    assert one(spark, local_id(F.lit("urn:wikidata:Q42"))) == "Q42" and one(spark, local_id(F.lit("P::"))) == "P"
    assert one(spark, clean_text(F.lit(" \x01a\tb|c d\n"))) == "a b c d"
    assert one(spark, ratio(F.lit(1.0), F.lit(0.0))) is None


def test_knowledge_base(spark):
    row = ("Q1", [("sv", "beskrivning"), ("en", " text\n")], [(0, "P1", "v1", "item", None), (1, "P2", "child", "item", 0), (2, "P3", "orphan", "item", 9), (3, "P4", "grandchild", "x", 1), (0, "P1", "last", "item", None)], [], [("en", "a"), ("sv", "b"), ("en", "c|d")], [("de", "x")])
    from tripleloom.schemas import WIKIDATA

    df = spark.createDataFrame([row], WIKIDATA)
    got = kg.type_entities(df).first()
    assert (got.description, got.label, got.sitelink, got.aliases) == ("text", "", "", ["a", "c d"])
    assert [(p.key, p.value, [c.value for c in p.children]) for p in got.properties] == [("P1", "last", ["child"])]
    config = spark.createDataFrame([("n", "P1", "*", "*", 1)], "name string, id string, subject_type string, object_type string, class_idx int")
    dirty = ("Q2", [], [(0, "P1", "\ta|b \x02", "item", None), (1, "P1", "child", "item", 0)], [], [], [])
    got = kg.relation_pairs(df.unionByName(spark.createDataFrame([dirty], WIKIDATA)), config).collect()
    assert sorted((r.source, r.dest) for r in got) == [("Q1", "last"), ("Q2", "a b")]


def sentence(spark, *texts):
    return annotate.annotate(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"))


def test_windows_and_paths(spark):
    # entities: alphabet (0), countries (1, adjacent), universe (5)
    s = sentence(spark, "alphabet countries of the big universe")
    p = features.with_features(features.directed(features.entity_pairs(s, paths=True))).where("ent1_is_subject")
    got = {(r.subject, r.object): r for r in p.collect()}
    assert len(got) == 3
    near, far = got["alphabet", "countries"], got["alphabet", "universe"]
    assert near.words_between == [] and far.words_between == ["countries", "of", "the", "big"]
    assert near.word_features == ["<empty>"] * 3 + ["countries", "of", "the"] + ["<empty>", "<empty>", "alphabet", "of", "the", "big"]
    assert far.path == [2, 5] and [e.dependency for e in far.dependency_path] == ["DET", "NOUN"]
    assert near.path == [1] and len(near.ent1_dep_window) == 1
    again = features.entity_pairs(sentence(spark, "universe and universe"))
    assert again.count() == 0


def test_annotated_corpus(spark, tmp_path):
    """A corpus's own sentences, tokens, edges and entities; a two-token entity, an unreachable one, and a chain of mentions."""
    from tripleloom.schemas import CORPUS

    text = "Ada Lovelace wrote to Babbage . She met him oddly ."
    tokens, at = [], 0
    for i, w in enumerate(text.split()):
        at = text.index(w, at)
        tokens.append((i, at, at + len(w), w, f"T{i}"))
        at += len(w)
    span = lambda a, b: (tokens[a][1], tokens[b][2])
    # wrote is the root; Ada < Lovelace < wrote, to < wrote, Babbage < to; met the root of the second, He and oddly under it, him loose
    deps = [(0, 1, "compound"), (1, 2, "nsubj"), (3, 2, "prep"), (4, 3, "pobj"), (6, 7, "nsubj"), (9, 7, "advmod"), (4, 7, "across")]
    entities = [("Q:7259", "PERSON", *span(0, 1)), ("Q:46633", "PERSON", *span(4, 4)), ("Q:1", "THING", *span(8, 8))]
    mentions = [("c1", *span(0, 1), "PROPER"), ("c1", *span(6, 6), "PRONOMINAL")]
    row = (1, "u", "ARTICLE", "en", text, [span(0, 5), span(6, 10)], tokens, deps, entities, mentions)
    spark.createDataFrame([row, (2, "u", "STUB", *row[3:])], CORPUS).write.parquet(str(tmp_path / "corpus"))
    docs = sources.read_corpus(spark, str(tmp_path / "corpus"))
    got = features.with_features(features.directed(features.entity_pairs(annotate.sentence_rows(docs), paths=True))).where("ent1_is_subject").collect()
    assert [(r.subject, r.object) for r in got] == [("7259", "46633")]
    r = got[0]
    assert r.words_between == ["wrote", "to"] and r.ent1_pos == ["T0", "T1"] and r.ent2_pos == ["T4"] and r.word_features[:6] == ["<empty>"] * 3 + ["wrote", "to", "Babbage"]
    assert [(e.dependency, e.word, e.direction) for e in r.dependency_path] == [("nsubj", "wrote", False), ("prep", "wrote", True), ("pobj", "to", True)]
    assert [e.dependency for e in r.ent1_dep_window] == ["compound"] and r.ent2_dep_window == []
    more = features.with_features(features.directed(features.entity_pairs(annotate.sentence_rows(docs, corefs=True), paths=True))).where("ent1_is_subject")
    second = {(r.subject, r.object): r for r in more.collect() if r.sent_id == 1}
    assert list(second) == [("7259", "1")] and second["7259", "1"].path == [] and [e.dependency for e in second["7259", "1"].ent1_dep_window] == ["nsubj"]
    known = spark.createDataFrame([("P1", "46633", "7259")], "relation string, source string, dest string")
    assert distant.positive_sentences(distant.sentence_pairs(annotate.sentence_rows(docs)), known).first().entity_pairs == ["46633>7259"]


def test_positive_and_negative(spark):
    s = distant.sentence_pairs(sentence(spark, "alphabet countries of the big universe"))
    known = spark.createDataFrame([("P1", "universe", "alphabet"), ("P2", "countries", "nothing")], "relation string, source string, dest string")
    assert [(r.relation, r.entity_pairs) for r in distant.positive_sentences(s, known).collect()] == [("P1", ["universe>alphabet"])]
    rel = spark.createDataFrame([("P1",), ("P2",)], "relation string")
    neg = {r.relation: r.entity_pairs for r in distant.negative_sentences(s, known, rel).collect()}
    assert neg == {"P1": ["alphabet>countries", "countries>universe"], "P2": ["alphabet>countries", "alphabet>universe", "countries>universe"]}
    assert [r.entity_pairs for r in distant.negative_sentences(s, known, rel, strict=True).collect()] == [["alphabet>countries", "countries>universe"]]
    assert distant.negative_fraction(5, 0, 10) == 1 and distant.negative_fraction(0, 2, 10) == 0 and distant.negative_fraction(10**9, 1, 10) == 1


def test_vocabulary(spark):
    words = [(w,) for w in "a b c d e f g".split() * 5] + [("rare",), ("!",), ("!",), ("!",)]
    v = vocab.word_vocabulary(spark.createDataFrame(words, "token string"))
    ids = {r.token: r.id for r in v.collect()}
    assert len(ids) == len(set(ids.values())) == 7 and ids["g"] == 1
    enc = {r.token: r.id for r in vocab.encode(spark.createDataFrame([("A",), ("zz",)], "token string"), v).collect()}
    assert enc == {"A": 7, "zz": 0}
    dec = {r.id: r.token for r in vocab.decode(spark.createDataFrame([(1,), (99,)], "id int"), v).collect()}
    assert dec == {1: "g", 99: "<UNKNOWN_ID>"}


def test_numbering_and_order_in_parts(spark):
    words = [f"{a}{b}" for a in ("", "a", "abc", "abcd", "é", "日本語", "zz") for b in ("1", "x", "é", "abc")] * 3
    v = vocab.word_vocabulary(spark.createDataFrame([(w,) for w in words], "token string"))
    want = sorted(set(words), key=lambda w: w.encode(), reverse=True)
    assert {r.token: r.id for r in v.collect()} == {w: i + 1 for i, w in enumerate(want)}
    rows = [(i * 37 % 101 / 250_000, i * 7 % 3 == 0) for i in range(200)] + [(0.5, True), (0.5, False), (float("inf"), True), (-2.0, False)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    got = models.area_under_roc(spark.createDataFrame(rows, "score double, label boolean").withColumn("label", F.col("label").cast("int"))).first().auroc
    assert abs(got - auc) < 1e-12
    assert models.area_under_roc(spark.createDataFrame([], "score double, label int")).first().auroc is None


def test_vectors_by_hand(spark):
    """Every slot of the vectors of two sentences, one of them without known words, against the layout written out."""
    import numpy as np

    s = sentence(spark, "universe the alphabet", "cosmology of countries")
    points = features.with_features(features.directed(features.entity_pairs(s, paths=True)))
    vec = {"the": [1.0, 2.0], "universe": [3.0, 4.0], "alphabet": [5.0, 6.0], "__UNKNOWN__": [9.0, 9.0]}
    tags, types, deps = {"noun": 1, "det": 2}, {"person": 1, "location": 2, "organization": 3}, {"noun": 1, "det": 2}
    model = spark.createDataFrame(list(vec.items()), "word string, vec array<float>")
    out = vectorize.assemble(points, model, tags, types, deps).collect()
    assert len(out) == 4

    def hot(i, n):
        return [float(i == k) for k in range(n)]

    def any_hot(vs, vocabulary):
        return [float(k in {vocabulary.get(v.lower(), 0) for v in vs}) for k in range(len(vocabulary) + 1)]

    def edges(es, n):
        some = [hot(deps.get(e.dependency.lower(), 0), 3) + vec.get(e.word, vec["__UNKNOWN__"]) + [float(e.direction)] for e in es[:n]]
        return sum(some + [hot(0, 3) + [0.0] * 3] * (n - len(some)), [])

    for r in out:
        word = lambda ws, n: sum([vec.get(w, vec["__UNKNOWN__"]) for w in ws[:n]] + [[0.0, 0.0]] * (n - len(ws)), [])
        tag = lambda ps, n: sum([hot(tags.get(p.lower(), 0), 3) for p in ps[:n]] + [hot(0, 3)] * (n - len(ps)), [])
        want = word(r.word_features, 12) + tag(r.pos_features, 12) + word(r.words_between, 10) + tag(r.pos_between, 10) + any_hot(r.ent1_pos, tags) + any_hot(r.ent2_pos, tags)
        want += any_hot([r.ent1_type], types) + any_hot([r.ent2_type], types) + edges(r.dependency_path, 8) + edges(r.ent1_dep_window, 1) + edges(r.ent2_dep_window, 1) + [float(r.ent1_is_subject)]
        assert len(want) == vectorize.width(2, 3, 4, 3) and np.allclose(r.vector, want)


def test_balance(spark):
    df = spark.createDataFrame([(i, 0 if i < 90 else 1 if i < 97 else 2) for i in range(100)], "k long, label int")
    n = {r.label: r["count"] for r in sampling.balance_classes(df, [F.col("k")]).groupBy("label").count().collect()}
    assert n[1] == 7 and n[2] in range(6, 10)
    n = {r.label: r["count"] for r in sampling.balance_negatives(df, [F.col("k")]).groupBy("label").count().collect()}
    assert n[1] == 7 and n[2] == 3 and n[0] < 40
    assert sampling.balance_negatives(df.where("label = 0"), [F.col("k")]).count() == 90


def test_two_stage(spark):
    p = F.array(F.lit(0.0), F.lit(0.9), F.lit(0.1))
    got = [one(spark, models.two_stage(F.lit(x), p)) for x in (0.5, 0.8, 0.9)]
    assert [g.class_idx for g in got] == [0, 0, 1]
    assert [round(g.probability, 4) for g in got] == [0.5, 0.28, 0.81] and got[0].class_prob == 0


def test_judgements_and_ties(spark):
    j = spark.createDataFrame([([("yes", "a"), ("no", "b")],), ([],), ([("yes", "a")],)], "judgments array<struct<judgment: string, rater: string>>")
    assert [r[0] for r in j.select(evaluate.majority()).collect()] == [False, False, True]
    s = spark.createDataFrame([("p", x, x > 0.5) for x in (0.9, 0.8, 0.8, 0.2)], "predicate string, probability double, hit boolean")
    r = evaluate.n_most_probable(s, 2, ["predicate"]).first()
    assert (r.cutoff, r.n_taken, r.precision) == (0.8, 3, 1.0)


def test_sources(spark, tmp_path):
    f = tmp_path / "config.tsv"
    f.write_text("birth\tP19\tPERSON\t*\nspouse\tP26\t*\t*\n")
    got = sources.read_relation_config(spark, str(f)).orderBy("class_idx").collect()
    assert [(r.id, r.class_idx, r.object_type) for r in got] == [("P19", 1, "*"), ("P26", 2, "*")]
    v, m = sources.write_word2vec([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], str(tmp_path / "w2v"))
    assert {r.word: r.vec for r in sources.read_word2vec(spark, v, m).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    e = tmp_path / "eval.json"
    point = {"wd_sub": False, "wd_obj": "Q2", "wd_pred": "P1", "judgments": [{"judgment": "yes", "rater": "x"}], "evidences": [{"url": "u", "snippet": "s"}]}
    e.write_text("\n".join(json.dumps(x) for x in (point, point | {"wd_sub": "Q1"})))
    points = sources.read_evaluation_points(spark, str(e))
    assert points.count() == 2 and [r.wd_sub for r in evaluate.judged_points(points).collect()] == ["Q1"]
    mapping = spark.createDataFrame([("/m/1", "Q1")], "source_id string, wd_id string")
    linked = sources.link_ids(spark.createDataFrame([("/m/1", "/m/2", "/m/1")], "sub string, obj string, pred string"), mapping).first()
    assert (linked.wd_sub, linked.wd_obj, linked.wd_pred) == ("Q1", "false", "Q1")


def test_vectors_by_ranges(spark, tmp_path):
    rows = [(f"w{i}", [float(i), float(i) / 2, -1.0]) for i in range(11)]
    v, m = sources.write_word2vec(rows, str(tmp_path / "w2v"))
    for n in (1, 3, 11, 50):
        got = {r.word: r.vec for r in sources.read_word2vec(spark, f"file://{v}", f"file://{m}", rows_a_task=n).collect()}
        assert got == dict(rows)


def test_remote_annotation(spark):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            text = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.send_response(500 if text == "fail" else 200)
            self.end_headers()
            good = {"type": "ARTICLE", "sentences": [{"start": 0, "end": len(text)}], "tokens": [{"idx": 0, "start": 0, "end": 3, "text": text[:3], "pos": "X"}], "other": 1}
            self.wfile.write({"junk": b"<html>", "list": b"[1]", "types": b'{"sentences": "none"}'}.get(text, json.dumps(good).encode()))

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    docs = spark.createDataFrame([(1, "ünïcode text"), (2, "fail"), (3, "junk"), (4, "list"), (5, "types"), (6, None), (None, "no id")], "doc_id long, text string")
    try:
        out = sources.annotate_remote(docs, f"http://127.0.0.1:{server.server_port}/annotate")
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == 7 and [i for i in got if got[i].error] == [2, 3, 4, 5] and "500" in got[2].error
        assert got[1].tokens[0].text == "ünï" and got[1].sentences[0].end == 12 and got[None].text == "no id" and got[2].sentences is None
        assert {r.doc_id for r in annotate.sentence_rows(out).collect()} == {1, None}
    finally:
        server.shutdown()
        server.server_close()
    dead = sources.annotate_remote(docs, f"http://127.0.0.1:{server.server_port}/", timeout_s=2, connect_s=1)
    assert dead.where("error is null").count() == 0 and dead.count() == 7


def test_evidence_documents(spark):
    points = spark.createDataFrame([(1, [("a", "u"), (None, "v"), ("b", "w")]), (2, []), (3, None)], "point_id long, evidences array<struct<snippet: string, url: string>>")
    assert [tuple(r) for r in sources.evidence_documents(points).orderBy("evidence").collect()] == [(1, 0, "u", "a"), (1, 2, "w", "b")]


def test_stage_is_built_once(spark, tmp_path):
    calls = []
    s = Stage(spark, str(tmp_path / "s"), lambda: calls.append(1) or spark.range(3))
    assert s.get().count() == 3 and s.get().count() == 3 and len(calls) == 1


def test_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").write_bytes(open(f"{sf_dir}/documents.parquet", "rb").read())
    from tripleloom.queries import documents, known_pairs

    kg_rows = known_pairs(spark, sf_dir)
    out = known_mentions(document_stream(spark, str(tmp_path / "in"), schema), kg_rows)
    q = out.writeStream.format("memory").queryName("mentions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    batch = distant.known_in_sentences(distant.sentence_pairs(annotate.annotate(documents(spark, sf_dir))), kg_rows)
    assert spark.table("mentions").count() == batch.count()


def test_cli_arguments():
    a = cli.parser().parse_args(["c", "r", "w", "t", "v", "--sample-size", "0.5", "--stage", "train"])
    assert a.sample_size == 0.5 and a.probability_cutoff == 0.75 and a.epochs == 5
    for bad in (["--sample-size", "0"], ["--language", "xx"], ["--probability-cutoff", "2"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["c", "r", "w", "t", "v", *bad])


def test_end_to_end(spark, tmp_path):
    people = ["einstein", "newtonian", "darwinist", "mendeleev", "faradayan", "boltzmann", "heisenberg", "descartes"]
    places = ["stuttgart", "cambridge", "shrewsbury", "petersburg", "newington", "viennacity", "wuerzburg", "lahayeville"]
    docs = [(i, f"The {p} was born in {q}. Then {places[(i + 3) % 8]} saw {p} walk by.") for i, (p, q) in enumerate(zip(people, places, strict=True))] * 4
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    config = spark.createDataFrame([("birth", "P19", "*", "*", 1)], "name string, id string, subject_type string, object_type string, class_idx int")
    from tripleloom.schemas import EVALUATION_POINT, WIKIDATA

    wd = spark.createDataFrame([(p, None, [(0, "P19", q, "item", None)], None, None, None) for p, q in zip(people, places, strict=True)], WIKIDATA)
    vectors = spark.createDataFrame([("born", [1.0, 0.0]), ("saw", [0.0, 1.0]), ("in", [0.5, 0.5])], "word string, vec array<float>")
    plan = RelationExtraction(spark, spark.createDataFrame(docs, "doc_id long, text string"), config, wd, vectors, str(tmp_path / "work"), threshold=0.3, epochs=3)
    found = plan.full()
    got = {(r.subject, r.obj) for r in found.collect()}
    known = set(zip(people, places, strict=True))
    assert len(got & known) >= 6 and {r.predictedPredicate for r in found.collect()} == {"P19"}
    table = plan.evaluate_data().first()
    assert table.n_verified > 0 and (tmp_path / "work/en/evaluation/data/_SUCCESS").exists()

    point = lambda sub, obj, vote, i: (sub, "s", [(vote, "r")], "p", [(docs[i][1], "u")], obj, "o", "P19")
    points = spark.createDataFrame([point("einstein", "stuttgart", "yes", 0), point("newtonian", "viennacity", "no", 1), point("false", "x", "yes", 2)], EVALUATION_POINT)
    result = plan.evaluate_model(points, "two").collect()
    assert [(r.relation, r.n_points, r.linking_recall) for r in result] == [("P19", 1, 0.5)] and result[0].tp <= 1
    debug = spark.read.csv(str(tmp_path / "work/en/evaluation/two/debug"), sep="\t", header=True)
    assert debug.count() == 2 and (tmp_path / "work/en/classification_model/epoch-3/_SUCCESS").exists()
    again = RelationExtraction(spark, spark.createDataFrame(docs, "doc_id long, text string"), config, wd, vectors, str(tmp_path / "work"), threshold=0.3, epochs=3)
    again.train()  # loads what the first one kept
    assert all((a == b).all() for a, b in zip([*again._net.w, *again._net.b], [*plan._net.w, *plan._net.b], strict=True))

    server = serve.make_server(spark, plan, host="127.0.0.1", port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert b"/api/en/extract" in urllib.request.urlopen(f"{url}/").read()
        body = urllib.request.urlopen(f"{url}/api/en/extract", data=docs[0][1].encode(), timeout=120).read()
        assert any(x["subject"] == "einstein" for x in json.loads(body))
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        RelationExtraction(spark, None, config, wd, vectors, "x", threshold=2)
