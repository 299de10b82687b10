"""Sentences, tokens, entities, dependencies and coreference as columns, of annotated corpora or by an offline, deterministic annotator.

A sentence is one row: doc_id, sent_id, sent, tokens array<string>, pos array<string>, deps array<struct<tail, head, rel>>
(token numbers from 0), entities array<struct<idx, last, id, label>> (first and last token). Everything inside a sentence is
a higher-order expression, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bind, spread

TRAIN_LENGTH, PREDICT_LENGTH = (5, 220), (5, 300)
#: Positions of a document that mentions and entities are matched within.
SPAN = 64
LABELS = ("PERSON", "LOCATION", "ORGANIZATION")


def sentences(docs: DataFrame, length: tuple[int, int] = TRAIN_LENGTH) -> DataFrame:
    """doc_id, sent_id, sent: pieces between sentence ends whose length in characters is within bounds."""
    parts = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sent_id", "sent"))
    return parts.where(F.length("sent").between(*length))


def tokenise(sents: DataFrame) -> DataFrame:
    return bind(sents, tokens=F.regexp_extract_all("sent", F.lit(r"[\p{L}\d]+"), 0))


def pos_tag(token: Column) -> Column:
    return (
        F.when(token.endswith("ly"), "ADV").when(token.endswith("ing") | token.endswith("ed"), "VERB").when(F.length(token) <= 3, "DET")
        .when(token.rlike(r"^\d+$"), "NUM").otherwise("NOUN")
    )


def entity_label(name: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), F.length(name) % 3 + 1)


def with_pos(sents: DataFrame) -> DataFrame:
    return bind(sents, pos=F.transform("tokens", pos_tag))


def with_entities(sents: DataFrame) -> DataFrame:
    """Entities in token order, one for each occurrence."""
    marked = F.transform("tokens", lambda t, i: F.struct(i.alias("idx"), i.alias("last"), F.concat(F.lit("Q:"), F.lower(t)).alias("id"), entity_label(t).alias("label")))
    return bind(sents, entities=F.filter(marked, lambda e: e["id"].rlike("^Q:[a-z]{7,}$")))


def with_deps(sents: DataFrame) -> DataFrame:
    """A binary tree over the tokens: token i's head is (i + 1) div 2 - 1, and the relation is named by the token's tag."""
    edge = lambda p, i: F.struct(i.alias("tail"), (F.floor((i + 1) / 2) - 1).cast("int").alias("head"), p.alias("rel"))
    return bind(sents, deps=F.filter(F.transform("pos", edge), lambda d: d["head"] >= 0))


def annotate(docs: DataFrame, length: tuple[int, int] = TRAIN_LENGTH) -> DataFrame:
    """Sentence rows of plain texts."""
    return annotate_sentences(sentences(docs, length))


def annotate_sentences(sents: DataFrame) -> DataFrame:
    return with_entities(with_deps(with_pos(tokenise(sents))))


def linked(docs: DataFrame, length: tuple[int, int] = TRAIN_LENGTH) -> DataFrame:
    """Sentence rows of plain texts with tokens and entities alone."""
    return with_entities(tokenise(sentences(docs, length)))


def with_coreference(docs: DataFrame) -> DataFrame:
    """Annotated documents whose entities also stand on every mention, but proper ones, of a chain that some mention of covers them."""
    on = lambda e, m: F.struct(e["ned_id"].alias("ned_id"), e["ne_label"].alias("ne_label"), m["start"].alias("start"), m["end"].alias("end"))
    others = lambda e, m: F.transform(F.filter("mentions", lambda x: (x["chain"] == m["chain"]) & (x["mtype"] != "PROPER")), lambda x: on(e, x))
    covering = lambda e: F.filter("mentions", lambda m: (m["start"] <= e["start"]) & (m["end"] >= e["end"]))
    copies = F.flatten(F.transform("entities", lambda e: F.flatten(F.transform(covering(e), lambda m: others(e, m)))))
    return docs.withColumn("entities", F.when(F.col("mentions").isNull(), F.col("entities")).otherwise(F.array_union("entities", copies)))


def from_corpus(docs: DataFrame, length: tuple[int, int] = TRAIN_LENGTH) -> DataFrame:
    """Sentence rows of annotated documents (schemas.CORPUS); an entity covers whole tokens of one sentence, an edge joins two of them."""
    rows = spread(docs).select("doc_id", "text", "tokens", "deps", "entities", F.posexplode("sentences").alias("sent_id", "s"))
    rows = bind(rows, sent=F.expr("substring(text, s.start + 1, s.end - s.start)")).where(F.length("sent").between(*length))
    inside = lambda x: (x["start"] >= F.col("s.start")) & (x["end"] <= F.col("s.end"))
    rows = bind(rows.drop("text"), toks=F.sort_array(F.transform(F.filter("tokens", inside), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["idx"].alias("idx"), t["text"].alias("text"), t["pos"].alias("pos")))))
    # the sentence's token numbers, found by the document's
    place = lambda idx: (F.array_position(F.col("toks.idx"), idx) - 1).cast("int")
    edges = F.transform("deps", lambda d: F.struct(place(d["tail_idx"]).alias("tail"), place(d["head_idx"]).alias("head"), d["rel"].alias("rel")))
    count = lambda test: F.size(F.filter("toks", test))
    named = F.transform(
        F.filter("entities", inside),
        lambda e: F.struct(
            count(lambda t: t["end"] <= e["start"]).alias("idx"), (count(lambda t: t["start"] < e["end"]) - 1).alias("last"), e["ned_id"].alias("id"), e["ne_label"].alias("label")
        ),
    )
    return bind(
        rows, tokens_=F.col("toks.text"), pos=F.col("toks.pos"), deps_=F.filter(edges, lambda d: (d["tail"] >= 0) & (d["head"] >= 0)), entities_=F.filter(named, lambda e: e["last"] >= e["idx"])
    ).select("doc_id", "sent_id", "sent", F.col("tokens_").alias("tokens"), "pos", F.col("deps_").alias("deps"), F.col("entities_").alias("entities"))


def sentence_rows(docs: DataFrame, length: tuple[int, int] = TRAIN_LENGTH, corefs: bool = False) -> DataFrame:
    """Sentence rows by the documents' own annotation, or by the offline annotator where they have none."""
    if "sentences" not in docs.columns:
        return annotate(docs, length)
    return from_corpus(with_coreference(docs) if corefs else docs, length)


def heads_of(tokens: Column, deps: Column, tails: Column) -> Column:
    """For each token the (head, rel) of its first edge, null for roots. tails: the edges' tails."""
    return F.transform(tokens, lambda _, i: F.get(deps, F.array_position(tails, i) - 1))


def upwards(token: Column, parents: Column) -> Column:
    """The token and its heads up to the root. parents: each token's head."""
    last = lambda up: F.get(parents, F.element_at(up, -1))
    step = lambda up, _: F.when(last(up).isNull(), up).otherwise(F.concat(up, F.array(last(up))))
    return F.aggregate(parents, F.array(token), step)


def covered_by(inner: DataFrame, outer: DataFrame, key: str = "doc_id") -> DataFrame:
    """inner(key, start, end, ...) inside outer(key, o_start, o_end, ...): an equi join on the document with a containment residual."""
    return inner.join(outer, key).where((F.col("start") >= F.col("o_start")) & (F.col("end") <= F.col("o_end")))


def propagate_coreference(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities plus copies on every mention of a chain that isn't proper, where some mention of the chain covers the entity.

    mentions: doc_id, chain, m_start, m_end, mtype; entities: doc_id, id, label, start, end.
    """
    entity = F.struct("id", "label", "start", "end").alias("entity")
    mention = F.struct("chain", F.col("m_start").alias("start"), F.col("m_end").alias("end"), "mtype").alias("mention")
    return propagate_marks(entities.select("doc_id", entity).unionByName(mentions.select("doc_id", mention), allowMissingColumns=True))


def propagate_marks(marks: DataFrame) -> DataFrame:
    """propagate_coreference of rows that hold either an entity (id, label, start, end) or a mention (chain, start, end, mtype), read and shuffled once.

    Entities meet the mentions that touch the stretch of SPAN positions in which they start; what they are held by and the
    places of a chain meet by chain. Only an entity's own document and chain count, so null ones propagate nothing.
    """
    e, m = F.col("entity"), F.col("mention")
    stretch = lambda at: F.floor(at / SPAN)
    at = F.when(e.isNotNull(), F.array(stretch(e["start"]))).when(m["end"] >= m["start"], F.sequence(stretch(m["start"]), stretch(m["end"])))
    placed = marks.repartition("doc_id").where(e.isNotNull() | (F.col("doc_id").isNotNull() & m["chain"].isNotNull())).select("doc_id", "entity", "mention", F.explode_outer(at).alias("stretch"))
    # dealt by document once: what follows groups within documents
    met = placed.groupBy("doc_id", "stretch").agg(F.collect_list("entity").alias("es"), F.collect_list("mention").alias("ms"))
    row = lambda chain, own, held, place: F.struct(chain.alias("chain"), own.alias("own"), held.alias("held"), place.alias("place"))
    chain, own, held, place = F.lit(None), F.lit(None), F.lit(None), F.lit(None)
    covering = lambda e: F.filter("ms", lambda m: (m["start"] <= e["start"]) & (m["end"] >= e["end"]))
    name = lambda e: F.struct(e["id"].alias("id"), e["label"].alias("label"))
    spot = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    first = lambda m: (m["mtype"] != "PROPER") & stretch(m["start"]).eqNullSafe(F.col("stretch"))
    rows = F.concat(
        F.transform("es", lambda e: row(chain, e, held, place)),
        F.array_distinct(F.flatten(F.transform("es", lambda e: F.transform(covering(e), lambda m: row(m["chain"], own, name(e), place))))),
        F.transform(F.filter("ms", first), lambda m: row(m["chain"], own, held, spot(m))),
    )
    chains = met.select("doc_id", F.inline(rows)).groupBy("doc_id", "chain").agg(F.collect_set("own").alias("own"), F.collect_set("held").alias("held"), F.collect_set("place").alias("places"))
    copy = lambda h, p: F.struct(h["id"].alias("id"), h["label"].alias("label"), p["start"].alias("start"), p["end"].alias("end"))
    copies = F.flatten(F.transform("held", lambda h: F.transform("places", lambda p: copy(h, p))))
    return chains.select("doc_id", F.inline(F.concat("own", copies))).distinct()
