"""The registered queries of the relation-extraction operators and their SQL.

The tables stand in for annotated corpora and knowledge bases: sentences, tokens, entities and dependency trees come
from documents, known pairs from benchmark sentences, knowledge-base rows from customers and orders, extractions and
known facts from events, vectors from embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hash_bucket, is_word, local_id, ratio
from .operators import annotate as A
from .operators import distant as D
from .operators import evaluate as E
from .operators import features as X
from .operators import kg as K
from .operators import models as M
from .operators import predict as P
from .operators import sampling as S
from .operators import vectorize as Z
from .operators import vocab as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: name, id, subject type, object type, class
CONFIG = [("place_of_birth", "P19", "PERSON", "LOCATION", 1), ("spouse", "P26", "*", "PERSON", 2), ("educated_at", "P69", "*", "*", 3)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIG, "name string, id string, subject_type string, object_type string, class_idx int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, source, dest from pairs in one benchmark sentence."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    pairs = D.sentence_pairs(A.with_entities(A.tokenise(A.sentences(items)))).select(F.inline("pairs")).distinct()
    swap = F.length("b") % 2 == 1
    rel = F.element_at(F.array(*[F.lit(c[1]) for c in CONFIG]), F.length("a") % 3 + 1)
    return pairs.select(rel.alias("relation"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("dest"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), (F.col("event_id") % 7).alias("obj"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("probability"), "event_id")


def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0 and user_id % 2 = 0 and event_id % 7 < 5")
    return e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), (F.col("event_id") % 7).alias("obj")).distinct()


def wikidata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge-base row for each customer: nation (with its region as child), segment, the orders' priorities and an orphan."""
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    prop = lambda i, k, v, p=None: F.struct(F.lit(i).cast("int").alias("idx") if isinstance(i, int) else i.alias("idx"), F.lit(k).alias("key"), v.alias("value"), F.lit("string").alias("datatype"), F.lit(p).cast("int").alias("parent"))
    nations = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 rows
    rows = c.join(F.broadcast(nations), c["c_nationkey"] == n["n_nationkey"])
    orders = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    rows = rows.join(orders, rows["c_custkey"] == orders["o_custkey"], "left")
    own = F.array(prop(0, "P1", F.col("n_name")), prop(1, "P2", F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("\t"))), prop(9, "P9", F.col("r_name"), 0), prop(10, "P9", F.col("r_name"), 77))
    more = F.transform(F.coalesce("priorities", F.array().cast("array<string>")), lambda v, i: prop((i + 2).cast("int"), "P3", v))
    lang = lambda en, sv: F.array(F.struct(F.lit("sv").alias("lang"), sv.alias("text")), F.struct(F.lit("en").alias("lang"), en.alias("text")))
    name = F.col("c_name")
    return rows.select(
        F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("id"), lang(F.concat(F.lit("a|"), name), name).alias("descriptions"), F.concat(own, more).alias("properties"),
        F.array(F.struct(F.lit("sv").alias("lang"), name.alias("text"))).alias("sitelinks"), lang(F.lower(name), name).alias("aliases"), lang(name, F.lit("x")).alias("labels"),
    )


SENT = r"""sent as (select doc_id, cast(i - 1 as int) sent_id, ss[i] sent from (select doc_id, regexp_split_to_array(text, '[.!?\n]+') ss from documents), unnest(range(1, len(ss) + 1)) t(i)
  where length(ss[i]) between 5 and 220)"""
TOK = SENT + r""", tok as (select doc_id, sent_id, cast(j - 1 as int) idx, ts[j] tok, len(ts) n_tok from (select doc_id, sent_id, regexp_extract_all(sent, '[\p{L}\d]+') ts from sent), unnest(range(1, len(ts) + 1)) u(j)),
 tag as (select *, case when tok like '%ly' then 'ADV' when tok like '%ing' or tok like '%ed' then 'VERB' when length(tok) <= 3 then 'DET' when regexp_full_match(tok, '\d+') then 'NUM' else 'NOUN' end pos from tok)"""
ENT = TOK + r""", ent as (select doc_id, sent_id, idx, lower(tok) id, ['PERSON','LOCATION','ORGANIZATION'][1 + length(tok) % 3] label from tok where regexp_full_match(lower(tok), '[a-z]{7,}'))"""
PAIRS = ENT + """, ids as (select distinct doc_id, sent_id, id from ent), pairs as (select x.doc_id, x.sent_id, x.id a, y.id b from ids x join ids y on x.doc_id = y.doc_id and x.sent_id = y.sent_id and x.id < y.id)"""
KG = PAIRS + r""", bsent as (select item_id, i, ss[i] sent from (select item_id, regexp_split_to_array(text, '[.!?\n]+') ss from benchmark), unnest(range(1, len(ss) + 1)) t(i) where length(ss[i]) between 5 and 220),
 bent as (select distinct item_id, i, lower(w) id from (select item_id, i, unnest(regexp_extract_all(sent, '[\p{L}\d]+')) w from bsent) where regexp_full_match(lower(w), '[a-z]{7,}')),
 kg as (select ['P19','P26','P69'][1 + length(a) % 3] relation, case when length(b) % 2 = 1 then b else a end source, case when length(b) % 2 = 1 then a else b end dest
   from (select distinct x.id a, y.id b from bent x join bent y on x.item_id = y.item_id and x.i = y.i and x.id < y.id)),
 known as (select doc_id, sent_id, relation, source, dest, a, b from pairs join kg on a = least(source, dest) and b = greatest(source, dest))"""
OCC = ENT + """, occ as (select x.doc_id, x.sent_id, x.idx i1, x.id id1, x.label t1, y.idx i2, y.id id2, y.label t2 from ent x join ent y on x.doc_id = y.doc_id and x.sent_id = y.sent_id and x.idx < y.idx and x.id <> y.id)"""
EXT = """ext as (select user_id subject, event_type predicate, event_id % 7 obj, least(value / 500.0, 1.0) probability, event_id from events),
 fact as (select distinct user_id subject, event_type predicate, event_id % 7 obj from events where event_id % 3 = 0 and user_id % 2 = 0 and event_id % 7 < 5),
 judged as (select e.*, exists (select 1 from fact f where f.subject = e.subject and f.predicate = e.predicate) matched,
   exists (select 1 from fact f where f.subject = e.subject and f.predicate = e.predicate and f.obj = e.obj) verified from ext e)"""
SCORED = "scored as (select doc_id, quality label, least(length(text) / 40000.0, 1.0) score from labels join documents using (doc_id))"
BUCKET = "(('0x' || substr(md5({0}), 1, 8))::bigint % 10000)"


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- sources and annotation


@query("select lang, count(*) n_docs, sum(length(text)) n_characters from documents where lang = 'en' group by lang")
def corpus_scan_filter(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_characters"))


@query(f"with {SENT} select doc_id, sent_id, md5(sent) sent_md5, length(sent) n_chars from sent")
def sentence_split(spark, d):
    return A.sentences(documents(spark, d)).select("doc_id", "sent_id", F.md5("sent").alias("sent_md5"), F.length("sent").cast("long").alias("n_chars"))


@query(f"with {SENT} select doc_id, count(*) n_train from sent group by doc_id")
def sentence_length_filter(spark, d):
    return A.sentences(documents(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_train"))


@query(f"with {TOK} select doc_id, sent_id, idx, tok as token, pos from tag")
def token_index(spark, d):
    rows = A.with_pos(A.tokenise(A.sentences(documents(spark, d))))
    return rows.select("doc_id", "sent_id", F.posexplode(F.arrays_zip("tokens", "pos")).alias("idx", "t")).select("doc_id", "sent_id", "idx", F.col("t.tokens").alias("token"), "t.pos")


def _annotated(spark, d):
    return A.annotate(documents(spark, d))


@query(f"with {ENT} select doc_id, sent_id, idx, id, label from ent")
def entity_mentions(spark, d):
    return _annotated(spark, d).select("doc_id", "sent_id", F.inline("entities")).drop("last").withColumn("id", local_id(F.col("id")))


COVER = r"""words as (select doc_id, cast(generate_subscripts(ws, 1) - 1 as int) as pos, unnest(ws) w from (select doc_id, regexp_extract_all(text, '[\p{L}\d]+') ws from documents)),
 spans as (select doc_id, cast(pos as bigint) o_start, cast(pos + 9 as bigint) o_end from words where pos % 50 = 0), inner_ as (select doc_id, cast(pos as bigint) s, cast(pos + length(w) % 3 as bigint) e from words where length(w) >= 7)"""


def _spans(spark, d):
    words = documents(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\d]+"), 0)).alias("pos", "w"))
    outer = words.where("pos % 50 = 0").select("doc_id", F.col("pos").cast("long").alias("o_start"), (F.col("pos") + 9).cast("long").alias("o_end"))
    inner = words.where("length(w) >= 7").select("doc_id", F.col("pos").cast("long").alias("start"), (F.col("pos") + F.length("w") % 3).cast("long").alias("end"))
    return inner, outer


@query(f"with {COVER} select o.doc_id, o_start, count(*) n_covered, min(s) first_start from spans o join inner_ i on o.doc_id = i.doc_id and s >= o_start and e <= o_end group by o.doc_id, o_start")
def coveredby_group(spark, d):
    inner, outer = _spans(spark, d)
    return A.covered_by(inner, outer).groupBy("doc_id", "o_start").agg(F.count("*").alias("n_covered"), F.min("start").alias("first_start"))


COREF = f"""with {ENT}, men as (select doc_id, sent_id * 1000 + idx as s, sent_id * 10 + length(tok) % 5 as chain, case when idx = 0 then 'PROPER' else 'NOMINAL' end mtype from tok where idx % 6 = 0),
 en as (select doc_id, sent_id * 1000 + idx as s, id, label from ent),
 held as (select distinct en.doc_id, chain, id, label from en join men on en.doc_id = men.doc_id and en.s = men.s)
 select distinct doc_id, id, label, s as start from (select doc_id, id, label, s from en union all select h.doc_id, h.id, h.label, m.s from held h join men m on h.doc_id = m.doc_id and h.chain = m.chain where m.mtype <> 'PROPER')"""


@query(COREF)
def coref_propagation(spark, d):
    at = F.col("sent_id") * 1000
    none = F.lit(None)
    entity = lambda e: F.struct(local_id(e["id"]).alias("id"), e["label"].alias("label"), (at + e["idx"]).alias("start"), (at + e["idx"] + 1).alias("end"))
    chain = lambda t: (F.col("sent_id") * 10 + F.length(t) % 5).alias("chain")
    mention = lambda t, i: F.struct(chain(t), (at + i).alias("start"), (at + i + 1).alias("end"), F.when(i == 0, "PROPER").otherwise("NOMINAL").alias("mtype"))
    mentions = F.filter(F.transform("tokens", lambda t, i: F.when(i % 6 == 0, mention(t, i))), lambda m: m.isNotNull())
    marks = F.concat(F.transform("entities", lambda e: F.struct(entity(e).alias("entity"), none.alias("mention"))), F.transform(mentions, lambda m: F.struct(none.alias("entity"), m.alias("mention"))))
    return A.propagate_marks(A.linked(documents(spark, d)).select("doc_id", F.inline(marks))).drop("end")


# --- knowledge base

WD = """prio as (select o_custkey, o_orderpriority v, row_number() over (partition by o_custkey order by o_orderpriority) + 1 as i from (select distinct o_custkey, o_orderpriority from orders)),
 base as (select 'Q' || c_custkey as id, c_name, n_name, c_mktsegment, r_name, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
 props as (select id, 'P1' relation, n_name dest from base union all select id, 'P2', c_mktsegment from base union all select b.id, 'P3', v from base b join prio on o_custkey = c_custkey)"""


@query(f"with {WD} select id, 'a ' || c_name description, c_name as label, '' sitelink, lower(c_name) alias, 1 as n_aliases from base")
def wikidata_typing(spark, d):
    return K.type_entities(wikidata(spark, d)).select("id", "description", "label", "sitelink", F.col("aliases")[0].alias("alias"), F.size("aliases").alias("n_aliases"))


@query(f"with {WD} select id, count(*) n_properties, sum(case when relation = 'P1' then 1 else 0 end) n_children, max(case when relation = 'P2' then dest end) segment from props group by id")
def wikidata_children(spark, d):
    p = K.type_entities(wikidata(spark, d)).select("id", F.inline("properties"))
    return p.groupBy("id").agg(F.count("*").alias("n_properties"), F.sum(F.size("children")).alias("n_children"), F.max(F.when(F.col("key") == "P2", F.col("value"))).alias("segment"))


def _wd_config(spark):
    return spark.createDataFrame([("nation", "P1", "*", "*", 1), ("priority", "P3", "*", "*", 2), ("nation again", "P1", "*", "*", 3), ("nowhere", "P8", "*", "*", 4)], "name string, id string, subject_type string, object_type string, class_idx int")


@query(f"with {WD} select distinct relation, id source, dest from props where relation in ('P1', 'P3')")
def relation_pairs(spark, d):
    return K.relation_pairs(wikidata(spark, d), _wd_config(spark))


@query(f"with {WD}, p as (select distinct relation, id source, dest from props where relation in ('P1','P3')) select relation, case relation when 'P1' then 'nation' else 'priority' end as name, case relation when 'P1' then 1 else 2 end class_idx, count(*) n_pairs, min(source || '>' || dest) first_pair from p group by relation")
def relation_pairs_grouped(spark, d):
    g = K.with_config(K.group_pairs(K.relation_pairs(wikidata(spark, d), _wd_config(spark))), _wd_config(spark))
    return g.select("relation", "name", "class_idx", F.size("entities").cast("long").alias("n_pairs"), F.array_min(F.transform("entities", lambda e: F.concat_ws(">", e["source"], e["dest"]))).alias("first_pair"))


@query(f"with {KG} select relation, source, dest from kg")
def known_entity_pairs(spark, d):
    return known_pairs(spark, d)


# --- distant supervision


@query(f"with {PAIRS} select doc_id, sent_id, a, b from pairs")
def entity_id_pairs(spark, d):
    return D.sentence_pairs(_annotated(spark, d)).select("doc_id", "sent_id", F.inline("pairs"))


@query(f"with {KG} select doc_id, sent_id, relation, string_agg(distinct source || '>' || dest, ';' order by source || '>' || dest) entity_pairs from known group by doc_id, sent_id, relation")
def positive_sentences(spark, d):
    out = D.positive_sentences(D.sentence_pairs(_annotated(spark, d)), known_pairs(spark, d))
    return out.withColumn("entity_pairs", F.array_join("entity_pairs", ";"))


NEG = f"""{KG}, neg as (select p.doc_id, p.sent_id, r.relation, count(*) n_pairs, min(p.a || '>' || p.b) first_pair from pairs p cross join (values ('P19'), ('P26'), ('P69')) r(relation)
 left join (select distinct doc_id, sent_id, relation, a, b from known) k on k.doc_id = p.doc_id and k.sent_id = p.sent_id and k.relation = r.relation and k.a = p.a and k.b = p.b
 where k.a is null group by p.doc_id, p.sent_id, r.relation)"""


def _negatives(spark, d, **more):
    return D.negative_sentences(D.sentence_pairs(A.linked(documents(spark, d))), known_pairs(spark, d), config(spark).select(F.col("id").alias("relation")), **more)


@query(f"with {NEG} select * from neg")
def negative_sentences(spark, d):
    return _negatives(spark, d).select("doc_id", "sent_id", "relation", F.size("entity_pairs").cast("long").alias("n_pairs"), F.col("entity_pairs")[0].alias("first_pair"))


@query(f"with {NEG}, s as (select doc_id from documents where {BUCKET.format('doc_id::varchar')} < 1000) select (select count(*) from neg where doc_id in (select doc_id from s)) n_negative, (select count(*) from s) n_docs, round((select count(*) from neg where doc_id in (select doc_id from s)) / nullif((select count(*) from s), 0)::double, 6) per_document")
def negative_rate(spark, d):
    docs = S.sample(documents(spark, d), 0.1, [F.col("doc_id")])
    neg = D.negative_sentences(D.sentence_pairs(A.annotate(docs)), known_pairs(spark, d), config(spark).select(F.col("id").alias("relation"))).agg(F.count("*").alias("n_negative"))
    return neg.crossJoin(docs.agg(F.count("*").alias("n_docs"))).withColumn("per_document", r6(ratio(F.col("n_negative"), F.col("n_docs"))))  # one row each


@query(f"with {NEG}, t as (select relation, doc_id, true positive from (select distinct doc_id, sent_id, relation from known) union all select relation, doc_id, false from neg where {BUCKET.format('doc_id::varchar')} < 2000) select relation, count(*) filter (positive) n_positive, count(*) filter (not positive) n_negative, count(distinct doc_id) n_documents from t group by relation")
def training_union(spark, d):
    sents = D.sentence_pairs(_annotated(spark, d))
    some = S.sample(sents, 0.2, [F.col("doc_id")])
    kg = known_pairs(spark, d)
    neg = D.negative_sentences(some, kg, config(spark).select(F.col("id").alias("relation")))
    return D.corpus_statistics(D.training_sentences(D.positive_sentences(sents, kg), neg))


# --- features and points


@query(f"with {OCC} select doc_id, sent_id, i1, i2, id1, id2 from occ")
def entity_pairs(spark, d):
    p = X.entity_pairs(_annotated(spark, d))
    return p.select("doc_id", "sent_id", F.col("e1.idx").alias("i1"), F.col("e2.idx").alias("i2"), local_id(F.col("e1.id")).alias("id1"), local_id(F.col("e2.id")).alias("id2"))


@query(f"with {OCC} select doc_id, sent_id, i1, i2, id1 as subject, id2 as object, true as ent1_is_subject from occ union all select doc_id, sent_id, i1, i2, id2, id1, false from occ")
def entity_pairs_directed(spark, d):
    p = X.directed(X.entity_pairs(_annotated(spark, d)))
    return p.select("doc_id", "sent_id", F.col("e1.idx").alias("i1"), F.col("e2.idx").alias("i2"), "subject", "object", "ent1_is_subject")


def _occurrences(spark, d, paths=False):
    return X.entity_pairs(_annotated(spark, d), paths).select("*", F.col("e1.idx").alias("i1"), F.col("e2.idx").alias("i2"))


LISTS = OCC + ", arr as (select doc_id, sent_id, list(tok order by idx) ws, list(pos order by idx) ps from tag group by doc_id, sent_id)"
SIDE = "list_transform([{0}], lambda k: case when k < 1 or k > len({1}) then '<empty>' else {1}[k] end)"
AROUND = SIDE.format("i1 - 2, i1 - 1, i1, i1 + 2, i1 + 3, i1 + 4, i2 - 2, i2 - 1, i2, i2 + 2, i2 + 3, i2 + 4", "{0}")


@query(f"with {LISTS} select doc_id, sent_id, i1, i2, array_to_string({AROUND.format('ws')}, ' ') words, array_to_string({AROUND.format('ps')}, ' ') tags from occ join arr using (doc_id, sent_id)")
def token_window(spark, d):
    p = _occurrences(spark, d)
    w = lambda v: F.array_join(X.token_window(v, F.col("e1"), F.col("e2")), " ")
    return p.select("doc_id", "sent_id", "i1", "i2", w("tokens").alias("words"), w("pos").alias("tags"))


@query(f"with {LISTS} select doc_id, sent_id, i1, i2, array_to_string(ws[i1 + 2 : least(i2, i1 + 11)], ' ') words from occ join arr using (doc_id, sent_id)")
def between_tokens(spark, d):
    return _occurrences(spark, d).select("doc_id", "sent_id", "i1", "i2", F.array_join(X.between("tokens", F.col("e1"), F.col("e2")), " ").alias("words"))


@query(f"with {LISTS} select doc_id, sent_id, i1, i2, ps[i1 + 1] pos1, ps[i2 + 1] pos2, t1 type1, t2 type2 from occ join arr using (doc_id, sent_id)")
def entity_pos(spark, d):
    p = X.with_features(X.directed(X.entity_pairs(_annotated(spark, d), paths=True))).where("ent1_is_subject")
    return p.select("doc_id", "sent_id", F.col("e1.idx").alias("i1"), F.col("e2.idx").alias("i2"), F.col("ent1_pos")[0].alias("pos1"), F.col("ent2_pos")[0].alias("pos2"), F.col("ent1_type").alias("type1"), F.col("ent2_type").alias("type2"))


ANC = "list_filter(list_transform(range(0, 13), lambda k: ({0} + 1) >> k), lambda x: x > 0)"
ONLY = "list_filter({0}, lambda x: not list_contains({1}, x))"
PATH = f"""{OCC}, anc as (select *, {ANC.format('i1')} a, {ANC.format('i2')} b from occ), path as (select *, list_concat({ONLY.format('a', 'b')}, list_reverse({ONLY.format('b', 'a')})) path from anc)"""


@query(f"with {PATH} select doc_id, sent_id, i1, i2, array_to_string(path, ' ') path from path")
def dependency_path(spark, d):
    return _occurrences(spark, d, paths=True).select("doc_id", "sent_id", "i1", "i2", F.array_join(F.transform("path", lambda n: (n + 1).cast("string")), " ").alias("path"))


WINDOW = f"""with {PATH}, edges as (select doc_id, sent_id, i1, i2, path, unnest([i1 + 1, 2 * (i1 + 1), 2 * (i1 + 1) + 1]) n from path),
 feat as (select e.doc_id, e.sent_id, i1, i2, dep.pos || '/' || head.tok f from edges e join tag dep on dep.doc_id = e.doc_id and dep.sent_id = e.sent_id and dep.idx = n - 1 join tag head on head.doc_id = e.doc_id and head.sent_id = e.sent_id and head.idx = (n >> 1) - 1
   where n > 1 and not list_contains(path, n)),
 best as (select doc_id, sent_id, i1, i2, min(f) f from feat group by all)
 select path.doc_id, path.sent_id, path.i1, path.i2, coalesce(f, '') edge from path left join best using (doc_id, sent_id, i1, i2)"""


@query(WINDOW)
def dependency_window(spark, d):
    p = _occurrences(spark, d, paths=True).withColumn("w", X.dependency_window(F.col("i1"), F.col("path")))
    return p.select("doc_id", "sent_id", "i1", "i2", F.coalesce(F.get(F.transform("w", lambda e: F.concat_ws("/", e["dependency"], e["word"])), F.lit(0)), F.lit("")).alias("edge"))


def _training(spark, d):
    """Sentences that train, annotated only once they are known to."""
    docs = documents(spark, d)
    with_pairs = D.sentence_pairs(A.linked(docs))
    kg = known_pairs(spark, d)
    neg = D.negative_sentences(S.sample(with_pairs, 0.1, [F.col("doc_id")]), kg, config(spark).select(F.col("id").alias("relation")))
    training = D.training_sentences(D.positive_sentences(with_pairs, kg), neg)
    return A.annotate_sentences(X.in_training(A.sentences(docs), training, config(spark)))


def _points(spark, d, paths=False):
    return X.label_points(X.directed(X.entity_pairs(_training(spark, d), paths)))


POINTS = f"""{PATH.replace(OCC, NEG + ', ' + OCC[len(ENT) + 2 :])}, train as (select distinct doc_id, sent_id, relation, true positive from known union all select doc_id, sent_id, relation, false from neg where {BUCKET.format('doc_id::varchar')} < 1000),
 dir as (select doc_id, sent_id, i1, i2, id1 subject, id2 object, t1, t2, true e1s, path from path union all select doc_id, sent_id, i1, i2, id2, id1, t1, t2, false, path from path),
 pts as (select dir.*, t.relation trel, t.positive, t.positive and exists (select 1 from known k where k.doc_id = dir.doc_id and k.sent_id = dir.sent_id and k.relation = t.relation and k.source = subject and k.dest = object) hit from dir join train t using (doc_id, sent_id)),
 lab as (select doc_id, sent_id, i1, i2, subject, object, t1, t2, e1s, path, case when hit then trel else 'neg' end relation, case when hit then case trel when 'P19' then 1 when 'P26' then 2 else 3 end else 0 end class_idx,
   case when hit then 'pos' when positive then 'nearpos' else 'neg' end point_type from pts)"""


@query(f"with {POINTS} select doc_id, sent_id, i1, i2, subject, object, relation, class_idx, point_type from lab")
def point_labels(spark, d):
    return _points(spark, d).select("doc_id", "sent_id", F.col("e1.idx").alias("i1"), F.col("e2.idx").alias("i2"), "subject", "object", "relation", "class_idx", "point_type")


@query(f"""with {POINTS} select class_idx, point_type, count(*) n from lab where class_idx in (0, 3) or (class_idx = 1 and (case when e1s then t1 else t2 end) = 'PERSON' and (case when e1s then t2 else t1 end) = 'LOCATION')
 or (class_idx = 2 and (case when e1s then t2 else t1 end) = 'PERSON') group by all""")
def prune_types(spark, d):
    return X.point_census(X.prune_types(_points(spark, d).withColumns({"ent1_type": F.col("e1.label"), "ent2_type": F.col("e2.label")}), config(spark)))


@query(f"with {POINTS} select class_idx, count(*) n from lab where len(path) > 0 group by class_idx")
def prune_paths(spark, d):
    return X.prune_paths(_points(spark, d, paths=True)).groupBy("class_idx").agg(F.count("*").alias("n"))


@query(f"with {POINTS} select class_idx, point_type, count(*) n from lab group by all")
def point_census(spark, d):
    return X.point_census(_points(spark, d))


# --- vocabularies and vectors


def _tokens(spark, d):
    return A.with_pos(A.tokenise(A.sentences(documents(spark, d)))).select("doc_id", "sent_id", F.posexplode(F.arrays_zip("tokens", "pos")).alias("idx", "t")).select("doc_id", "sent_id", "idx", F.col("t.tokens").alias("token"), F.col("t.pos").alias("pos"))


WORDS = r"vocab as (select w as token, row_number() over (order by w desc) id from (select lower(tok) w from tok where regexp_matches(tok, '[\p{L}\d]') group by 1 having count(*) >= 3))"


@query(f"with {TOK}, {WORDS} select token, id from vocab")
def word_vocab(spark, d):
    return V.word_vocabulary(_tokens(spark, d)).withColumn("id", F.col("id").cast("long"))


@query(f"with {TOK} select t as token, row_number() over (order by t) id from (select distinct lower(pos) t from tag)")
def pos_vocab(spark, d):
    return V.label_vocabulary(_tokens(spark, d).select(F.col("pos").alias("token"))).withColumn("id", F.col("id").cast("long"))


@query(f"with {ENT} select t as token, row_number() over (order by t) id from (select distinct lower(label) t from ent)")
def netype_vocab(spark, d):
    return V.label_vocabulary(_annotated(spark, d).select(F.explode("entities.label").alias("token"))).withColumn("id", F.col("id").cast("long"))


@query(f"with {PATH} select t as token, row_number() over (order by t) id from (select distinct lower(pos) t from (select doc_id, sent_id, unnest(path) n from path) p join tag on tag.doc_id = p.doc_id and tag.sent_id = p.sent_id and tag.idx = n - 1)")
def dep_vocab(spark, d):
    p = _occurrences(spark, d, paths=True)
    return V.label_vocabulary(p.select(F.explode(X.edge_features(F.col("path"))).alias("e")).select(F.col("e.dependency").alias("token"))).withColumn("id", F.col("id").cast("long"))


@query(f"with {TOK}, {WORDS} select doc_id, count(*) n_tokens, sum(coalesce(v.id, 0)) id_sum, count(*) filter (v.id is null) n_unknown from tok left join vocab v on v.token = lower(tok) group by doc_id")
def encode_tokens(spark, d):
    t = _tokens(spark, d)
    e = V.encode(t, V.word_vocabulary(t).withColumn("id", F.col("id").cast("long")))
    return e.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("id").alias("id_sum"), F.count_if(F.col("id") == 0).alias("n_unknown"))


@query("select item_id, i as pos, round(embedding[1]::double, 6) v1, round(embedding[64]::double, 6) v64 from (select item_id, cast(generate_subscripts(ws, 1) - 1 as int) i, unnest(ws) w from (select item_id, regexp_extract_all(text, '[\\p{L}\\d]+') ws from benchmark)) left join embeddings on vec_id = ('0x' || substr(md5(w), 1, 8))::bigint % 500")
def embedding_lookup(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\d]+"), 0)).alias("pos", "w"))
    words = words.withColumn("vec_id", hash_bucket(F.col("w"), buckets=500))
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return V.lookup(words, vectors, "vec_id", 64).select("item_id", "pos", r6(F.col("vec")[0].cast("double")).alias("v1"), r6(F.col("vec")[63].cast("double")).alias("v64"))


@query(f"with {POINTS} select doc_id, sent_id, 32 * 64 + 24 * 6 + 2 * 4 + 10 * 6 + 11 as width, count(*) as n_points from lab group by doc_id, sent_id")
def feature_width(spark, d):
    """Vectors of all training points, with the documents' words dealt over the embeddings."""
    words = A.tokenise(A.sentences(documents(spark, d))).select(F.explode("tokens").alias("word")).distinct().withColumn("vec_id", hash_bucket(F.col("word"), buckets=500))
    vectors = words.join(K.small(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))), "vec_id").select("word", "vec")
    sents = Z.with_lexicon(_training(spark, d), vectors, words=F.col("tokens"))
    p = X.label_points(X.directed(X.with_features(X.entity_pairs(sents, paths=True))))
    p = p.drop("sent", "tokens", "pos", "heads", "e1", "e2", "path")
    tags = {t: i + 1 for i, t in enumerate(("adv", "det", "noun", "num", "verb"))}
    out = Z.assemble(p, vectors, tags, {t.lower(): i + 1 for i, t in enumerate(A.LABELS)}, tags)
    return out.groupBy("doc_id", "sent_id").agg(F.max(F.size("vector")).alias("width"), F.count("*").alias("n_points"))


# --- sampling


def _labelled(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label")


def _balance_sql(target: str, which: str, negative_only: bool) -> str:
    b = BUCKET.format("vec_id::varchar")
    return f"""with n as (select label, count(*) n from embeddings group by label), t as (select {target} t from n where label <> 0),
 c as (select e.vec_id, e.label, {'case when e.label <> 0 then 1 else ' if negative_only else ''}t.t // n.n + (case when {b} < cast(round(cast(t.t % n.n as double) / n.n * 10000) as bigint) then 1 else 0 end){' end' if negative_only else ''} as k from embeddings e join n using (label) cross join t)
 select label, count(*) n_rows, sum(k) n_copies, sum(k * vec_id) checksum from c where k > 0 group by label"""


def _balance_row(df):
    k = df.groupBy("vec_id", "label").agg(F.count("*").alias("k"))
    return k.groupBy("label").agg(F.count("*").alias("n_rows"), F.sum("k").alias("n_copies"), F.sum(F.col("k") * F.col("vec_id")).alias("checksum"))


@query(_balance_sql("max(n) * (select count(*) - 1 from n)", "", True))
def balance_negatives(spark, d):
    return _balance_row(S.balance_negatives(_labelled(spark, d), [F.col("vec_id")]))


@query(_balance_sql("max(n)", "", False))
def balance_classes(spark, d):
    return _balance_row(S.balance_classes(_labelled(spark, d), [F.col("vec_id")]))


@query(f"select vec_id, {BUCKET.format('vec_id::varchar')} < 9000 as is_train from embeddings")
def train_test_split(spark, d):
    return S.split(_labelled(spark, d), [F.col("vec_id")]).select("vec_id", "is_train")


# --- models and scoring

TWO = """s as (select vec_id, 1 - (vec_id % 17) / 16.0 as fp, [((vec_id % 5) + 1) / 10.0, ((vec_id % 7) + 1) / 8.0, ((vec_id % 3) + 1) / 10.0] as p from embeddings)"""


@query(f"""with {TWO}, m as (select *, list_max(p) q from s) select vec_id, case when fp < 0.75 or fp * q < 0.75 then 0 else list_position(p, q) - 1 end class_idx,
 round(case when fp < 0.75 then 1 - fp when fp * q < 0.75 then 1 - fp * q else fp * q end, 6) probability, round(fp::double, 6) filter_prob, round(case when fp < 0.75 then 0.0 else q end, 6)::double class_prob from m""")
def two_stage_score(spark, d):
    i = F.col("vec_id")
    s = table(spark, d, "embeddings").select("vec_id", (1 - (i % 17) / 16.0).alias("fp"), F.array((i % 5 + 1) / 10.0, (i % 7 + 1) / 8.0, (i % 3 + 1) / 10.0).alias("p"))
    s = s.select("vec_id", M.two_stage(F.col("fp"), F.col("p")).alias("t"))
    return s.select("vec_id", F.col("t.class_idx").alias("class_idx"), r6("t.probability").alias("probability"), r6("t.filter_prob").alias("filter_prob"), r6("t.class_prob").alias("class_prob"))


FIXED = OCC.replace("between 5 and 220", "between 5 and 300")


@query(f"""with {FIXED}, dir as (select doc_id, sent_id, id1 subject, id2 object, t1 st, t2 ot from occ union all select doc_id, sent_id, id2, id1, t2, t1 from occ),
 s as (select *, 0.7 + 0.1 * (length(subject) % 4) fp, 1 + length(object) % 3 c from dir), k as (select *, fp * 0.95 p from s where fp >= 0.75 and fp * 0.95 >= 0.75)
 select doc_id::varchar as source, md5(sent) sentence_md5, subject, object as obj, ['P19','P26','P69'][c] predicate, round(p, 6)::double probability from k join sent using (doc_id, sent_id)
 where c = 3 or (c = 1 and st = 'PERSON' and ot = 'LOCATION') or (c = 2 and ot = 'PERSON')""")
def extract_with_fixed_model(spark, d):
    def score(points):
        c = F.length("object") % 3 + 1
        p = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == c, 0.95).otherwise(F.when(i == 0, 0.05).otherwise(0.0)))
        return points.withColumns({"filter_probability": F.round(0.7 + 0.1 * (F.length("subject") % 4), 6), "class_probabilities": p})

    out = P.extract_relations(documents(spark, d), config(spark), score)
    return out.select("source", F.md5("sentence").alias("sentence_md5"), "subject", "obj", F.col("predictedPredicate").alias("predicate"), r6("probability").alias("probability"))


@query("select vec_id, case label when 1 then 'P19' when 2 then 'P26' when 3 then 'P69' else '<unknown_class>: ' || label end predicate from embeddings where label <> 0")
def predicate_lookup(spark, d):
    return P.name_predicates(_labelled(spark, d).where("label <> 0").withColumnRenamed("label", "class_idx"), config(spark)).select("vec_id", "predicate")


@query()
def filter_model_scores(spark, d):
    rows = table(spark, d, "embeddings").withColumnRenamed("embedding", "vector")
    train = S.split(rows, [F.col("vec_id")]).where("is_train")
    return M.filter_probability(rows, M.fit_filter(train)).select("vec_id", "label", "filter_probability")


@query()
def classifier_scores(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    net = M.fit_network(S.split(rows, [F.col("vec_id")]).where("is_train"), 10)
    out = M.class_probabilities(rows, net)
    return out.select("vec_id", "label", (F.array_position("class_probabilities", F.array_max("class_probabilities")) - 1).cast("int").alias("prediction"), F.array_max("class_probabilities").alias("probability"))


def _scored(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("label"), F.least(F.length("text") / 40000.0, F.lit(1.0)).alias("score"))


@query(f"""with {SCORED}, b as (select least(floor(score * 100), 99)::int bin, sum(label) p, sum(1 - label) n from scored group by 1),
 w as (select bin, sum(p) over (order by bin desc) tp, sum(n) over (order by bin desc) fp, sum(p) over () ap from b)
 select round(bin / 100.0, 6)::double threshold, tp::bigint tp, fp::bigint fp, round(tp / nullif(tp + fp, 0), 6)::double as "precision", round(tp / nullif(ap, 0), 6)::double recall from w""")
def binary_metrics(spark, d):
    return M.binary_curve(_scored(spark, d)).select(r6("threshold").alias("threshold"), "tp", "fp", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(f"""with {SCORED} select round(sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end)::double / count(*), 6) auroc from scored p join scored n on p.label = 1 and n.label = 0""")
def area_under_curve(spark, d):
    return M.area_under_roc(_scored(spark, d)).select(r6("auroc").alias("auroc"))


@query(f"""with {SCORED}, b as (select least(floor(score * 100), 99)::int bin, sum(label) p, sum(1 - label) n from scored group by 1),
 w as (select bin, sum(p) over (order by bin desc) tp, sum(n) over (order by bin desc) fp, sum(p) over () ap from b), c as (select bin, tp / nullif(tp + fp, 0)::double p, tp / nullif(ap, 0)::double r from w),
 t as (select (r - coalesce(lag(r) over (order by bin desc), 0)) * (p + coalesce(lag(p) over (order by bin desc), p)) / 2 part from c) select round(sum(part), 6) auprc from t""")
def area_under_precision_recall(spark, d):
    return M.area_under_pr(M.binary_curve(_scored(spark, d))).select(r6("auprc").alias("auprc"))


@query("select label, ((vec_id * 7 + label) % 10)::int prediction, count(*) n from embeddings group by all")
def confusion_matrix(spark, d):
    return M.confusion(table(spark, d, "embeddings").select("label", ((F.col("vec_id") * 7 + F.col("label")) % 10).cast("int").alias("prediction")))


@query("""with e as (select label, ((vec_id * 7 + label) % 10)::int p from embeddings), c as (select unnest(range(0, 10))::int class_idx),
 s as (select class_idx, (select count(*) from e where label = class_idx and p = class_idx) tp, (select count(*) from e where label = class_idx) l, (select count(*) from e where p = class_idx) q from c)
 select class_idx, tp::bigint tp, l::bigint n_label, q::bigint n_predicted, round(tp / nullif(q, 0)::double, 6) as "precision", round(tp / nullif(l, 0)::double, 6) recall from s where l > 0 or q > 0""")
def per_class_metrics(spark, d):
    m = M.class_metrics(table(spark, d, "embeddings").select("label", ((F.col("vec_id") * 7 + F.col("label")) % 10).cast("int").alias("prediction")))
    return m.select("class_idx", "tp", "n_label", "n_predicted", r6("precision").alias("precision"), r6("recall").alias("recall"))


# --- evaluation


def _judged(spark, d):
    j = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
    l = table(spark, d, "labels")
    return l.select("doc_id", F.array(F.struct(j("quality").alias("judgment")), F.struct(j("toxic").alias("judgment"))).alias("judgments"))


@query("select doc_id, (quality + toxic) * 2 > 2 as positive from labels")
def majority_judgement(spark, d):
    return _judged(spark, d).select("doc_id", E.majority().alias("positive"))


@query("select conv_id, md5(string_agg(text, chr(10) order by turn)) snippet_md5 from conversations where role = 'user' group by conv_id")
def snippet_merge(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("snippet")))).alias("evidences"))
    return c.select("conv_id", F.md5(E.merged_snippet()).alias("snippet_md5"))


@query(f"""with {ENT}, ids as (select doc_id, list(distinct id) ids from ent group by doc_id), pt as (select doc_id, min(id) wd_sub, max(id) wd_obj from ent group by doc_id),
 x as (select pt.doc_id, list_contains(l.ids, pt.wd_sub) and list_contains(l.ids, pt.wd_obj) hit from pt join ids l on l.doc_id = pt.doc_id - pt.doc_id % 2)
 select count(*) n_points, count(*) filter (hit) n_linked, round(count(*) filter (hit) / nullif(count(*), 0)::double, 6) recall from x""")
def linking_recall(spark, d):
    e = _annotated(spark, d).select("doc_id", F.inline("entities")).withColumn("id", local_id(F.col("id")))
    linked = e.groupBy("doc_id").agg(F.collect_set("id").alias("linked")).withColumnRenamed("doc_id", "x")
    points = e.groupBy("doc_id").agg(F.min("id").alias("wd_sub"), F.max("id").alias("wd_obj"))
    return E.linking_recall(points.join(linked, F.col("x") == F.col("doc_id") - F.col("doc_id") % 2)).withColumn("recall", r6("recall"))


JUDGED = """p as (select event_id point_id, user_id::varchar s, event_type r, (event_id % 7)::varchar o, 2 * ((value > 100)::int + (value > 250)::int + (value > 400)::int) > 3 positive from events where event_id % 5 = 0),
 g as (select event_id - event_id % 5 point_id, user_id::varchar s, event_type r, (event_id % 7)::varchar o, max(least(value / 500.0, 1.0)) q from events group by all),
 l as (select event_id - event_id % 5 point_id, list(distinct user_id::varchar) subs, list(distinct (event_id % 7)::varchar) objs from events where value > 50 group by 1),
 pl as (select p.*, coalesce(list_contains(subs, s) and list_contains(objs, o), false) hit from p left join l using (point_id)),
 m as (select pl.point_id, pl.r relation, q, pl.s = g.s and pl.r = g.r and pl.o = g.o ok, positive, hit from pl join g using (point_id))"""


def _judged_points(spark, d):
    """Every fifth event is a point; the events up to the next one are what was extracted from it."""
    e = table(spark, d, "events").withColumns({"point_id": F.col("event_id") - F.col("event_id") % 5, "s": F.col("user_id").cast("string"), "o": (F.col("event_id") % 7).cast("string")})
    j = lambda x: F.struct(F.when(F.col("value") > x, "yes").otherwise("no").alias("judgment"))
    points = e.where("event_id % 5 = 0").select("point_id", F.col("s").alias("wd_sub"), F.col("event_type").alias("wd_pred"), F.col("o").alias("wd_obj"), F.array(j(100), j(250), j(400)).alias("judgments"), F.array(F.struct(F.col("props").alias("snippet"))).alias("evidences"))
    linked = e.where("value > 50").groupBy("point_id").agg(F.array_union(F.collect_set("s"), F.collect_set(F.concat(F.lit(""), "o"))).alias("linked"))
    found = e.select("point_id", F.col("s").alias("subject"), F.col("event_type").alias("predicate"), F.col("o").alias("obj"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("probability"))
    return E.judged_predictions(points, linked, found)


@query(f"""with {JUDGED.replace("list_contains(subs, s) and list_contains(objs, o)", "list_contains(list_concat(subs, objs), s) and list_contains(list_concat(subs, objs), o)")}, a as (select r relation, count(*) filter (positive) n_points, avg(hit::int) linking from pl group by r), c as (select relation, count(*) filter (ok) tp, count(*) n_predicted from m group by relation),
 k as (select relation, min(q) cut from (select *, row_number() over (partition by relation order by q desc) rn from m) where rn <= 50 group by relation), n as (select relation, count(*) filter (ok) / count(*)::double pr from m join k using (relation) where q >= cut group by relation),
 z as (select *, tp / nullif(n_points, 0)::double rec, tp / nullif(n_predicted, 0)::double pre from a left join c using (relation) left join n using (relation))
 select relation, n_points, tp, n_predicted, round(rec, 6) recall, round(pre, 6) as "precision", round(2 * pre * rec / nullif(pre + rec, 0), 6) f1, round(linking, 6) linking_recall, round(pr, 6) n_most_precision from z""")
def model_evaluation(spark, d):
    out = E.model_evaluation(_judged_points(spark, d), 50)
    return out.withColumns({c: r6(c) for c in ("recall", "precision", "f1", "linking_recall", "n_most_precision")})


@query(f"""with {JUDGED.replace("list_contains(subs, s) and list_contains(objs, o)", "list_contains(list_concat(subs, objs), s) and list_contains(list_concat(subs, objs), o)")}
 select count(*) n_points, count(*) filter (hit) n_linked, count(*) filter (hit and exists (select 1 from m where m.point_id = pl.point_id and ok and q >= 0.75)) n_found from pl where positive""")
def debug_analysis(spark, d):
    return E.debug_analysis(E.debug_rows(_judged_points(spark, d)))


@query(f"with {EXT} select subject, predicate, obj, max(probability) probability from ext group by all")
def dedup_predictions(spark, d):
    return E.best_per_triple(extractions(spark, d), ["subject", "predicate", "obj"]).drop("event_id")


@query(f"with {EXT} select predicate, count(*) filter (verified) tp, count(*) filter (not verified) fp from judged where probability >= 0.75 group by predicate")
def tp_fp(spark, d):
    m = E.match_known(extractions(spark, d), known_facts(spark, d)).where("probability >= 0.75")
    return m.groupBy("predicate").agg(F.count_if("verified").alias("tp"), F.count_if(~F.col("verified")).alias("fp"))


@query(f"""with {EXT}, c as (select predicate, count(*) filter (verified and probability >= 0.5) tp, count(*) filter (verified) positives, count(*) filter (probability >= 0.5) predicted from judged group by predicate),
 m as (select predicate, tp / nullif(positives, 0)::double r, tp / nullif(predicted, 0)::double p from c) select predicate, round(r, 6) recall, round(p, 6) as "precision", round(2 * p * r / nullif(p + r, 0), 6) f1 from m""")
def prf1(spark, d):
    m = E.match_known(extractions(spark, d), known_facts(spark, d))
    over = F.col("probability") >= 0.5
    c = m.groupBy("predicate").agg(F.count_if(F.col("verified") & over).alias("tp"), F.count_if("verified").alias("positives"), F.count_if(over).alias("predicted"))
    c = c.select("predicate", *E.f1_row(F.col("tp"), F.col("positives"), F.col("predicted")))
    return c.select("predicate", r6("recall").alias("recall"), r6("precision").alias("precision"), r6("f1").alias("f1"))


@query(f"""with {EXT}, r as (select *, row_number() over (partition by predicate order by probability desc) rn from judged), c as (select predicate, min(probability) cutoff from r where rn <= 50 group by predicate)
 select predicate, round(cutoff, 6) cutoff, count(*) n_taken, count(*) filter (verified) tp, round(count(*) filter (verified) / nullif(count(*), 0)::double, 6) as "precision" from judged join c using (predicate) where probability >= cutoff group by predicate, cutoff""")
def n_most_probable(spark, d):
    m = E.match_known(extractions(spark, d), known_facts(spark, d))
    return E.n_most_probable(m, 50, ["predicate"], hit="verified").withColumn("cutoff", r6("cutoff")).withColumn("precision", r6("precision"))


def _leaning(c: str) -> str:
    return f"case when verified then {c} else {c} * 0.8 end"


@query(f"""with {EXT}, s as (select verified hit, {_leaning('probability')} p from judged), m as (select avg(p) filter (hit) tm, avg(p) filter (not hit) fm from s),
 g as (select i as step, fm + i * (tm - fm) / 20 as cutoff from m, unnest(range(0, floor((1 - fm) / ((tm - fm) / 20))::bigint + 1)) t(i) where fm < tm)
 select step::int step, count(*) filter (hit and p >= cutoff) tp, count(*) filter (not hit and p >= cutoff) fp, round(cutoff, 6) cutoff from s cross join g group by step, cutoff""")
def suggest_threshold(spark, d):
    m = E.match_known(extractions(spark, d), known_facts(spark, d)).withColumn("p", F.expr(_leaning("probability")))
    return E.threshold_table(m, "p", "verified").select("step", "tp", "fp", r6("cutoff").alias("cutoff"))


@query(f"with {EXT} select event_id, subject, predicate, obj from judged where matched")
def semi_match(spark, d):
    return E.semi_match(extractions(spark, d), known_facts(spark, d)).select("event_id", "subject", "predicate", "obj")


@query(f"with {EXT} select event_id, subject, predicate, obj from judged where matched and not verified")
def anti_conflict(spark, d):
    return E.conflicting(extractions(spark, d), known_facts(spark, d)).select("event_id", "subject", "predicate", "obj")


@query(f"""with {EXT}, r as (select distinct predicate from ext union select 'never'), c as (select predicate, count(*) n, count(*) filter (matched) m, count(*) filter (verified) v from judged group by predicate)
 select predicate, coalesce(n, 0) n_extractions, coalesce(m, 0) n_matched, coalesce(v, 0) n_verified, round(m / nullif(n, 0)::double, 6) found, round(v / nullif(m, 0)::double, 6) verified_of_matched, round(v / nullif(n, 0)::double, 6) verified_of_extracted from r left join c using (predicate)""")
def data_eval_overall(spark, d):
    e = extractions(spark, d)
    relations = e.select("predicate").distinct().unionByName(spark.range(1).select(F.lit("never").alias("predicate")))
    out = E.data_evaluation(e, known_facts(spark, d), relations)
    return out.withColumns({c: r6(c) for c in ("found", "verified_of_matched", "verified_of_extracted")})


@query(f"""with {EXT}, l as (select min(probability) least_p from ext), g as (select i as step, least_p + i * (1 - least_p) / 20 t from l, unnest(range(0, 21)) u(i) where least_p < 1)
 select predicate, step::int step, count(*) filter (probability >= t) n_extractions, count(*) filter (probability >= t and matched) n_matched, count(*) filter (probability >= t and verified) n_verified,
 round(count(*) filter (probability >= t and matched) / nullif(count(*) filter (probability >= t), 0)::double, 6) found, round(count(*) filter (probability >= t and verified) / nullif(count(*) filter (probability >= t), 0)::double, 6) verified_of_extracted from judged cross join g group by predicate, step""")
def data_eval_sweep(spark, d):
    out = E.data_evaluation_sweep(extractions(spark, d), known_facts(spark, d)).drop("threshold")
    return out.withColumns({c: r6(c) for c in ("found", "verified_of_extracted")})


@query(f"with {EXT} select event_id, subject, obj, probability from ext where predicate = 'purchase' order by probability desc, subject, obj, event_id limit 100")
def topk_extractions(spark, d):
    return E.top_extractions(extractions(spark, d), "purchase").select("event_id", "subject", "obj", "probability")
