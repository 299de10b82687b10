"""Row types of the relation-extraction data model."""

from pyspark.sql import types as T

LANG_TEXT = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())]))
PAIR = T.StructType([T.StructField("source", T.StringType()), T.StructField("dest", T.StringType())])

RELATION_CONFIG = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "id", "subject_type", "object_type")])

WIKIDATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("descriptions", LANG_TEXT),
    T.StructField("properties", T.ArrayType(T.StructType([
        T.StructField("idx", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("datatype", T.StringType()), T.StructField("parent", T.IntegerType()),
    ]))),
    T.StructField("sitelinks", LANG_TEXT),
    T.StructField("aliases", LANG_TEXT),
    T.StructField("labels", LANG_TEXT),
])

SPAN = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
CORPUS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("uri", T.StringType()), T.StructField("type", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("sentences", T.ArrayType(T.StructType(SPAN))),
    T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), *SPAN, T.StructField("text", T.StringType()), T.StructField("pos", T.StringType())]))),
    T.StructField("deps", T.ArrayType(T.StructType([T.StructField("tail_idx", T.IntegerType()), T.StructField("head_idx", T.IntegerType()), T.StructField("rel", T.StringType())]))),
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField("ned_id", T.StringType()), T.StructField("ne_label", T.StringType()), *SPAN]))),
    T.StructField("mentions", T.ArrayType(T.StructType([T.StructField("chain", T.StringType()), *SPAN, T.StructField("mtype", T.StringType())]))),
])

EXTRACTION = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("subject", "predictedPredicate", "obj", "sentence", "source")),
    *(T.StructField(n, T.DoubleType()) for n in ("probability", "filterProbability", "classificationProbability")),
])

EVALUATION_POINT = T.StructType([
    T.StructField("wd_sub", T.StringType()), T.StructField("sub", T.StringType()),
    T.StructField("judgments", T.ArrayType(T.StructType([T.StructField("judgment", T.StringType()), T.StructField("rater", T.StringType())]))),
    T.StructField("pred", T.StringType()),
    T.StructField("evidences", T.ArrayType(T.StructType([T.StructField("snippet", T.StringType()), T.StructField("url", T.StringType())]))),
    T.StructField("wd_obj", T.StringType()), T.StructField("obj", T.StringType()), T.StructField("wd_pred", T.StringType()),
])
