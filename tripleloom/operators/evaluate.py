"""Evaluation of extractions against known facts and of models against judged points. Each is one plan over all relations and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .kg import small

STEPS = 20


def majority(judgments: str = "judgments") -> Column:
    """More than half say yes; none of none is no."""
    return F.size(F.filter(judgments, lambda j: j["judgment"] == "yes")) * 2 > F.size(judgments)


def judged_points(points: DataFrame) -> DataFrame:
    """Points with linked ids whose judgement is positive."""
    return points.where((F.col("wd_sub") != "false") & (F.col("wd_obj") != "false") & (F.col("wd_pred") != "false") & majority())


def merged_snippet(evidences: str = "evidences") -> Column:
    return F.array_join(F.transform(evidences, lambda e: e["snippet"]), "\n")


def linking_recall(points: DataFrame) -> DataFrame:
    """n_points, n_linked, recall: both ids of a point among the linked ids of its text. points: wd_sub, wd_obj, linked array."""
    hit = F.array_contains("linked", F.col("wd_sub")) & F.array_contains("linked", F.col("wd_obj"))
    return points.agg(F.count("*").alias("n_points"), F.count_if(hit).alias("n_linked")).withColumn("recall", ratio(F.col("n_linked"), F.col("n_points")))


def judged_predictions(points: DataFrame, linked: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row for each point with linked ids: point_id, relation, positive, triple, snippet, entities_linked, and its predictions, one a triple, with whether they are the point's.

    points: point_id, wd_sub, wd_pred, wd_obj, judgments, evidences; linked: point_id, linked; predictions: point_id, subject, predicate, obj, probability.
    """
    points = points.where((F.col("wd_sub") != "false") & (F.col("wd_obj") != "false") & (F.col("wd_pred") != "false"))
    best = best_per_triple(predictions.select("point_id", "subject", "predicate", "obj", "probability"), ["point_id", "subject", "predicate", "obj"])
    of_point = best.groupBy("point_id").agg(F.collect_list(F.struct("subject", "predicate", "obj", "probability")).alias("found"))
    rows = points.join(linked, "point_id", "left").join(of_point, "point_id", "left")
    same = lambda p: (p["subject"] == F.col("wd_sub")) & (p["predicate"] == F.col("wd_pred")) & (p["obj"] == F.col("wd_obj"))
    marked = F.transform("found", lambda p: F.struct(p["subject"].alias("subject"), p["predicate"].alias("predicate"), p["obj"].alias("obj"), p["probability"].alias("probability"), same(p).alias("correct")))
    return rows.select(
        "point_id", F.col("wd_pred").alias("relation"), majority().alias("positive"), F.concat_ws("/", "wd_sub", "wd_pred", "wd_obj").alias("triple"), F.array_join(F.transform("evidences", lambda e: e["snippet"]), " >> ").alias("snippet"),
        F.coalesce(F.array_contains("linked", F.col("wd_sub")) & F.array_contains("linked", F.col("wd_obj")), F.lit(False)).alias("entities_linked"),
        F.coalesce(marked, F.array().cast("array<struct<subject:string,predicate:string,obj:string,probability:double,correct:boolean>>")).alias("predictions"),
    )


def model_evaluation(judged: DataFrame, n: int = 100) -> DataFrame:
    """By relation: n_points (positive ones), tp, n_predicted, recall, precision, f1, linking_recall over all points, and precision of the n most probable."""
    count = lambda test: F.size(F.filter("predictions", test))
    per = judged.groupBy("relation").agg(
        F.count_if("positive").alias("n_points"), F.sum(count(lambda p: p["correct"])).alias("tp"), F.sum(F.size("predictions")).alias("n_predicted"), F.avg(F.col("entities_linked").cast("int")).alias("linking_recall")
    )
    most = n_most_probable(judged.select("relation", F.inline("predictions")), n, ["relation"], hit="correct").select(F.col("relation").alias("r"), F.col("precision").alias("n_most_precision"))
    per = per.join(most, F.col("relation") == F.col("r"), "left")
    return per.select("relation", "n_points", "tp", "n_predicted", *f1_row(F.col("tp"), F.col("n_points"), F.col("n_predicted")), "linking_recall", "n_most_precision")


def debug_rows(judged: DataFrame) -> DataFrame:
    """What each point got, as text; predictions as triple - probability - whether correct, tabs between them."""
    one = lambda p: F.concat(F.concat_ws("/", p["subject"], p["predicate"], p["obj"]), F.lit(" - "), p["probability"].cast("string"), F.lit(" - "), p["correct"].cast("string"))
    return judged.select(
        F.col("snippet").alias("Sentences"), F.col("positive").cast("string").alias("Positive Datapoint"), F.col("triple").alias("RDF-triple"), F.col("entities_linked").cast("string").alias("Herd"),
        F.array_join(F.transform("predictions", one), "\t").alias("Predicted Results:"),
    )


def debug_analysis(debug: DataFrame, threshold: float = 0.75) -> DataFrame:
    """From debug rows: positive points, those with both entities linked, and of these those with a correct prediction over the threshold."""
    part = lambda p, i: F.element_at(F.split(p, " - "), i)
    hit = F.exists(F.filter(F.split("`Predicted Results:`", "\t"), lambda p: p != ""), lambda p: (part(p, -1) == "true") & (part(p, -2).cast("double") >= threshold))
    linked = F.col("Herd") == "true"
    return debug.where("`Positive Datapoint` = 'true'").agg(F.count("*").alias("n_points"), F.count_if(linked).alias("n_linked"), F.count_if(linked & hit).alias("n_found"))


def best_per_triple(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """The most probable prediction of each key; ties go to the smallest row."""
    others = [c for c in predictions.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc("probability"), *[c for c in others if c != "probability"])
    return predictions.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def f1_row(tp: Column, positives: Column, predicted: Column) -> list[Column]:
    r, p = ratio(tp, positives), ratio(tp, predicted)
    return [r.alias("recall"), p.alias("precision"), ratio(2 * p * r, p + r).alias("f1")]


def n_most_probable(scored: DataFrame, n: int, by: list[str], probability: str = "probability", hit: str = "hit") -> DataFrame:
    """by, cutoff (the n-th highest probability or the last), n_taken (ties included), precision."""
    w = Window.partitionBy(*by).orderBy(F.desc(probability))
    cut = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).groupBy(*by).agg(F.min(probability).alias("cutoff"))
    rows = scored.join(small(cut), by).where(F.col(probability) >= F.col("cutoff"))
    per = rows.groupBy(*by, "cutoff").agg(F.count("*").alias("n_taken"), F.count_if(F.col(hit)).alias("tp"))
    return per.withColumn("precision", ratio(F.col("tp"), F.col("n_taken")))


def threshold_table(scored: DataFrame, probability: str = "probability", hit: str = "hit", steps: int = STEPS) -> DataFrame:
    """Metrics at cutoffs from the false ones' mean probability to 1, if the true ones' mean is higher."""
    means = scored.agg(F.avg(F.when(F.col(hit), F.col(probability))).alias("tm"), F.avg(F.when(~F.col(hit), F.col(probability))).alias("fm"))
    step = (F.col("tm") - F.col("fm")) / steps
    grid = means.where("fm < tm").select(F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((1 - F.col("fm")) / step).cast("int")), lambda i: F.col("fm") + i * step)).alias("step", "cutoff"))
    # the grid is one row, exploded; each prediction meets its cutoffs once
    rows = scored.join(F.broadcast(grid.agg(F.collect_list(F.struct("step", "cutoff")).alias("g"))))
    rows = rows.select(F.col(hit).alias("hit"), F.col(probability).alias("p"), F.inline("g"))
    per = rows.groupBy("step", "cutoff").agg(F.count_if((F.col("p") >= F.col("cutoff")) & F.col("hit")).alias("tp"), F.count_if((F.col("p") >= F.col("cutoff")) & ~F.col("hit")).alias("fp"), F.count_if("hit").alias("positives"))
    return per.select("step", "cutoff", "tp", "fp", *f1_row(F.col("tp"), F.col("positives"), F.col("tp") + F.col("fp")))


def match_known(extractions: DataFrame, known: DataFrame) -> DataFrame:
    """Adds matched (subject and predicate are known) and verified (the object too); an extraction stays one row."""
    sp = known.select(F.col("subject").alias("ks"), F.col("predicate").alias("kp")).distinct()
    spo = known.select(F.col("subject").alias("vs"), F.col("predicate").alias("vp"), F.col("obj").alias("vo")).distinct()
    rows = extractions.join(sp, (F.col("subject") == F.col("ks")) & (F.col("predicate") == F.col("kp")), "left")
    rows = rows.join(spo, (F.col("subject") == F.col("vs")) & (F.col("predicate") == F.col("vp")) & (F.col("obj") == F.col("vo")), "left")
    return rows.select(*extractions.columns, F.col("ks").isNotNull().alias("matched"), F.col("vs").isNotNull().alias("verified"))


def semi_match(extractions: DataFrame, known: DataFrame) -> DataFrame:
    return extractions.join(known, ["subject", "predicate"], "left_semi")


def conflicting(extractions: DataFrame, known: DataFrame) -> DataFrame:
    """Matched, but no known object equals the extracted one."""
    return semi_match(extractions, known).join(known, ["subject", "predicate", "obj"], "left_anti")


def data_evaluation(extractions: DataFrame, known: DataFrame, relations: DataFrame) -> DataFrame:
    """predicate, n_extractions, n_matched, n_verified, found, verified_of_matched, verified_of_extracted; a row for each relation."""
    per = match_known(extractions, known).groupBy("predicate").agg(F.count("*").alias("n"), F.count_if("matched").alias("m"), F.count_if("verified").alias("v"))
    rows = small(relations.select("predicate").distinct()).join(per, "predicate", "left")
    n, m, v = (F.coalesce(c, F.lit(0)) for c in ("n", "m", "v"))
    return rows.select("predicate", n.alias("n_extractions"), m.alias("n_matched"), v.alias("n_verified"), ratio(m, n).alias("found"), ratio(v, m).alias("verified_of_matched"), ratio(v, n).alias("verified_of_extracted"))


def data_evaluation_sweep(extractions: DataFrame, known: DataFrame, steps: int = STEPS) -> DataFrame:
    """The same at steps + 1 thresholds from the least probability to 1."""
    least = extractions.agg(F.min("probability").alias("least"))
    rows = match_known(extractions, known).join(F.broadcast(least))
    rows = rows.where("least < 1").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("threshold", F.col("least") + F.col("step") * (1 - F.col("least")) / steps)
    hit = F.col("probability") >= F.col("threshold")
    per = rows.groupBy("predicate", "step", "threshold").agg(F.count_if(hit).alias("n_extractions"), F.count_if(hit & F.col("matched")).alias("n_matched"), F.count_if(hit & F.col("verified")).alias("n_verified"))
    return per.withColumns({"found": ratio(F.col("n_matched"), F.col("n_extractions")), "verified_of_extracted": ratio(F.col("n_verified"), F.col("n_extractions"))})


def top_extractions(extractions: DataFrame, predicate: str, n: int = 100) -> DataFrame:
    """The n most probable of a relation; ties by subject, object and the rest of the row."""
    rest = [c for c in extractions.columns if c not in ("probability", "predicate")]
    return extractions.where(F.col("predicate") == predicate).orderBy(F.desc("probability"), *rest).limit(n)
