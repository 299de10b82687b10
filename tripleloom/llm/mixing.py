"""Operator 2, mixing sources to target weights: a low-discrepancy schedule, in DataFrame functions only.

Targets share all words by source weight and stop at a multiple of the source's words (water filling, by a few aggregates
over the sources). The mix is a row of slots of about one block each. Slot j sits at the golden-ratio point frac(j * phi), which the cumulative targets map to
a source; the slots of a source are ranked and share its target evenly, so together they take exactly that many words of
its shuffled documents in turn, pass after pass. A source too small for any of these points gets a slot of its own.
What a document gives, and where in the mix, is read off the slots that its words fall in.
Positions and ranks are two-level prefix sums, over hashed chunks of a source, so a hot source is spread like the others, and
over sources by their first characters.

Defined cases: a null text has size 0; documents without words are never taken. A null source is a source of its own and
comes last. Repeated rows and tied or null ids are documents of their own. Columns other than id, text and source are
ignored. No words at all: every target and taken is 0. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words, text_of

PHI = 0.6180339887498949
#: Up to so many sources their table is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """source, sid (place by code point, null last), source_size, target, lo, hi (its part of the unit interval).

    The level of the water rises while sources that it would take above their cap leave it: a few aggregates over a row
    for each source. Places and parts are sums inside the sources that begin alike, then over those beginnings.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("head", F.substring("source", 1, 4))
    inside = Window.partitionBy("head").orderBy("source")
    heads = Window.orderBy(F.col("head").isNull(), "head")  # far fewer than sources
    earlier = lambda c: F.coalesce(F.sum(c).over(heads.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per.groupBy("head").agg(F.count("*").alias("n")).select(F.col("head").alias("k"), earlier("n").alias("base"))
    per = per.withColumn("rn", F.row_number().over(inside) - 1).join(bases, F.col("head").eqNullSafe(F.col("k")))
    per = per.withColumn("sid", (F.col("base") + F.col("rn")).cast("long"))
    per = per.withColumn("w", F.array(*[F.lit(float(w)) for w in weights])[F.pmod("sid", F.lit(len(weights))).cast("int")])
    per = materialise(per.select("source", "head", "sid", "source_size", "w", (F.col("source_size") * float(max_repeat)).alias("cap")), "mix-sources")
    total, left = per.agg(F.sum("source_size"), F.sum("w")).first()
    level = total / left if left else 0.0
    while left:
        over = F.col("cap") <= level * F.col("w")
        capped, left = per.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        new = (total - capped) / left if left else level
        if new <= level:
            break
        level = new
    # without a source below its cap all stand at it
    per = per.withColumn("target", F.least(F.col("cap"), F.col("w") * level)).withColumn("words", F.round("target").cast("long"))
    bases = per.groupBy("head").agg(F.sum("words").alias("n")).select(F.col("head").alias("k"), earlier("n").alias("base"))
    all_words = per.agg(F.sum("words")).first()[0] or 0
    per = per.withColumn("upto", F.sum("words").over(inside)).join(bases, F.col("head").eqNullSafe(F.col("k"))).withColumn("upto", F.col("base") + F.col("upto"))
    part = lambda c: c / F.lit(float(all_words)) if all_words else F.lit(0.0)
    return per.select("source", "sid", "source_size", "target", part(F.col("upto") - F.col("words")).alias("lo"), part(F.col("upto")).alias("hi"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def schedule(targets: DataFrame, n_sources: int, total: int, block: int) -> DataFrame:
    """The mix in order: slot, sid, slot_rank, start, end (words of the source's line, which repeats after source_size)."""
    spark = targets.sparkSession
    n_slots = -(-total // block) if total else 0
    bins = max(1024, 4 * n_sources)
    last = F.lit(bins - 1).cast("long")
    spans = targets.where("hi > lo").select("sid", "target", "lo", F.when(F.col("hi") > 1 - 1e-12, 2.0).otherwise(F.col("hi")).alias("hi"))
    spans = spans.withColumn("bin", F.explode(F.sequence(F.least(F.floor(F.col("lo") * bins), last), F.least(F.floor(F.col("hi") * bins), last))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"(id * {PHI}D) % 1.0D").alias("x"))
    slots = slots.withColumn("bin", F.least(F.floor(F.col("x") * bins), last))
    # the spans are at most bins + n_sources rows
    found = slots.join(_small(spans, n_sources), "bin").where("x >= lo and x < hi").select("slot", "sid", "target")
    # points that no slot meets, since a source's part is smaller than the gaps
    missed = targets.where("round(target) > 0").join(found.select(F.col("sid").alias("k")).distinct(), F.col("sid") == F.col("k"), "left_anti")
    found = found.unionByName(missed.select(F.floor(F.col("lo") * n_slots).alias("slot"), "sid", "target"))
    found = found.withColumn("chunk", F.floor(F.col("slot") / max(256, int(n_slots**0.5))))
    sums = found.groupBy("sid", "chunk").count()
    sums = sums.withColumn("slots", F.sum("count").over(Window.partitionBy("sid")))
    sums = sums.withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    found = found.join(sums, ["sid", "chunk"]).withColumn("slot_rank", F.col("base") + F.col("rn"))
    upto = lambda rank: F.floor(F.round("target") * rank / F.col("slots")).cast("long")
    return found.select("slot", "sid", "slot_rank", upto(F.col("slot_rank")).alias("start"), upto(F.col("slot_rank") + 1).alias("end"))


def in_mix(slots: DataFrame, n_slots: int) -> DataFrame:
    """Slots that hold words, with `place`: the words of the mix before them."""
    inside = Window.partitionBy("part").orderBy("slot", "sid").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("end") - F.col("start")
    slots = slots.where("end > start").withColumn("part", F.floor(F.col("slot") / max(256, int(n_slots**0.5))))
    sums = slots.groupBy("part").agg(F.sum(length).alias("words"))  # some root of the slots
    sums = sums.select(F.col("part").alias("p"), (F.sum("words").over(Window.orderBy("part")) - F.col("words")).alias("base"))
    slots = slots.withColumn("ahead", F.sum(length).over(inside) - length)
    return slots.join(sums, F.col("part") == F.col("p")).select("slot", "sid", "start", "end", (F.col("base") + F.col("ahead")).alias("place"))


def read_slots(line: DataFrame, slots: DataFrame, max_repeat: int, width: int) -> DataFrame:
    """What the slots read of a line of documents (row, sid, position, size, source_size): row, taken, places.

    Spans of the line and of the slots are cut at every `width` words and meet there.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))
    docs = line.where("size > 0").select("row", "sid", "position", "size", "source_size", "target", passes.alias("pass"))
    docs = docs.withColumn("a", F.col("position") + F.col("pass") * F.col("source_size")).withColumn("b", F.col("a") + F.col("size"))
    docs = docs.where("a < target + 1").select("row", "pass", F.col("sid").alias("s"), "a", "b", bins(F.col("a"), F.col("b")).alias("at"))
    slots = slots.select("sid", "start", "end", "place", bins(F.col("start"), F.col("end")).alias("bin"))
    met = docs.join(slots, (F.col("s") == F.col("sid")) & (F.col("at") == F.col("bin")))
    met = met.withColumn("from", F.greatest("a", "start", F.col("bin") * width)).withColumn("to", F.least("b", "end", (F.col("bin") + 1) * width)).where("from < to")
    first = lambda k: F.max(F.when((F.col("pass") == k) & (F.col("from") == F.col("a")), F.col("place") + F.col("a") - F.col("start")))
    return met.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.array_compact(F.array(*[first(k) for k in range(max_repeat)])).alias("places"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeat: int = 3,
    block: int = 1024,
    seed: int = 17,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, position (its first word's place in its source's shuffled line), places and mix_words.

    taken: the words that the schedule's slots read of it. places: for each time that it is read from its start, that word's place in the
    mix of mix_words words. block: words in a block; it sets how fine the mix is, not what a source gets. carry: columns passed through in a
    struct `carried` instead of the id.
    """
    keep = F.struct(*carry).alias("carried") if carry else F.col(id_col).alias("carried")
    sizes = docs.select(F.monotonically_increasing_id().alias("row"), keep, F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_of(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("h"))
    sizes = materialise(sizes, "mix-sizes")
    targets = materialise(source_targets(sizes, weights, max_repeat), "mix-targets")
    n_sources, total = targets.agg(F.count("*"), F.sum("source_size")).first()
    total = int(total or 0)
    chunks = max(1, int(sizes.count() ** 0.5))

    of_source = _small(targets.select(F.col("source").alias("s"), "sid", "source_size", "target"), n_sources)
    rows = sizes.select("row", "id", "source", "size", "h").join(of_source, F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("chunk", F.pmod("h", F.lit(chunks)))
    inside = Window.partitionBy("sid", "chunk").orderBy("h", "id", "size", "row")
    rows = rows.withColumn("ahead", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    rows = rows.join(sums, ["sid", "chunk"]).withColumn("position", (F.col("base") + F.col("ahead")).cast("long"))
    line = materialise(rows.select("row", "sid", "size", "source_size", "target", "position"), "mix-line")

    slots = materialise(schedule(targets, n_sources, total, block), "mix-slots")
    slots = materialise(in_mix(slots, slots.count()), "mix-places")
    mix_words = slots.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    read = read_slots(line, slots, max_repeat, max(block, 1024)).withColumnRenamed("row", "r")
    out = line.join(read, F.col("row") == F.col("r"), "left").drop("r")
    out = out.join(sizes.select(F.col("row").alias("r"), "carried"), F.col("row") == F.col("r"))
    return out.select(
        F.col("carried").alias("carried" if carry else id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position", F.coalesce("places", F.array().cast("array<bigint>")).alias("places"), F.lit(mix_words).cast("long").alias("mix_words"),
    )
