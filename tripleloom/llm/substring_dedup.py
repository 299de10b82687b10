"""Operator 5, substring dedup by line and passage hashing.

Units are lines of at least `min_words` words. A unit is normalised (A-Z lower-cased, white space collapsed, outer
punctuation dropped) and hashed to 128 bits. Digests meet in one aggregate over all documents, which keeps the earliest
occurrence by (id, row, offset); every other occurrence is a removed span with its original offsets. Rows get stored
numbers of their own, and spans belong to a row.

Passages that begin or end inside a line are found by words. Windows of WINDOW words are hashed, and the least hash of each
STEP consecutive windows is an anchor (winnowing), so two occurrences of WINDOW + STEP - 1 words share an anchor wherever
they begin. Anchors meet like units. Anchors that touch and repeat the same place make a segment, which is lengthened by
the words that agree before and after it; the nearest anchor is less than STEP words away, so STEP words on each side reach
the ends. Runs of PASSAGE words and more are removed. Repeats shorter than PASSAGE words stay: documents share short lines
and sentences without being copies. An anchor is held against its earliest occurrence only: where that sits in a shorter
repeat, up to STEP words stay.

Defined cases: a null text is empty. A null id ranks first. Rows that share an id, or have none, are documents of their
own, in the order of their stored numbers; of rows that also share the text the first keeps it. Repeats inside one
document count. Other columns are ignored. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, materialise
from .hashing import Hasher, Words, runs, slices

TRIM = b" .,;:!?\"'()[]{}-"
WORDS = re.compile(WORD)
#: Words in a hashed window, windows of which one is an anchor, words of a run that is removed: WINDOW + STEP - 1 < PASSAGE, and anchors touch.
WINDOW, STEP, PASSAGE = 20, 20, 40


def lines_of(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, 128-bit digest as two numbers) of the lines of min_words words and more, characters from 0."""
    a = np.frombuffer(words.raw, np.uint8)
    ends = np.flatnonzero(a == 10)
    first = np.searchsorted(words.starts, np.concatenate([[0], ends]))
    long = np.flatnonzero(np.diff(first) >= min_words)
    starts, ends = words.starts[first[long]], ends[long]
    text = np.searchsorted(words.text_at, starts, "right") - 1
    digests = [hashlib.md5(b" ".join(words.raw[s:e].split()).strip(TRIM), usedforsecurity=False).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    characters = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80, dtype=np.int32)])
    of = lambda at: characters[at] - characters[words.text_at[text]]
    return text, of(starts), of(ends), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _slide(best: np.ufunc, x: np.ndarray) -> np.ndarray:
    """best of each STEP consecutive values, by doubling."""
    width = 1
    while 2 * width <= STEP:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[: len(x) - (STEP - width)], x[STEP - width :])


def anchors_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in words, hash) of the least of each STEP consecutive windows, of equal ones all."""
    windows = runs(words.hashes, WINDOW)
    if len(windows) < STEP:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), windows[:0]
    text = np.repeat(np.arange(len(words.first) - 1), words.lengths())
    least = _slide(np.minimum, windows)
    # a group of windows counts only inside one text
    least[text[: len(least)] != text[WINDOW + STEP - 2 :]] = 0
    at = np.flatnonzero(_slide(np.maximum, np.pad(least, STEP - 1)) == windows)
    return text[at], at - words.first[text[at]], windows[at]


def segments(row: np.ndarray, start: np.ndarray, first_row: np.ndarray, first_start: np.ndarray) -> list[np.ndarray]:
    """row, start, end, first_row, first_start in words: a row's repeated anchors joined where they touch at the same distance from the same row."""
    away = start - first_start
    order = np.lexsort((start, away, first_row, row))
    row, start, first_row, away = row[order], start[order], first_row[order], away[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (first_row[1:] != first_row[:-1]) | (away[1:] != away[:-1]) | (start[1:] > start[:-1] + WINDOW)
    begin = np.flatnonzero(new)
    end = start[np.append(begin[1:], len(row))[: len(begin)] - 1] + WINDOW
    return [row[begin], start[begin], end, first_row[begin], start[begin] - away[begin]]


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first words of each row are the same and in both texts."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], np.argmin(same, axis=1))


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the spans merged."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, at = [], 0
    for s, e in merged:
        kept.append(text[at:s])
        at = e
    return "".join([*kept, text[at:]]), [tuple(x) for x in merged]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (unique, stored), id, text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(rows, "dedup-rows")


def repeated_units(rows: DataFrame, *, min_words: int = PASSAGE) -> DataFrame:
    """row, spans (start, end, by_word: in words or in characters): where each row of rows(row, id, text) repeats an earlier occurrence; only rows that do."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for some in slices(batch):
                words = hasher.column(some.column("text"))
                of_line, start, end, digest = lines_of(words, min_words)
                of_anchor, place, hashes = anchors_of(words)
                take, none = pa.array(np.concatenate([of_line, of_anchor])), np.zeros(len(place), np.int64)
                columns = [(start, place), (end, none - 1), (digest[:, 0], hashes.view(np.int64)), (digest[:, 1], none)]  # end -1: an anchor, in words
                yield pa.record_batch(
                    [some.column("row").take(take), some.column("id").take(take), *(pa.array(np.concatenate(c)) for c in columns)], names=["row", "id", "start", "end", "d1", "d2"]
                )

    units = rows.mapInArrow(run, f"row long, id {kind}, start long, end long, d1 long, d2 long")
    groups = units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "start")).alias("first")).where("n > 1")
    stored = materialise(groups.select("d1", "d2", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")), "repeated-digests")
    later = units.drop("id").join(stored, ["d1", "d2"]).where((F.col("row") != F.col("first_row")) | (F.col("start") != F.col("first_start")))
    later = materialise(later.select("row", "start", "end", "first_row", "first_start"), "repeated-units")
    discard(stored)
    # of anchors that overlap their own first occurrence that one stays
    anchors = later.where((F.col("end") < 0) & ((F.col("row") != F.col("first_row")) | (F.col("start") >= F.col("first_start") + WINDOW)))
    found = passages(rows, anchors)
    spans = later.where("end >= 0").select("row", "start", "end", F.lit(False).alias("by_word")).unionByName(found)
    # a row's own spans
    spans = materialise(spans.groupBy("row").agg(F.collect_set(F.struct("start", "end", "by_word")).alias("spans")), "repeated-spans")
    discard(later, found)
    return spans


def passages(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """row, start, end, by_word: the runs of at least PASSAGE words around anchors(row, start, first_row, first_start), in words."""

    def join_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            flat = found.flatten()
            row = np.repeat(batch.column("row").to_numpy(), pa.compute.list_value_length(found).to_numpy(zero_copy_only=False))
            made = segments(row, *(flat.field(c).to_numpy() for c in ("start", "first_row", "first_start")))
            yield pa.record_batch([pa.array(m) for m in made], names=["row", "start", "end", "first_row", "first_start"])

    by_row = anchors.groupBy("row").agg(F.collect_list(F.struct("start", "first_row", "first_start")).alias("found"))
    found = by_row.mapInArrow(join_anchors, "row long, start long, end long, first_row long, first_start long")
    found = materialise(found.withColumn("first_end", F.col("first_start") + F.col("end") - F.col("start")), "repeated-segments")

    # the words beside each segment and beside its first occurrence, read once a row
    asked = found.select("row", "start", "end").unionByName(found.select(F.col("first_row").alias("row"), F.col("first_start").alias("start"), F.col("first_end").alias("end")))
    asked = asked.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("asked")).withColumnRenamed("row", "r")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for some in slices(batch):
                words, asked = hasher.column(some.column("text")), some.column("asked")
                n = pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False)
                text, flat = np.repeat(np.arange(some.num_rows), n), asked.flatten()
                start, end = (flat.field(c).to_numpy() for c in ("start", "end"))
                # the words on both sides, outwards; 0 beyond the text
                away = np.arange(STEP)
                before, after = (start - 1)[:, None] - away, end[:, None] + away
                sides = []
                for place in (before, after):
                    inside = (place >= 0) & (place < words.lengths()[text][:, None])
                    h = words.hashes[np.where(inside, place + words.first[text][:, None], 0)].astype("<u4")
                    sides.append(np.where(inside, np.maximum(h, 1), 0).astype("<u4"))
                as_binary = lambda x: pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (4 * STEP)), pa.py_buffer(x.tobytes())])
                yield pa.record_batch(
                    [some.column("row").take(pa.array(text)), pa.array(start), pa.array(end), *map(as_binary, sides)], names=["r", "s", "e", "before", "after"]
                )

    sides = rows.join(asked, F.col("row") == F.col("r")).select("row", "text", "asked").mapInArrow(beside, "r long, s long, e long, before binary, after binary")
    sides = materialise(sides, "repeated-sides")
    firsts = sides.select(F.col("r").alias("fr"), F.col("s").alias("fs"), F.col("e").alias("fe"), F.col("before").alias("first_before"), F.col("after").alias("first_after"))
    pairs = found.join(sides, (F.col("row") == F.col("r")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e"))).drop("r", "s", "e")
    pairs = pairs.join(firsts, (F.col("first_row") == F.col("fr")) & (F.col("first_start") == F.col("fs")) & (F.col("first_end") == F.col("fe")))
    pairs = pairs.select("row", "start", "end", "first_row", "first_end", "before", "after", "first_before", "first_after")

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, first_row, first_end = (batch.column(c).to_numpy() for c in ("row", "start", "end", "first_row", "first_end"))
            four = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, STEP) for c in ("before", "after", "first_before", "first_after")]
            back, ahead = agree(four[0], four[2]), agree(four[1], four[3])
            # not into the first occurrence
            back = np.where(row == first_row, np.minimum(back, np.maximum(0, start - first_end)), back)
            long = np.flatnonzero(end + ahead - start + back >= PASSAGE)
            yield pa.record_batch(
                [pa.array(row[long]), pa.array((start - back)[long]), pa.array((end + ahead)[long]), pa.array(np.ones(len(long), bool))], names=["row", "start", "end", "by_word"]
            )

    out = materialise(pairs.mapInArrow(lengthen, "row long, start long, end long, by_word boolean"), "repeated-passages")
    discard(found, sides)
    return out


def in_characters(text: str, found: list[dict]) -> list[tuple[int, int]]:
    """Spans (start, end, by_word) as places in the text."""
    at = [m.span() for m in WORDS.finditer(text)] if any(x["by_word"] for x in found) else []
    return [(at[x["start"]][0], at[x["end"] - 1][1]) if x["by_word"] else (x["start"], x["end"]) for x in found]


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = PASSAGE) -> DataFrame:
    """One row per document: id, n_removed (spans), removed_chars, n_chars, spans (merged, offsets of the original text), text (without them)."""
    rows = numbered(docs, id_col, text_col)
    spans = repeated_units(rows, min_words=min_words).withColumnRenamed("row", "r")
    rows = rows.join(spans, F.col("row") == F.col("r"), "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                left, merged = cut(text, in_characters(text, found or []))
                done.append((len(merged), len(text) - len(left), len(text), [{"start": s, "end": e} for s, e in merged], left))
            n, removed, chars, spans, left = ([d[j] for d in done] for j in range(5))
            yield pa.record_batch(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(chars, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(left, pa.string())],
                names=["id", "n_removed", "removed_chars", "n_chars", "spans", "text"],
            )

    out = rows.mapInArrow(run, f"id {kind}, n_removed long, removed_chars long, n_chars long, spans array<struct<start: int, end: int>>, text string")
    return out.withColumnRenamed("id", id_col)
