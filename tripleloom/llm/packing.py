"""Operator 10, packing: non-negative least squares over shallow length combinations.

Documents are tokenised once and stored in blocks. Each gives its full windows and one remainder; the remainders'
histogram has at most window - 1 lengths, whatever the corpus. All pairs and triples of lengths that fill a window are the
columns of a least-squares problem with non-negative repeat counts, solved on the driver against that histogram; counts
are rounded down, and what remains is packed greedily, window after window, cutting at each window's end. A remainder
finds its place by its rank among those of its length: its rank in the block plus the counts of the blocks before.

Defined cases: a null text is empty and gives the end id alone. Repeated rows and tied or null ids are documents of their
own. Other columns are ignored. Empty in, empty out. Only the last sequence can be short; it is padded unless its length
is a power of two.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 1024
#: Documents in a block, pieces of text kept with their ids by a worker.
BLOCK, CACHE = 1024, 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the tokenizer file; ids of the pieces it splits texts into are kept and used again.

    The split is the byte-level one that the file names. A new piece is merged by the file's own ranks where that is proven
    to give the tokenizer's ids, else by the tokenizer. Special strings in a text are ordinary text.
    """

    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import json
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not conf.get("normalizer")
        self.split = regex.compile(self.PIECE).findall if plain else None
        self.merge = self._merger(conf) if plain else None
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        self.code = "H" if self.type == np.uint16 else "I"
        self.kept: dict[str, bytes] = {}

    def _merger(self, conf: dict):
        """Ids of a piece by the ranks of the file's vocabulary; None unless they are the tokenizer's for every piece.

        Merging the pair of least rank first is the tokenizer's own rule if ids rise along the merges and every token, given
        alone, comes out whole: then two neighbours that make up a token can only be the pair that its merge names.
        """
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in conf.get("added_tokens", ())}
        vocabulary = {t: i for t, i in conf["model"]["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in conf["model"]["merges"]]
        made = ["".join(m) for m in merges]
        ids = [vocabulary.get(t, -1) for t in made]
        whole = self.tokenizer.model.tokenize
        if (
            any(set(t) - byte.keys() for t in vocabulary) or sorted([*made, *byte]) != sorted(vocabulary) or ids != sorted(set(ids))
            or max(vocabulary[c] for c in byte) > ids[0] or any([x.id for x in whole(t)] != [i] for t, i in vocabulary.items())
        ):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("ranks", pat_str=self.PIECE, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if self.split is None:
            return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.kept) > CACHE:
            self.kept.clear()
        kept, out = self.kept, []
        for text in texts:
            pieces = self.split(text)
            try:
                out.append(b"".join(map(kept.__getitem__, pieces)))
            except KeyError:
                new = list(set(pieces).difference(kept))
                if self.merge:
                    for piece in new:
                        kept[piece] = array(self.code, self.merge(piece.encode())).tobytes()
                else:
                    for piece, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                        kept[piece] = np.array(e.ids, self.type).tobytes()
                out.append(b"".join(map(kept.__getitem__, pieces)))
        return out


def encoder_of(path: str) -> Encoder:
    """One encoder for each file in a worker process, which serves task after task."""
    kept = sys.__dict__.setdefault("_tripleloom_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def tokenise(docs: DataFrame, path: str, *, id_col: str, text_col: str, end_id: int, window: int) -> DataFrame:
    """id, block, full and rem (windows and remainder), full_rank and rem_rank (inside the block), ids (little-endian unsigned 32-bit or 16-bit), width."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(path)
        part, block, in_block = TaskContext.get().partitionId(), 0, BLOCK
        ranks = full_rank = None
        end = np.array([end_id], encoder.type).tobytes()
        width = len(end)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [x + end for x in encoder.encode(some.column("text").to_pylist())]
                cols = [[] for _ in range(5)]
                for x in ids:
                    if in_block == BLOCK:
                        block, in_block, ranks, full_rank = block + 1, 0, {}, 0
                    in_block += 1
                    full, rem = divmod(len(x) // width, window)
                    rank = ranks.get(rem, 0)
                    ranks[rem] = rank + 1
                    for c, v in zip(cols, ((part << 24) + block, full, rem, full_rank, rank), strict=True):
                        c.append(v)
                    full_rank += full
                yield pa.record_batch(
                    [some.column("id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())],
                    names=["id", "block", "full", "rem", "full_rank", "rem_rank", "ids", "width"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, block long, full long, rem long, full_rank long, rem_rank long, ids binary, width int")


def solve_counts(histogram: np.ndarray, combos: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that make the combinations' lengths fit the histogram: min |A x - h|^2 by accelerated projected gradients."""
    size, scale = len(histogram), max(1.0, float(histogram.max(initial=0)))
    h = histogram / scale
    flat = combos.ravel()
    used = flat > 0
    apply = lambda x: np.bincount(flat[used], np.repeat(x, combos.shape[1])[used], size)
    back = lambda r: np.where(combos > 0, r[combos], 0.0).sum(1)
    v = np.ones(len(combos))
    for _ in range(12):
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 0.95 / np.linalg.norm(back(apply(v)))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(apply(y) - h))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


class Plan(NamedTuple):
    """For each length: upper ends of its ranks by slot, and each slot's first rank, first sequence and offset. Then the residual stream."""

    ends: list[np.ndarray]
    first: list[np.ndarray]
    sequence: list[np.ndarray]
    offset: list[np.ndarray]
    planned: np.ndarray
    stream_at: np.ndarray
    n_planned: int
    window: int


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """histogram: how many remainders have each length, from 0 to window - 1."""
    histogram = histogram.astype(np.int64)
    histogram[0] = 0
    combos = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    combos += [(a, b, window - a - b) for a in range(1, window // 3 + 1) for b in range(a, (window - a) // 2 + 1)]
    combos = np.array(combos, np.int64).reshape(-1, 3)
    combos = combos[((histogram[combos] > 0) | (combos == 0)).all(1)]
    left, slots, n = histogram.copy(), [[] for _ in range(window)], 0
    if len(combos):
        wanted = solve_counts(histogram.astype(float), combos)
        by = np.argsort(-wanted, kind="stable")
        for again in (False, True):  # the second time whatever still fits
            for k in by:
                lengths, many = np.unique(combos[k][combos[k] > 0], return_counts=True)
                count = int((left[lengths] // many).min())
                count = count if again else min(count, int(wanted[k]))
                if count <= 0:
                    continue
                left[lengths] -= many * count
                at = 0
                for r in combos[k][combos[k] > 0]:
                    slots[r].append((count, n, at))
                    at += int(r)
                n += count
    ends = [np.cumsum([s[0] for s in x], dtype=np.int64) if x else np.zeros(0, np.int64) for x in slots]
    pick = lambda j: [np.array([s[j] for s in x], np.int64) for x in slots]
    counts = pick(0)
    lengths = np.arange(window)
    order = np.argsort(-lengths, kind="stable")  # longest first
    words = (left * lengths)[order]
    stream_at = np.zeros(window, np.int64)
    stream_at[order] = np.cumsum(words) - words
    return Plan(ends, [e - c for e, c in zip(ends, counts, strict=True)], pick(1), pick(2), histogram - left, stream_at, n, window)


def place(plan: Plan, rem: int, rank: int) -> list[tuple[int, int, int]]:
    """(length, sequence, offset) of a remainder's pieces in order; one, or more where the residual stream is cut."""
    if rem == 0:
        return []
    if rank < plan.planned[rem]:
        i = int(np.searchsorted(plan.ends[rem], rank, "right"))
        return [(rem, int(plan.sequence[rem][i] + rank - plan.first[rem][i]), int(plan.offset[rem][i]))]
    at, out = int(plan.stream_at[rem] + (rank - plan.planned[rem]) * rem), []
    while rem:
        n = min(rem, plan.window - at % plan.window)
        out.append((n, plan.n_planned + at // plan.window, at % plan.window))
        rem, at = rem - n, at + n
    return out


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, window: int = WINDOW
) -> DataFrame:
    """One row per piece: id, start, length, ids (array<int>), ids_crc32, doc_tokens, sequence_id, offset."""
    stored = materialise(tokenise(docs, tokenizer or default_tokenizer(), id_col=id_col, text_col=text_col, end_id=end_id, window=window), "pack-tokens")
    per_block = materialise(stored.groupBy("block", "rem").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "pack-blocks")
    histogram, n_full = np.zeros(window, np.int64), 0
    for r in per_block.groupBy("rem").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():  # at most `window` rows
        histogram[r["rem"]] += r["n"]
        n_full += r["full"]
    plan = make_plan(histogram, window)

    # blocks are numbered inside the tasks that made them: sums inside each task, then over the tasks
    part = F.shiftright("block", 24)
    full = per_block.groupBy("block").agg(F.sum("full").alias("n")).select(F.lit(-1).cast("long").alias("rem"), "block", "n")
    counts = materialise(per_block.select("rem", "block", "n").unionByName(full).withColumn("part", part), "pack-counts")  # rem -1: full windows
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    tasks = counts.groupBy("rem", "part").agg(F.sum("n").alias("n")).select(F.col("rem").alias("tr"), F.col("part").alias("tp"), before(Window.partitionBy("rem").orderBy("part")).alias("task_base"))
    bases = counts.withColumn("in_task", before(Window.partitionBy("rem", "part").orderBy("block")))
    bases = bases.join(tasks, (F.col("rem") == F.col("tr")) & (F.col("part") == F.col("tp"))).select("rem", "block", (F.col("task_base") + F.col("in_task")).alias("base"))
    fulls = bases.where("rem = -1").select(F.col("block").alias("f"), F.col("base").alias("full_base"))
    bases = bases.where("rem >= 0").join(fulls, F.col("block") == F.col("f")).select(F.col("block").alias("b"), F.col("rem").alias("r"), "base", "full_base")
    bases = materialise(bases, "pack-bases")
    # the table grows with the input: the same plan at every size
    rows = stored.join(bases.hint("merge"), (F.col("block") == F.col("b")) & (F.col("rem") == F.col("r")))
    kind = stored.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                take, cols = [], [[] for _ in range(7)]
                c = {n: some.column(n) for n in some.schema.names}
                num = {n: c[n].to_numpy(zero_copy_only=False) for n in ("full", "rem", "full_rank", "rem_rank", "width", "base", "full_base")}
                for i in range(some.num_rows):
                    full, rem = int(num["full"][i]), int(num["rem"][i])
                    raw = np.frombuffer(c["ids"][i].as_buffer(), np.uint16 if num["width"][i] == 2 else np.uint32).astype("<u4")
                    first = int(num["full_base"][i]) + int(num["full_rank"][i])
                    pieces = [(window, first + k, 0) for k in range(full)]
                    pieces += [(n, n_full + seq, off) for n, seq, off in place(plan, rem, int(num["base"][i]) + int(num["rem_rank"][i]))]
                    start = 0
                    for n, seq, off in pieces:
                        ids = raw[start : start + n]
                        take.append(i)
                        for col, v in zip(cols, (start, n, ids.view(np.int32), zlib.crc32(ids.tobytes()), len(raw), seq, off), strict=True):
                            col.append(v)
                        start += n
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch(
                    [c["id"].take(pa.array(take, pa.int64())), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))],
                    names=["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    out = rows.drop("b", "r").mapInArrow(run, f"id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
