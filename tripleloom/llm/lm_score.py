"""Operator 1, LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Word counts of all training documents are exact, summed by shuffle. The most frequent words are output units of their
own, all others fall into units by their last bytes and share a unit's probability by count. Units grow with the square root
of the training tokens and are dealt to as many classes as a class has units. The context vector of a token is the sum of
the preceding tokens' vectors, each weighted by position; a class is scored against it, then a unit inside its class.
Scoring normalises over the classes and over the class's units with batched matrix products.

Training sees every training token once, in ROUNDS rounds. Documents fall into rounds and shards by hash; in a round each
shard runs the contrastive updates over its documents from common parameters, and the shards' parameters are averaged by
tokens. A shard has about SHARD tokens in a round, so their number grows with the corpus, and a small corpus is one
shard. Rows, not partitions, decide what happens: the result doesn't depend on how the input is split.

Counts of the most frequent words (at most 2**20) go to every task as hashes and counts, 16 MB at most; other words' counts
are joined by shuffle, so every count is exact. Words meet that table, and their units, by 64-bit hash.

Defined cases: a null text is empty (its end token remains). A null id counts as the empty string for the split. Repeated
rows and tied ids give a row each. A text of more than PIECE tokens is trained on in pieces. Other columns are ignored. No
training document: every count is 0 and the model is the uniform one over one unknown type. Empty in, empty out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .hashing import LOWER, Hasher, Words, slices

#: Least output units that are words of their own, and groups of the other words: together a square, the number of classes.
UNITS, GROUPS = 2048, 256
#: Rounds of training, tokens of a shard in a round, or so many for each unit if that is more, tokens of a piece, parts of the parameters' sums.
ROUNDS, SHARD, SHARD_UNITS, PIECE, PARTS = 8, 1 << 19, 128, 1 << 16, 32
#: Vector length, context tokens, shared noise samples, tokens in a step, learning rate.
DIM, CONTEXT, NOISE, STEP, RATE = 16, 4, 16, 2048, 0.15
#: Most frequent words in every task's table, slots of the table, words counted before they are passed on.
HEAD_BITS, SLOT_BITS, PARTIAL_WORDS = 20, 22, 200_000
#: Tokens scored at once, rows in a matrix product.
BLOCK, ROWS = 8192, 256
#: The end token, which no word can be, and its hash.
END, END_HASH = b"\n", 1


class Vocabulary(NamedTuple):
    hashes: np.ndarray  # of the most frequent words, sorted
    counts: np.ndarray
    groups: np.ndarray
    unit_hashes: np.ndarray  # of the words that are units, sorted
    units: np.ndarray  # their units
    n_unit: np.ndarray  # training tokens of each unit, the groups last
    types: np.ndarray  # distinct training words of each unit
    total: int
    distinct: int


def n_units(total: int) -> int:
    """Words that are units: a fourth of the square root of the training tokens, so that with the groups they fill a square."""
    side = math.isqrt(max(UNITS, math.isqrt(total) // 4) + GROUPS - 1) + 1
    return side * side - GROUPS


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary), c: exact counts over the texts, each followed by one end; the word's hash h and group g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(counter.keys(), pa.binary()), pa.array(counter.values(), pa.int64())], names=["word", "c"])
            counter.clear()
            return made

        for batch in batches:
            for text in batch.column("text"):
                counter.update(split_words(text.as_py()))
                counter[END] += 1
                if len(counter) > PARTIAL_WORDS:
                    yield out()
        yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for some in slices(batch, "word", 1 << 14):
                ws = some.column("word").to_pylist()
                found, h = hasher.words(ws), np.full(len(ws), END_HASH, np.int64)
                h[found.lengths() > 0] = found.hashes.view(np.int64)
                yield pa.record_batch([*some.columns, pa.array(h), pa.array((zlib.crc32(w[-2:]) % GROUPS for w in ws), pa.int32())], names=["word", "c", "h", "g"])

    counts = texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return counts.mapInArrow(hashed, "word binary, c long, h long, g int")


def read_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The bounded part of the counts, and the least count of its words."""
    bin_ = F.floor(F.log2("c") * 16).cast("int")
    bins = {r["b"]: (r["n"], r["c"]) for r in counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}  # at most 1024 rows
    total, distinct = sum(x[1] for x in bins.values()), sum(x[0] for x in bins.values())
    least, room = 1024, 1 << HEAD_BITS
    for b in sorted(bins, reverse=True):
        if bins[b][0] > room:
            break
        least, room = b, room - bins[b][0]

    table = counts.where(bin_ >= least).select("h", "c", "g").toArrow()
    h, c, g = (table.column(x).to_numpy() for x in ("h", "c", "g"))
    order = np.argsort(h)
    head = h[order], c[order], g[order]
    own = n_units(total)
    top = counts.select("h", "c", "g").orderBy(F.desc("c"), "h").limit(own).toArrow()
    n_unit, types = np.zeros(own + GROUPS), np.zeros(own + GROUPS)
    groups = counts.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()  # at most GROUPS rows
    g = own + groups.column("g").to_numpy()
    n_unit[g], types[g] = groups.column("c").to_numpy(), groups.column("n").to_numpy()
    top_h, top_c, top_g = (top.column(x).to_numpy() for x in ("h", "c", "g"))
    n_unit[: len(top_c)], types[: len(top_c)] = top_c, 1
    np.subtract.at(n_unit, own + top_g, top_c)
    np.subtract.at(types, own + top_g, 1)
    units = np.argsort(top_h)
    return Vocabulary(*head, top_h[units], units, n_unit, types, total, distinct), least


class Model:
    """Parameters: word vectors R, position weights D, class and unit vectors and biases. Unit u stands at slot `slot[u]`, class slot // size."""

    def __init__(self, n_unit: np.ndarray, state: np.ndarray | None = None, seed: tuple[int, ...] = ()) -> None:
        self.size = size = math.isqrt(len(n_unit))  # classes, and units of a class
        self.narrow = np.uint16 if len(n_unit) <= 1 << 16 else np.int64  # sorts faster
        order = np.argsort(-n_unit, kind="stable")
        self.slot = np.empty(len(n_unit), np.int64)
        self.slot[order] = np.arange(len(n_unit))
        mass = (n_unit[order] + 1).reshape(size, size)
        self.p_class = mass.sum(1) / mass.sum()
        self.p_unit = mass / mass.sum(1, keepdims=True)
        self.cum_unit = (np.cumsum(self.p_unit, 1) + np.arange(size)[:, None]).ravel()  # class g's from g to g + 1
        self.shift_class, self.shift_unit = (np.log(NOISE * x).astype(np.float32) for x in (self.p_class, self.p_unit))
        rng = np.random.default_rng(11)
        f = np.float32
        self.params = {
            "R": rng.normal(0, 0.1, (len(n_unit), DIM)).astype(f), "D": np.repeat(f(1.0) / (1 + np.arange(CONTEXT, dtype=f)), DIM).reshape(CONTEXT, DIM),
            "C": np.zeros((size, DIM), f), "c": np.log(self.p_class).astype(f), "U": np.zeros((size, size, DIM), f), "u": np.log(self.p_unit).astype(f),
        }
        self.params["C"] += rng.normal(0, 0.05, self.params["C"].shape).astype(f)
        self.params["U"] += rng.normal(0, 0.05, self.params["U"].shape).astype(f)
        self.seen = {k: np.full(v.shape, 1e-2, f) for k, v in self.params.items()}
        if state is not None:
            at = 0
            for part in (self.params, self.seen):
                for k, v in part.items():
                    part[k] = state[at : at + v.size].reshape(v.shape).astype(f)
                    at += v.size
        self.rng = np.random.default_rng((11, *seed))
        # large temporaries stay: fresh pages would cost more than the arithmetic
        self.grads, self.work = ({k: np.zeros_like(v) for k, v in self.params.items() if k != "R"} for _ in range(2))
        self.noise, self.away = (np.empty((STEP, n), f) for n in (NOISE, DIM))
        self.scores = np.empty((BLOCK, size), f)

    def state(self) -> np.ndarray:
        """All that training changes, in one row."""
        return np.concatenate([v.ravel() for part in (self.params, self.seen) for v in part.values()])

    def contexts(self, slots: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Context vectors of the tokens, their vectors, and for each distance which tokens have none so far back in their text (start: place in the text)."""
        e = self.params["R"].take(slots, 0)
        q = np.zeros_like(e)
        lacks = []
        for i in range(CONTEXT):
            lacks.append(np.flatnonzero(start[i + 1 :] <= i))
            part = e[: max(0, len(e) - i - 1)] * self.params["D"][i]
            part[lacks[-1]] = 0
            q[i + 1 :] += part
        return q, e, lacks

    def log10(self, slots: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the units."""
        out = np.empty(len(slots), np.float32)
        for at in range(0, len(slots), BLOCK):
            some, before = slots[at : at + BLOCK], max(0, at - CONTEXT)
            q = self.contexts(slots[before : at + BLOCK], start[before : at + BLOCK])[0][at - before :]
            order = np.argsort(some.astype(self.narrow), kind="stable")
            by_class, (k, inside) = q.take(order, 0), np.divmod(some[order], self.size)
            each = np.arange(len(k))
            s = _times(by_class, self.params["C"].T, self.scores[: len(k)])
            s += self.params["c"]
            found = s[each, k]
            found -= _log_sum(s)
            s = self.scores[: len(k)]
            for g, rows in _classes(k, self.size):
                _times(by_class[rows], self.params["U"][g].T, s[rows])
                s[rows] += self.params["u"][g]
            found += s[each, inside]
            out[at + order] = found - _log_sum(s)
        return out.astype(np.float64) / np.log(10)

    def step(self, slots: np.ndarray, start: np.ndarray) -> None:
        """One contrastive update on consecutive tokens."""
        p = self.params
        q_of, e, lacks = self.contexts(slots, start)
        # sorted by unit the tokens are sorted by class too, and sums by either are sums of runs
        order = np.argsort(slots.astype(self.narrow), kind="stable")
        sorted_, q = slots[order], q_of.take(order, 0)
        k, n_classes = sorted_ // self.size, self.size
        first, first_k = _runs(sorted_), _runs(k)
        seen, seen_k = sorted_[first], k[first_k]
        grads, noise, away = self.grads, self.noise[: len(q)], self.away[: len(q)]
        for g in grads.values():
            g.fill(0)

        drawn = np.minimum((self.rng.random(NOISE)[:, None] >= np.cumsum(self.p_class)).sum(1), n_classes - 1)
        dq, grads["C"][seen_k], grads["c"][seen_k] = _pull(q, p["C"].take(k, 0), (p["c"] - self.shift_class)[k], first_k)
        v = p["C"][drawn]
        fake = _fake(_times(q, v.T, noise), (p["c"] - self.shift_class)[drawn])
        dq += _times(fake, v, away)
        np.add.at(grads["C"], drawn, sum(fake[i : i + ROWS].T @ q[i : i + ROWS] for i in range(0, len(q), ROWS)))
        np.add.at(grads["c"], drawn, fake.sum(0))

        unit, to_unit = p["U"].reshape(-1, DIM), grads["U"].reshape(-1, DIM)
        shifted, to_bias = (p["u"] - self.shift_unit).ravel(), grads["u"].ravel()
        back, to_unit[seen], to_bias[seen] = _pull(q, unit.take(sorted_, 0), shifted[sorted_], first)
        dq += back
        of_class = np.arange(n_classes)[:, None]
        drawn = np.searchsorted(self.cum_unit, (self.rng.random((n_classes, NOISE)) + of_class).ravel(), side="right").reshape(n_classes, NOISE)
        drawn = np.clip(drawn, n_classes * of_class, n_classes * (of_class + 1) - 1)
        v, classes = unit.take(drawn, 0), _classes(k, n_classes)
        turned = np.ascontiguousarray(v.transpose(0, 2, 1))
        for g, rows in classes:
            np.dot(q[rows], turned[g], out=noise[rows])
        fake = _fake(noise, shifted[drawn].take(k, 0))
        of_v, of_b = np.zeros((n_classes, NOISE, DIM), np.float32), np.zeros((n_classes, NOISE), np.float32)
        for g, rows in classes:
            some = fake[rows]
            np.dot(some, v[g], out=away[rows])
            np.dot(some.T, q[rows], out=of_v[g])
        of_b[seen_k] = np.add.reduceat(fake, first_k)
        dq += away
        by_unit = np.argsort(drawn.ravel().astype(self.narrow), kind="stable")
        drawn = drawn.ravel()[by_unit]
        runs = _runs(drawn)
        to_unit[drawn[runs]] += np.add.reduceat(of_v.reshape(-1, DIM).take(by_unit, 0), runs)
        to_bias[drawn[runs]] += np.add.reduceat(of_b.ravel()[by_unit], runs)

        dq_of, de = np.empty_like(dq), np.zeros_like(e)
        dq_of[order] = dq
        for i, none in enumerate(lacks):
            back, before = dq_of[i + 1 :].copy(), max(0, len(e) - i - 1)
            back[none] = 0
            grads["D"][i] = np.einsum("ij,ij->j", back, e[:before])
            de[:before] += back * p["D"][i]
        scale = 1 / max(1.0, len(slots) / 64)
        # a word vector without a gradient stays as it is
        g, rows = np.add.reduceat(de.take(order, 0), first) * np.float32(scale), self.seen["R"]
        rows[seen] += g * g
        p["R"][seen] += RATE * g / np.sqrt(rows[seen])
        for n, g in grads.items():
            g *= scale
            w = np.multiply(g, g, out=self.work[n])
            self.seen[n] += w
            np.sqrt(self.seen[n], out=w)
            np.divide(g, w, out=w)
            w *= RATE
            p[n] += w


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def _classes(k: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """The classes in sorted k and their rows."""
    edges = np.searchsorted(k, np.arange(n + 1)).tolist()
    return [(g, slice(edges[g], edges[g + 1])) for g in range(n) if edges[g] < edges[g + 1]]


def _times(q: np.ndarray, m: np.ndarray, out: np.ndarray) -> np.ndarray:
    """q @ m in blocks of rows too small for the linear algebra library to start threads, which cost tasks side by side more than they give."""
    for i in range(0, len(q), ROWS):
        np.matmul(q[i : i + ROWS], m, out=out[i : i + ROWS])
    return out


def _log_sum(s: np.ndarray) -> np.ndarray:
    """By row; s is used up."""
    top = s.max(initial=0)
    if top < 60:  # no overflow: one pass less
        return np.log(np.exp(s, out=s).sum(1))
    top = s.max(1)
    s -= top[:, None]
    return np.log(np.exp(s, out=s).sum(1)) + top


def _pull(q, v, shifted, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contrastive objective's part of the true rows (v: each token's): gradients for q, and for the vectors and biases of each run."""
    true = 1 / (1 + np.exp(np.minimum(np.maximum(np.einsum("ij,ij->i", q, v) + shifted, -30), 30)))
    return true[:, None] * v, np.add.reduceat(true[:, None] * q, first), np.add.reduceat(true, first)


def _fake(s: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """The part of the noise rows, which the tokens share, by their scores; s is used up."""
    s += shifted
    np.maximum(np.minimum(s, 30, out=s), -30, out=s)
    np.exp(np.negative(s, out=s), out=s)
    s += 1
    return np.divide(-1, s, out=s)


def _find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each h in sorted known, -1 without one."""
    at = np.searchsorted(known, h)
    return np.where(known[np.minimum(at, len(known) - 1)] == h, at, -1) if len(known) else np.full(len(h), -1)


class Tokens(NamedTuple):
    """The tokens of texts one after another, each text's end behind its words."""

    words: Words
    text: np.ndarray
    start: np.ndarray  # place in the text
    place: np.ndarray  # among the most frequent words, -1: not there
    slots: np.ndarray
    at: np.ndarray  # each text's first token, and the number of tokens

    def word(self, t: int) -> bytes:
        i = self.words.first[self.text[t]] + self.start[t]
        return END if i == self.words.first[self.text[t] + 1] else self.words.raw[self.words.starts[i] : self.words.ends[i]]


class Reader:
    """Texts as tokens. A table by the hash's first bits finds nearly all frequent words at once."""

    def __init__(self, v: Vocabulary, slot: np.ndarray) -> None:
        self.v, self.slot, self.hasher, n = v, slot, Hasher(), len(slot)
        self.table = np.zeros(1 << SLOT_BITS, np.int32)
        self.table[self._first_bits(v.hashes)] = np.arange(len(v.hashes))
        self.slot_of = self._slots(v.hashes, n - GROUPS + v.groups)
        two = [zlib.crc32(bytes(x)) % GROUPS for x in np.ndindex(256, 256)]
        self.group = n - GROUPS + np.array([*two, *(zlib.crc32(bytes([x])) % GROUPS for x in range(256))])

    def _first_bits(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _slots(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        unit = _find(self.v.unit_hashes, h)
        return self.slot[np.where(unit < 0, group, self.v.units[unit])] if len(self.v.units) else self.slot[group]

    def read(self, texts: pa.Array) -> Tokens:
        words, known = self.hasher.column(texts), self.v.hashes
        n = words.lengths() + 1
        at = np.concatenate([[0], np.cumsum(n)])
        text = np.repeat(np.arange(len(n)), n)
        h = np.full(at[-1], END_HASH, np.int64)
        inside = np.arange(len(words.hashes)) + np.repeat(np.arange(len(n)), n - 1)
        h[inside] = words.hashes.view(np.int64)
        place = self.table[self._first_bits(h)] if len(known) else np.zeros(len(h), np.int32)
        other = np.flatnonzero(known[place] != h) if len(known) else np.arange(len(h))
        place[other] = _find(known, h[other])
        slots = self.slot_of[place] if len(known) else np.zeros(len(h), np.int64)
        rare = np.flatnonzero(place < 0)
        if len(rare):
            raw, suffix = np.frombuffer(words.raw, np.uint8).astype(np.int64), np.full(len(h), (1 << 16) + END[0])
            last = words.ends - 1
            suffix[inside] = np.where(words.starts == last, (1 << 16) + raw[last], raw[last - 1] * 256 + raw[last])
            slots[rare] = self._slots(h[rare], self.group[suffix[rare]])
        return Tokens(words, text, np.arange(len(h)) - at[text], place, slots, at)


def train(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """The trained state of the model of texts(h: what tells rows apart, text)."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(tuple(v))  # at most 2**HEAD_BITS hashes and counts, and the units
    n_slots = len(v.n_unit)
    n_shards = max(1, round(v.total / (ROUNDS * max(SHARD, SHARD_UNITS * n_slots))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shared.value)
        model = Model(v.n_unit)
        reader = Reader(v, model.slot)
        for batch in batches:
            for some in slices(batch):
                tokens, made = reader.read(some.column("text")), []
                slots, at = tokens.slots.astype(model.narrow), tokens.at.tolist()
                for h, first, end in zip(some.column("h").to_pylist(), at, at[1:], strict=False):
                    made += [(h, i - first, slots[i : min(end, i + PIECE)].tobytes()) for i in range(first, end, PIECE)]
                yield pa.record_batch([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())], names=["h", "piece", "slots"])

    tokens = texts.mapInArrow(run, "h long, piece long, slots binary")
    tokens = tokens.withColumn("round", F.pmod("h", F.lit(ROUNDS)).cast("int")).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(n_shards)).cast("int"))
    # sorted, so that a round reads its pages alone
    tokens = materialise(tokens.sortWithinPartitions("round"), "lm-tokens")
    names, kinds = ["part", "shard", "sum", "n"], "part int, shard int, sum binary, n long"

    def learner(i: int, common):
        def learn(rows: pa.Table) -> pa.Table:
            v = Vocabulary(*shared.value)
            shard = rows.column("shard")[0].as_py()
            model = Model(v.n_unit, common.value, (i, shard))
            rows = rows.sort_by([("h", "ascending"), ("piece", "ascending")])
            texts = [np.frombuffer(x.as_buffer(), model.narrow).astype(np.int64) for x in rows.column("slots")]
            slots, start = np.concatenate(texts), np.concatenate([np.arange(len(t)) for t in texts])
            for at in range(0, len(slots), STEP):
                model.step(slots[at : at + STEP], start[at : at + STEP])
            parts = [p.tobytes() for p in np.array_split(model.state().astype(np.float64) * len(slots), PARTS)]
            return pa.table([pa.array(range(PARTS), pa.int32()), pa.array([shard] * PARTS, pa.int32()), pa.array(parts, pa.binary()), pa.array([len(slots)] * PARTS, pa.int64())], names=names)

        return learn

    def total(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        out = sum(np.frombuffer(x.as_buffer(), np.float64) for x in rows.column("sum"))
        return pa.table([rows.column("part").slice(0, 1), rows.column("shard").slice(0, 1), pa.array([out.tobytes()], pa.binary()), pa.array([sum(rows.column("n").to_pylist())], pa.int64())], names=names)

    state = Model(v.n_unit).state()
    for i in range(ROUNDS):
        common = spark.sparkContext.broadcast(state)  # of the model's own size
        sums = tokens.where(F.col("round") == i).select("shard", "h", "piece", "slots").groupBy("shard").applyInArrow(learner(i, common), kinds)
        # sums of 32 groups first, so that no task reads the parameters of all shards
        sums = sums.groupBy("part", F.expr("shard % 32")).applyInArrow(total, kinds).groupBy("part").applyInArrow(total, kinds)
        found = sorted(sums.collect(), key=lambda r: r["part"])  # PARTS rows, together of the model's own size
        if found:  # else no document fell into the round
            state = (np.concatenate([np.frombuffer(r["sum"], np.float64) for r in found]) / found[0]["n"]).astype(np.float32)
        common.unpersist()
    discard(tokens)
    return state


def score_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.pmod(key, F.lit(folds)) == held_fold).alias("held_out"))
    texts = rows.where("not held_out").select(F.xxhash64(F.col("id").cast("string"), "text").alias("h"), "text")
    counts = materialise(count_words(texts.select("text")), "lm-counts")
    v, least = read_vocabulary(counts)
    state = train(texts, v) if v.total else None
    shared, weights = spark.sparkContext.broadcast(tuple(v)), spark.sparkContext.broadcast(state)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = Vocabulary(*shared.value)
        model, n_slots = Model(v.n_unit, weights.value), len(v.n_unit)
        reader, row = Reader(v, model.slot), TaskContext.get().partitionId() << 40
        # a unit's words share its probability by (c + 1) / (n + types + 1), the last for unknown ones; a single word has it all
        n_slot, t_slot, single = np.empty(n_slots), np.empty(n_slots), np.zeros(n_slots, bool)
        n_slot[model.slot], t_slot[model.slot] = v.n_unit, v.types
        single[model.slot[: len(v.units)]] = True
        inner = np.log10(n_slot + t_slot + 1)
        own = np.log10(n_slot + 1)  # of a single word beyond the table, whose count the join adds
        log_c = np.log10(np.concatenate([[0], v.counts]) + 1)
        base = np.log10(v.total + v.distinct + 1)
        for batch in batches:
            for some in slices(batch):
                t = reader.read(some.column("text"))
                n = some.num_rows
                lc = log_c[t.place + 1]
                alone = single[t.slots]
                sum_of = lambda x, t=t, n=n: np.bincount(t.text, x, n)
                base_score = sum_of(lc - base)
                if weights.value is None:
                    score = base_score
                else:
                    score = sum_of(model.log10(t.slots, t.start) + np.where(alone, np.where(t.place >= 0, 0, -own[t.slots]), lc - inner[t.slots]))
                known = sum_of(t.place >= 0).astype(np.int64)
                tails: list[Counter] = [Counter() for _ in range(n)]
                for i in np.flatnonzero(t.place < 0).tolist():
                    tails[t.text[i]][t.word(i)] += 1
                kinds = pa.map_(pa.binary(), pa.int64())
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + n)), some.column("id"), some.column("held_out"), pa.array(np.diff(t.at)),
                     pa.array(known), pa.array(base_score), pa.array(score), pa.array([list(x.items()) for x in tails], kinds)],
                    names=["row", "id", "held_out", "n_tokens", "known", "base", "model", "tail"],
                )
                row += n

    schema = f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, model double, tail map<binary, bigint>"
    scored = materialise(rows.mapInArrow(run, schema), "lm-scored")
    rest = counts.where(F.floor(F.log2("c") * 16).cast("int") < least).select(F.col("word").alias("k"), "c")
    tail = scored.select("row", F.explode("tail").alias("word", "n")).join(rest, F.col("word") == F.col("k"))
    # both scores lack log10(c + 1) of these words, which alone of their unit's words have none
    tail = tail.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more")).withColumnRenamed("row", "r")
    out = scored.join(tail, F.col("row") == F.col("r"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
