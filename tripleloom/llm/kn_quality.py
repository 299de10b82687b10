"""Operator 3, quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text.

All trusted documents (labelled good) fit the models and set the thresholds. They are dealt by hash into two halves, and each half
fits a model. A trusted document is judged by the model of the other half, which has not seen it, every other document by
both, with the mean of the log perplexities. Each language's threshold is a quantile of its trusted documents, or of those of
all languages where it has too few. Documents that are not trusted never set a threshold.

No n-gram is stored. Every place of a text, a word with the two before it, goes to the shard of its middle word, where all meets
that counts in one context or one continuation count: a shard counts the trusted places of both halves and judges all of its places
under both models, and only sums by text leave it. Shards are taken in rounds over the texts, so the disk holds a round's places at a time.
Before that the trusted places alone go through the same shards for the continuation counts of words, which all shards share: those of
frequent words sit in a fixed-size table in every task, the others go to the shards that need them. Places of a word too common for
one shard are dealt over all by the pair of the first and the middle word, its pairs' counts added up between. Rounds, shards and tables
do not change the result. Places of one pair of words meet in one task.

Defined cases: a null text is empty (perplexity of the end token alone); documents of fewer than `min_tokens` are kept,
since their perplexity says little. A null language is a language of its own. Repeated rows, tied and null ids get a row
each; a null id is never trusted. Other columns are ignored. Without trusted text every document has perplexity 1 and stays;
with trusted text in one half only its model judges all documents, none is held out and every document stays. Empty in, empty out.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, sweep
from .hashing import Hasher, Words, slices
from .ngram_join import BROADCAST_IDS

BOS, EOS = np.uint64(0x1111111111111111), np.uint64(0x2222222222222222)
#: A discount stays this far from 0 and from the count it is taken from, so that logarithms exist.
LEAST_LEFT = 1e-3
#: Slots of the table of frequent words (24 bytes each).
TABLE_BITS = 18  # at most 23
#: Places in a shard, about, and of one word from where on its places are dealt over all shards; places that a task holds before it sends them.
SHARD, HELD = 1_000_000, 1_000_000
#: Shards of a round at least, so that all cores have some.
LEAST_SHARDS = 16
#: A word that comes so often in a slice of the texts, of each so many slices one, is told to the driver, which finds those to deal over all shards.
OFTEN, EACH = 16, 4
#: Words of text in a round, and most rounds.
ROUND_WORDS, MOST_ROUNDS = 2_000_000, 6


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b >> np.uint64(31)) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27)) ^ b) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def padded(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text with two begins before and an end behind, and where each text starts."""
    n = words.lengths()
    at = np.concatenate([[0], np.cumsum(n + 3)])
    w = np.full(at[-1], BOS)
    w[at[1:] - 1] = EOS
    w[np.arange(len(words.hashes)) + np.repeat(3 * np.arange(len(n)) + 2, n)] = words.hashes
    return w, at


def _discounts(n: dict[int, int]) -> list[float]:
    """The modified discounts of counts of 1, 2 and more, from the counts of counts: at most 1, 2 and 3, and above 0 so that every context leaves mass."""
    n1, n2, n3, n4 = (n.get(i, 0) or 0 for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(k - LEAST_LEFT, max(LEAST_LEFT, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _ones(condition):
    return F.sum(F.when(condition, 1).otherwise(0))


#: Rows that travel to a shard. Kind 0: places, with the keys and halves of their texts, the text of each, and its three words;
#: 1: places of rare words; 2: the continuation counts of a word; 3: those of a pair behind a hot word; 4: places of such pairs.
SENT = "part int, kind int, keys binary, halves binary, at binary, u binary, v binary, w binary, key long, y0 long, y1 long"


def home(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, growing with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


class Members:
    """A set of hashes; most that are not in it cost one look at a small table."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes >> np.uint64(48)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in h of members, and the members' places among the hashes."""
        some = np.flatnonzero(self.maybe[h >> np.uint64(48)]) if len(self.hashes) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[some]
        return some[hit], at[hit]


class Table:
    """Frequent words and their continuation counts under both models, one word a slot."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.keys, self.counts = len(keys).bit_length() - 1, keys, counts

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> Table:
        out = cls(np.zeros(1 << bits, np.uint64), np.zeros((2, 1 << bits), np.int64))
        out.keys[out.slot(keys)], out.counts[:, out.slot(keys)] = keys, counts
        return out

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        return self.keys[self.slot(h)] == h

    def pack(self, h: np.ndarray) -> bytes:
        """Three bytes a word, the slot, and the hashes of those that are not in it."""
        slot = self.slot(h)
        out = self.keys[slot] != h
        slot[out] = 0xFF0000
        return (slot & 0xFFFF).astype(np.uint16).tobytes() + (slot >> 16).astype(np.uint8).tobytes() + h[out].tobytes()

    def unpack(self, raw: bytes, n: int) -> np.ndarray:
        high = np.frombuffer(raw, np.uint8, n, 2 * n)
        out = high == 0xFF
        h = self.keys[np.where(out, 0, np.frombuffer(raw, np.uint16, n) | high.astype(np.int64) << 16)]
        h[out] = np.frombuffer(raw, np.uint64, -1, 3 * n)
        return h


def _index(texts: int) -> type:
    """Of places among so many texts."""
    return np.uint16 if texts <= 1 << 16 else np.int32


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each value, the values in order, and each place's number among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    of = np.empty(len(x), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], of


def dealt(rows: DataFrame, shards: int, first: int, last: int, hot, table=None) -> DataFrame:
    """SENT rows: the places of rows(key, half, text) whose middle word's shard is from first up to last; with a table also those of words outside it, and of pairs behind hot words, that are at home there.

    Places of a hot middle word are dealt by the pair of the first and the middle word, so that it isn't one shard's.
    """

    def send(held: list[tuple], kind: int, known: Table | None) -> Iterator[pa.RecordBatch]:
        sizes = [len(x[0]) for x in held]
        keys, halves = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        part, at, *words = (np.concatenate([x[i] for x in held]) for i in range(2, len(held[0])))
        at = at + np.repeat(np.cumsum(sizes) - sizes, [len(x[3]) for x in held])
        half = np.uint64(32)
        # like next to like, which compresses
        order = np.argsort(words[0] if kind == 1 else (words[-2] >> half << half) | (words[-1] >> half))
        order = order[np.argsort(part[order], kind="stable")]
        part, at, words = part[order], at[order], [x[order] for x in words]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
            there = np.zeros(len(keys), bool)
            there[at[a:b]] = True
            place = (np.cumsum(there) - 1).astype(_index(there.sum()))[at[a:b]]
            packed = known.pack if known and kind != 1 else np.ndarray.tobytes
            cols = [keys[there].tobytes(), halves[there].tobytes(), place.tobytes(), *(packed(x[a:b]) for x in words)]
            cols = [*cols[:3], *[None] * (3 - len(words)), *cols[3:]]
            none = pa.array([None], pa.int64())
            yield pa.record_batch(
                [pa.array([int(part[a])], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in cols), none, none, none],
                names=["part", "kind", "keys", "halves", "at", "u", "v", "w", "key", "y0", "y1"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known, held = Hasher(), Table(*table.value) if table else None, {0: [], 1: [], 4: []}
        often = Members(hot.value)
        # the upper halves of the hashes at home in these shards
        low, top = -(-(first << 32) // shards), -(-(last << 32) // shards) - 1
        for batch in batches:
            for some in slices(batch):
                w, at = padded(hasher.column(some.column("text")))
                keys = some.column("key").to_numpy().view(np.uint64)
                halves = some.column("half").fill_null(2).to_numpy().astype(np.int8)
                high = (w >> np.uint64(32)).astype(np.uint32)
                mid = np.flatnonzero((high >= low) & (high <= top))
                text = np.searchsorted(at, mid, "right") - 1
                inside = mid - at[text]
                if known is not None:
                    here = np.flatnonzero(inside > 1)
                    here = here[~known.holds(w[mid[here]])]
                    rare = w[mid[here]]
                    held[1].append((keys, halves, home(rare, shards) - np.int32(first), text[here], rare))
                here = (inside > 0) & (mid + 1 < at[text + 1])
                if len(often.hashes):
                    here[often.find(w[mid])[0]] = False
                mid, text = mid[here], text[here]
                part = home(w[mid], shards)
                if len(often.hashes):
                    hot_mid = often.find(w)[0]
                    hot_text = np.searchsorted(at, hot_mid, "right") - 1
                    inside = hot_mid > at[hot_text]
                    hot_mid, hot_text = hot_mid[inside], hot_text[inside]
                    two, pair = (home(_mix(w[hot_mid + i - 1], w[hot_mid + i]), shards) for i in (0, 1))
                    here = np.flatnonzero((two >= first) & (two < last))
                    mid, text, part = (np.concatenate([x, y[here]]) for x, y in ((mid, hot_mid), (text, hot_text), (part, two)))
                    if known is not None:
                        here = np.flatnonzero((pair >= first) & (pair < last))
                        held[4].append((keys, halves, pair[here] - np.int32(first), hot_text[here], w[hot_mid[here]], w[hot_mid[here] + 1]))
                held[0].append((keys, halves, part - np.int32(first), text, w[mid - 1], w[mid], w[mid + 1]))
                for kind, what in held.items():
                    if sum(len(x[3]) for x in what) >= HELD:
                        yield from send(what, kind, known)
                        what.clear()
        for kind, what in held.items():
            if sum(len(x[3]) for x in what):
                yield from send(what, kind, known)

    return rows.select("key", "half", "text").mapInArrow(run, SENT)


class Shard:
    """What came to a shard: places (u, v, w of a text), rare words' places and counts by key."""

    def __init__(self, batches: Iterator[pa.RecordBatch], table: Table | None = None) -> None:
        answers, keys, halves, n_keys = [], [], [], 0
        at, words = {0: [], 1: [], 4: []}, {0: ([], [], []), 1: ([],), 4: ([], [])}
        for batch in batches:
            sent = batch.column("keys").is_valid()
            answers.append(batch.filter(pa.compute.invert(sent)).select(["kind", "key", "y0", "y1"]))
            for i in np.flatnonzero(sent.to_numpy(zero_copy_only=False)).tolist():
                raw = {c: x.as_buffer() for c in ("keys", "halves", "at", "u", "v", "w") if (x := batch.column(c)[i]).is_valid}
                kind = batch.column("kind")[i].as_py()
                keys.append(np.frombuffer(raw["keys"], np.uint64))
                halves.append(np.frombuffer(raw["halves"], np.int8))
                place = np.frombuffer(raw["at"], _index(len(keys[-1])))
                at[kind].append(place.astype(np.int32) + np.int32(n_keys))
                n_keys += len(keys[-1])
                for x, c in zip(words[kind], "uvw"[-len(words[kind]) :], strict=True):
                    x.append(table.unpack(raw[c], len(place)) if table and kind != 1 else np.frombuffer(raw[c], np.uint64))
        joined = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        self.keys, self.halves = joined(keys, np.uint64), joined(halves, np.int8)
        self.at, self.rare_at, self.pair_at = (joined(at[kind], np.int32) for kind in (0, 1, 4))
        (self.u, self.v, self.w), (self.rare,), (self.pair_v, self.pair_w) = ([joined(x, np.uint64) for x in words[kind]] for kind in (0, 1, 4))
        self.counts = {}
        for kind in (2, 3):
            some = [x.filter(pa.compute.equal(x.column("kind"), kind)) for x in answers]
            key, y0, y1 = (np.concatenate([np.zeros(0, np.int64), *(x.column(c).to_numpy() for x in some)]) for c in ("key", "y0", "y1"))
            key, one = np.unique(key.view(np.uint64), return_index=True)
            self.counts[kind] = Members(key), np.stack([y0[one], y1[one]])

    def counts_of(self, kind: int, h: np.ndarray) -> np.ndarray:
        """The counts under both models, 0 without any."""
        members, counts = self.counts[kind]
        out = np.zeros((2, len(h)), np.int64)
        here, there = members.find(h)
        out[:, here] = counts[:, there]
        return out


def _per(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The sums of x by of, in n places; whole numbers up to 2**53."""
    return np.bincount(of, x, n).astype(np.int64)


def local_counts(sent: DataFrame, parts: int, first: int, hot) -> DataFrame:
    """What a shard's trusted places add: (shard, kind, key, v, w, x0, x1).

    Kind 0: a word and the pairs it ends, without those of hot words; 1: a pair behind a hot word and its triples; 2: by key 1 to 4
    triples of that count, by key 11 to 14 pairs with key - 10 triples, without those of hot words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, shard = Shard(batches), first + TaskContext.get().partitionId()
        if not len(s.at):
            return
        two = _mix(s.u, s.v)
        at, of = distinct(_mix(two, s.w))
        half = s.halves[s.at]
        c = [_per(of, half == m, len(at)) for m in (0, 1)]
        pairs = _mix(s.v[at], s.w[at])
        back, of = distinct(pairs)
        pairs = pairs[back]
        a = [_per(of, x > 0, len(back)) for x in c]
        v, w = s.v[at][back], s.w[at][back]
        is_hot = np.zeros(len(v), bool)
        is_hot[Members(hot.value).find(v)[0]] = True
        at, of = distinct(w)
        words = w[at]
        b = [_per(of, (x > 0) & ~is_hot, len(words)) for x in a]

        def rows(kind: int, key: np.ndarray, v: np.ndarray, w: np.ndarray, x: list[np.ndarray]) -> pa.RecordBatch:
            n = len(key)
            longs = [pa.array(np.asarray(y).view(np.int64)) for y in (key, v, w, *x)]
            return pa.record_batch([pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, kind, np.int32)), *longs], names=["shard", "kind", "key", "v", "w", "x0", "x1"])

        none = lambda x: np.zeros(len(x), np.int64)
        yield rows(0, words, none(words), none(words), b)
        yield rows(1, pairs[is_hot], v[is_hot], w[is_hot], [x[is_hot] for x in a])
        keys = np.array([*range(1, 5), *range(11, 15)])
        yield rows(2, keys, none(keys), none(keys), [np.array([*((c[m] == k).sum() for k in range(1, 5)), *(((a[m] == k) & ~is_hot).sum() for k in range(1, 5))]) for m in (0, 1)])

    return sent.repartitionById(parts, "part").mapInArrow(run, "shard int, kind int, key long, v long, w long, x0 long, x1 long")


def _cut(x: np.ndarray, d: list[float]) -> np.ndarray:
    """The discounts of counts."""
    return np.array([0.0, *d])[np.minimum(x, 3)]


def _log(x: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.log(x, where=where, out=np.zeros(len(x)))


def log_weights(s: Shard, table: Table, hot: Members, m: int, fitted: dict, ids: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each place, rare word's place and place of a pair behind a hot word adds to a text's log probability beyond that of an unknown word."""
    pair_at, pair, two_at, two, live, three_at, three = ids
    d3, d2, d1 = fitted["discounts"][m]
    total, unknown = fitted["total"][m], fitted["unknown"][m]
    p1 = lambda b: (b - _cut(b, d1)) / total + unknown

    def second(v: np.ndarray, w: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probability of w after v, and what it adds; which v are hot."""
        at, of_word = distinct(v)
        words = v[at]
        total2 = _per(of_word, a, len(words))
        left2 = sum(d * np.bincount(of_word, (a == k) if k < 3 else (a > 2), len(words)) for k, d in enumerate(d2, 1))
        here, there = hot.find(words)
        total2[here] = fitted["hot"][m, there, 0]
        left2[here] = sum(d * fitted["hot"][m, there, k] for k, d in enumerate(d2, 1))
        is_hot = np.zeros(len(words), bool)
        is_hot[here] = True
        total2, left2 = total2[of_word], (left2 / np.maximum(total2, 1))[of_word]
        # a context that the model does not have leaves all to the word
        left2 = np.where(total2 > 0, left2, 1.0)
        known = table.holds(w)
        b = np.where(known, table.counts[m, table.slot(w)], 0)
        b[~known] = s.counts_of(2, w[~known])[m]
        one = p1(b)
        p2 = (a - _cut(a, d2)) / np.maximum(total2, 1) + left2 * one
        return p2, np.where(known, np.log(one / unknown), 0.0) + np.log(left2) + _log(p2 / one / left2, a > 0), is_hot[of_word]

    # triples and their contexts
    c = _per(three, s.halves[s.at[live]] == m, len(three_at))
    of_two, of_pair = two[live][three_at], pair[live][three_at]
    total3 = _per(of_two, c, len(two_at))
    left3 = sum(d * np.bincount(of_two, (c == k) if k < 3 else (c > 2), len(two_at)) for k, d in enumerate(d3, 1)) / np.maximum(total3, 1)
    # pairs: here are all triples of one but behind a hot word
    v, w = s.v[pair_at], s.w[pair_at]
    a = _per(of_pair, c > 0, len(pair_at))
    here = hot.find(v)[0]
    a[here] = s.counts_of(3, _mix(v[here], w[here]))[m]
    p2, by_pair, is_hot = second(v, w, a)
    p3 = (c - _cut(c, d3)) / np.maximum(total3, 1)[of_two] + left3[of_two] * p2[of_pair]
    by_three = _log(p3 / np.where(c > 0, p2[of_pair] * left3[of_two], 1), c > 0)
    out = np.where(is_hot, 0.0, by_pair)[pair] + _log(left3, total3 > 0)[two]
    out[live] += by_three[three]
    spread = second(s.pair_v, s.pair_w, s.counts_of(3, _mix(s.pair_v, s.pair_w))[m])[1]
    return out, np.log(p1(s.counts_of(2, s.rare)[m]) / unknown), spread


def shard_sums(sent: DataFrame, parts: int, table, hot, fitted: dict) -> DataFrame:
    """(key, s0, s1): what the places of a round add to the log probability of the texts of each key, under both models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = Table(*table.value), Members(hot.value)
        s = Shard(batches, known)
        if not len(s.keys):
            return
        two_hash = _mix(s.u, s.v)
        pair_at, pair = distinct(_mix(s.v, s.w))
        two_at, two = distinct(two_hash)
        trusted = s.halves[s.at] < 2
        live = np.flatnonzero((np.bincount(pair, trusted, len(pair_at)) > 0)[pair] & (np.bincount(two, trusted, len(two_at)) > 0)[two])
        three_at, three = distinct(_mix(two_hash[live], s.w[live]))
        ids, sums = (pair_at, pair, two_at, two, live, three_at, three), []
        for m in (0, 1):
            if fitted["total"][m]:
                more = log_weights(s, known, often, m, fitted, ids)
                sums.append(sum(np.bincount(at, x, len(s.keys)) for at, x in zip((s.at, s.rare_at, s.pair_at), more, strict=True)))
            else:
                sums.append(np.zeros(len(s.keys)))
        order = np.argsort(s.keys)
        keys, sums = s.keys[order], [x[order] for x in sums]
        to = home(keys, parts)
        cuts = np.searchsorted(to, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cuts))
        blobs = [[x[cuts[i] : cuts[i + 1]].tobytes() for i in some] for x in (keys, *(x.astype(np.float32) for x in sums))]
        yield pa.record_batch([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "keys", "s0", "s1"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.to_pylist()]
        if blobs:
            keys, of = np.unique(np.concatenate([np.frombuffer(b["keys"], np.uint64) for b in blobs]), return_inverse=True)
            sums = [np.bincount(of, np.concatenate([np.frombuffer(b[c], np.float32) for b in blobs])) for c in ("s0", "s1")]
            yield pa.record_batch([pa.array(keys.view(np.int64)), *(pa.array(x) for x in sums)], names=["key", "s0", "s1"])

    out = sent.repartitionById(parts, "part").mapInArrow(run, "part int, keys binary, s0 binary, s1 binary")
    return out.repartitionById(parts, "part").mapInArrow(total, "key long, s0 double, s1 double")


def beyond(rows: DataFrame, table) -> DataFrame:
    """The rows whose key is not in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Table(*table.value)
        for batch in batches:
            yield batch.filter(pa.array(~known.holds(batch.column("key").to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def end_round(spark: SparkSession) -> None:
    """Lets the round's shuffle files go before the next writes its own; Spark holds the last job's plan for a moment longer."""
    for _ in range(2):
        time.sleep(1)
        sweep(spark)


def read_texts(rows: DataFrame) -> DataFrame:
    """rows with n_tokens instead of the text, and `often`: the words of many places in a slice of the texts, with their number."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), 0
        for batch in batches:
            for some in slices(batch):
                words = hasher.column(some.column("text"))
                many = []
                if seen % EACH == 0:  # where a word is dealt does not change what it counts
                    found, n = np.unique(words.hashes, return_counts=True)
                    many = list(zip(found[n >= OFTEN].view(np.int64).tolist(), (EACH * n[n >= OFTEN]).tolist(), strict=True))
                often = [[*many, (int(BOS), some.num_rows)], *[[]] * (some.num_rows - 1)]
                seen += 1
                yield pa.record_batch(
                    [*(some.column(c) for c in others), pa.array(words.lengths() + 1), pa.array(often, pa.map_(pa.int64(), pa.int64()))], names=[*others, "n_tokens", "often"]
                )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return materialise(rows.mapInArrow(run, f"{kinds}, n_tokens long, often map<bigint, bigint>"), "kn-rows")


def count(rows: DataFrame, shards: int, rounds: int, hot) -> tuple:
    """The models' discounts, totals and probabilities of an unknown word; the broadcast table of frequent words; counts (shard, kind, key, y0, y1) that shards need beyond it."""
    spark = rows.sparkSession
    parts = []
    for i in range(rounds):
        first, last = (shards * x // rounds for x in (i, i + 1))
        parts.append(materialise(local_counts(dealt(rows.where("half is not null"), shards, first, last, hot), last - first, first, hot), "kn-counts"))
        end_round(spark)
    local = reduce(DataFrame.unionByName, parts)
    both = [F.sum("x0").alias("y0"), F.sum("x1").alias("y1")]
    pairs = materialise(local.where("kind = 1").groupBy("key", "v", "w").agg(*both), "kn-pairs")
    ends = pairs.select(F.col("w").alias("key"), *[(F.col(f"y{m}") > 0).cast("long").alias(f"x{m}") for m in (0, 1)])
    words = materialise(local.where("kind = 0").select("key", "x0", "x1").unionByName(ends).groupBy("key").agg(*both), "kn-words")

    models = (0, 1)
    n = {(r["key"], m): r[f"y{m}"] for r in local.where("kind = 2").groupBy("key").agg(*both).collect() for m in models}
    of = lambda k: [_ones(F.col(f"y{m}") == k).alias(f"n{k}{m}") for m in models]
    four = [x for k in range(1, 5) for x in of(k)]
    second, third = pairs.agg(*four).first(), words.agg(*four, *[F.sum(f"y{m}").alias(f"total{m}") for m in models], *[_ones(F.col(f"y{m}") > 0).alias(f"types{m}") for m in models]).first()
    fitted = {"discounts": [], "total": [third[f"total{m}"] or 0 for m in models], "unknown": []}
    for m in models:
        d3 = _discounts({k: n.get((k, m), 0) for k in range(1, 5)})
        d2 = _discounts({k: n.get((10 + k, m), 0) + (second[f"n{k}{m}"] or 0) for k in range(1, 5)})
        d1 = _discounts({k: third[f"n{k}{m}"] for k in range(1, 5)})
        fitted["discounts"].append((d3, d2, d1))
        types, total = third[f"types{m}"] or 0, fitted["total"][m]
        ones, twos = (third[f"n{k}{m}"] or 0 for k in (1, 2))
        fitted["unknown"].append((ones * d1[0] + twos * d1[1] + (types - ones - twos) * d1[2]) / total / (types + 1) if total else 1.0)

    sizes = [F.sum(f"y{m}").alias(f"k0{m}") for m in models] + [_ones(F.col(f"y{m}") == k if k < 3 else F.col(f"y{m}") > 2).alias(f"k{k}{m}") for k in (1, 2, 3) for m in models]
    fitted["hot"] = np.zeros((2, len(hot.value), 4))
    for r in pairs.groupBy("v").agg(*sizes).collect():  # a row for each hot word
        there = int(np.searchsorted(hot.value, np.uint64(r["v"] & (2**64 - 1))))
        for m in models:
            fitted["hot"][m, there] = [r[f"k{k}{m}"] for k in range(4)]

    slot = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    best = words.groupBy(slot.alias("slot")).agg(F.max(F.struct((F.col("y0") + F.col("y1")).alias("n"), "key", "y0", "y1")).alias("x")).select("x.key", "x.y0", "x.y1").toArrow()  # at most 2**TABLE_BITS rows
    key, y0, y1 = (best.column(c).to_numpy() for c in ("key", "y0", "y1"))
    table = Table.of(key.view(np.uint64), np.stack([y0, y1]), TABLE_BITS)
    table = spark.sparkContext.broadcast((table.keys, table.counts))
    rare = materialise(beyond(words, table), "kn-rare")
    of_shard = lambda kind: local.where(F.col("kind") == kind).select("shard", F.col("key").alias("k"))
    answers = beyond(of_shard(0).withColumnRenamed("k", "key"), table).withColumnRenamed("key", "k").join(rare, F.col("k") == F.col("key"))
    at_home = F.shiftright(F.shiftrightunsigned("key", 32) * shards, 32).cast("int").alias("shard")
    each = lambda kind: (F.lit(kind).alias("kind"), "key", "y0", "y1")
    answers = answers.select("shard", *each(2)).unionByName(rare.select(at_home, *each(2)))
    answers = answers.unionByName(of_shard(1).join(pairs, F.col("k") == F.col("key")).select("shard", *each(3))).unionByName(pairs.select(at_home, *each(3)))
    ends = pairs.select(at_home, F.col("w").alias("k")).join(rare, F.col("k") == F.col("key")).select("shard", *each(2))
    answers = materialise(answers.unionByName(ends).sortWithinPartitions("shard"), "kn-answers")
    discard(*parts, pairs, words, rare)
    return fitted, table, answers


def log_perplexities(rows: DataFrame) -> DataFrame:
    """rows(half, text, ...) with n_tokens, log_perplexity0 and log_perplexity1 instead of the text: under the model of the texts of each half. Without any that model gives 0."""
    spark = rows.sparkSession
    rows = rows.withColumn("key", F.xxhash64("text"))
    others = [c for c in rows.columns if c not in ("text", "key")]
    read = read_texts(rows)
    total, trusted = read.agg(F.sum("n_tokens"), F.sum(F.when(F.col("half").isNotNull(), F.col("n_tokens")))).first()
    total, trusted = total or 0, trusted or 0
    rounds = int(min(MOST_ROUNDS, 1 + total // ROUND_WORDS))
    shards = max(rounds * LEAST_SHARDS, -(-total // SHARD))
    often = read.select(F.explode("often").alias("w", "n")).groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["w"] for r in often.collect()], np.int64).view(np.uint64)))
    sums, fitted = [], {"total": [0, 0], "unknown": [1.0, 1.0]}
    if trusted:
        fitted, table, answers = count(rows, shards, max(1, round(rounds * trusted / total)), hot)
        for i in range(rounds):
            first, last = (shards * x // rounds for x in (i, i + 1))
            theirs = answers.where((F.col("shard") >= first) & (F.col("shard") < last)).select((F.col("shard") - first).alias("part"), "kind", "key", "y0", "y1")
            sent = dealt(rows, shards, first, last, hot, table).unionByName(theirs, allowMissingColumns=True)
            sums.append(materialise(shard_sums(sent, last - first, table, hot, fitted), "kn-sums"))
            end_round(spark)
        table.unpersist()
        discard(answers)
    hot.unpersist()
    out = read
    if sums:
        # texts alike have added up
        alike = read.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("alike"))
        both = reduce(DataFrame.unionByName, sums).groupBy("key").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
        both = both.join(alike, F.col("key") == F.col("k")).select("k", *[(F.col(f"s{m}") / F.col("alike")).alias(f"s{m}") for m in (0, 1)])
        out = read.join(both, F.col("key") == F.col("k"))
    each = [(-(F.col(f"s{m}") / F.col("n_tokens") + math.log(fitted["unknown"][m])) if fitted["total"][m] else F.lit(0.0)).alias(f"log_perplexity{m}") for m in (0, 1)]
    out = materialise(out.select(*others, "n_tokens", *each), "kn-perplexity")
    discard(read, *sums)
    return out


def perplexities(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows(id, text, ...) with n_tokens and log_perplexity under the model of texts(text), without text."""
    others = [c for c in rows.columns if c != "text"]
    both = rows.select(F.struct(*others).alias("row"), F.lit(None).cast("int").alias("half"), "text").unionByName(texts.select(F.lit(0).alias("half"), "text"), allowMissingColumns=True)
    return log_perplexities(both).where("half is null").select("row.*", "n_tokens", F.col("log_perplexity0").alias("log_perplexity"))


def classify_quality(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = 0.995,
    min_held: int = 30,
    min_tokens: int = 20,
) -> DataFrame:
    """One row per document: id, lang, n_tokens, perplexity, threshold, kept.

    trusted: ids of good documents. Each fits the model of its half by hash and is judged by the other's. A language's threshold on
    the log perplexity is the quantile of its trusted documents; with fewer than min_held of them, that of those of all languages.
    """
    ids = trusted.select(F.col(id_col).alias("t")).where("t is not null").distinct()
    ids = ids.withColumn("half", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(ids, F.col("id") == F.col("t"), "left").select("id", "lang", "half", "text")
    halves = sorted(r[0] for r in rows.where("half is not null").select("half").distinct().collect())  # at most two
    judged = log_perplexities(rows)
    by = [F.col(f"log_perplexity{h}") for h in halves]
    if len(halves) == 2:
        mean, held = F.when(F.col("half") == 0, by[1]).when(F.col("half") == 1, by[0]).otherwise((by[0] + by[1]) / 2), F.col("half").isNotNull()
    else:
        mean, held = by[0] if by else F.lit(0.0), F.lit(False)
    scored = materialise(judged.select("id", "lang", "n_tokens", mean.alias("log_perplexity"), held.alias("held")), "kn-scores")
    discard(judged)
    judged = scored.where(F.col("n_tokens") >= min_tokens)

    held, of = judged.where("held"), F.percentile_approx("log_perplexity", quantile, 10_000)
    pool = held.agg(of).first()[0]
    own = held.groupBy(F.col("lang").alias("o")).agg(of.alias("own"), F.count("*").alias("n"))
    each = judged.select(F.col("lang").alias("l")).distinct().join(own, F.col("l").eqNullSafe(F.col("o")), "left")
    each = materialise(each.select("l", F.when(F.col("n") >= min_held, F.col("own")).otherwise(F.lit(pool).cast("double")).alias("threshold")), "kn-thresholds")  # a row for each language
    n_lang = each.count()
    out = scored.join(F.broadcast(each) if n_lang <= BROADCAST_IDS else each, F.col("lang").eqNullSafe(F.col("l")), "left")
    kept = (F.col("n_tokens") < min_tokens) | F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_tokens", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), kept.alias("kept"))
