"""Operator 6, n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its hashed word shingles in one global order, frequent ones last (frequency class from a
fixed-size count table over the whole corpus, then the hash). Two sets that are similar enough share at least l of
their first n - need(n) + l shingles, for every l. Each document gets the l that its estimated candidates make
cheapest: a longer prefix, but more shared prefix shingles asked for before verification; a pair must share at least
the smaller l of the two.

1. Equal sets fold into one node, the smallest id.
2. Prefix shingles meet by hash within bands of set sizes; two or more make a family named after its smallest node. A
   node stays only if enough of its prefix shingles are met by others, and leaves families that no pair needs.
3. A family splits by hash into chunks of bounded size, and every two of its chunks meet in a task of their own. There
   shared prefix shingles are counted as bit sets, pairs with enough of them are verified on whole sets, and what comes
   out is each node's number of links and the links of a spanning forest.
4. Components of those links, by stars.

No pair of a family is skipped, so no link is lost, and none is emitted for each pair. A pair with several families
counts in the smallest of them. A family of k chunks is read k times over, which exact numbers of links ask for.

Defined cases: a null text is empty; a text without words has no shingles and is linked with nothing. Rows that share an
id, or have none, are documents of their own; a component is named after its smallest id, null if it has none. Ids of any
type that has an order serve. Other columns are ignored. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import connected_components
from .hashing import Hasher, Words, runs, slices

#: Bits of the corpus count table: 2**22 counters, four megabytes as frequency classes, whatever the corpus.
TABLE_BITS = 22
#: Shingles and nodes in a chunk of a family, columns of the bit sets that are held at once.
CHUNK, NODES, TILE = 400_000, 2048, 1 << 15
#: Up to so many candidate ids (8 bytes each) a broadcast selects their texts; beyond it a shuffle join does.
BROADCAST_IDS = 1_000_000
#: Costs of one more prefix shingle and of one more candidate; an n-th of a set's shingles is added to its prefix.
POST_COST, VERIFY_COST = 1.0, 8.0
SHARES = (50, 20, 10, 5)


def sets_of(words: Words, width: int) -> list[np.ndarray]:
    """The sorted set of hashed shingles of each text."""
    all_, out = runs(words.hashes, width), []
    for at, n in zip(words.first.tolist(), words.lengths().tolist(), strict=False):
        some = all_[at : at + n - width + 1] if n >= width else runs(words.hashes[at : at + n], n) if n else all_[:0]
        out.append(np.unique(some))
    return out


def need(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set similar enough."""
    return -(-n * percent // 100)


def in_order(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A sorted set in the global order."""
    return s[np.argsort(classes[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)], kind="stable")]


def rivals(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How many other documents are estimated to have each shingle."""
    return np.exp2(classes[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(float)) - 1


def choose(s: np.ndarray, classes: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, length of the prefix) of an ordered set: the cheapest of a few l by its shingles' estimated frequencies."""
    n = len(s)
    base = n - need(n, percent)
    upto = np.cumsum(rivals(s[: base + 1 + n // min(SHARES)], classes))
    best = None
    for share in SHARES:
        many = 1 + n // share
        length = min(n, base + many)
        cost = POST_COST * length + VERIFY_COST * upto[length - 1] / many
        if best is None or cost < best[0]:
            best = (cost, length - base, length)
    return best[1], best[2]


def count_classes(texts: DataFrame, width: int) -> np.ndarray:
    """The frequency class of each counter: 0 for what chance gives it, else the doublings of what it has beyond the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, held, n_held = Hasher(), np.zeros(1 << TABLE_BITS, np.int32), [], 0

        def add() -> None:
            np.add(table, np.bincount(np.concatenate(held), minlength=1 << TABLE_BITS), out=table, casting="unsafe")

        for batch in batches:
            for some in slices(batch):
                words = hasher.column(some.column("text"))
                inside = np.repeat(words.first[1:], words.lengths())  # the end of each word's text
                all_ = runs(words.hashes, width)
                all_ = all_[np.arange(len(all_)) + width <= inside[: len(all_)]]
                held.append((all_ >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
                n_held += len(all_)
                if n_held > 1 << 21:
                    add()
                    held, n_held = [], 0
        if n_held:
            add()
        if table.any():
            parts = table.astype(np.uint32).reshape(64, -1)
            yield pa.record_batch([pa.array(range(64), pa.int32()), pa.array([_packed(p) for p in parts], pa.binary())], names=["part", "counts"])

    def total(rows: pa.Table) -> pa.Table:
        out = np.zeros((1 << TABLE_BITS) // 64, np.int64)
        for x in rows.column("counts").to_pylist():
            out += _unpacked(x)
        return pa.table([pa.array([rows.column("part")[0].as_py()], pa.int32()), pa.array([_packed(np.minimum(out, 2**32 - 1).astype("u4"))], pa.binary())], names=["part", "counts"])

    parts = texts.mapInArrow(run, "part int, counts binary")
    # a first round of sums in 16 groups a part, so that no task reads every task's table
    parts = parts.withColumn("group", F.spark_partition_id() % 16).groupBy("part", "group").applyInArrow(total, "part int, counts binary")
    parts = parts.groupBy("part").applyInArrow(total, "part int, counts binary")
    table = np.zeros((64, (1 << TABLE_BITS) // 64), np.float64)
    for r in parts.collect():  # 64 rows, 16 MB
        table[r["part"]] = _unpacked(r["counts"])
    mean = table.mean()
    beyond = np.maximum(table.ravel() - mean, 1)
    return np.where(table.ravel() > mean + 3 * mean**0.5 + 1, np.floor(np.log2(beyond)) + 1, 0).clip(0, 40).astype(np.uint8)


def _packed(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs, which the last byte tells."""
    width = 1 if counts.max(initial=0) < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return counts.astype(f"<u{width}").tobytes() + bytes([width])


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[-1]}", offset=0, count=(len(raw) - 1) // raw[-1])


def _tiles(rows: np.ndarray, columns: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The incidence (rows, columns) as bit sets of n rows, TILE columns at a time."""
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for first in range(0, int(columns[-1]) + 1 if len(columns) else 0, TILE):
        a, b = np.searchsorted(columns, [first, first + TILE])
        if a == b:
            continue
        bits = np.zeros((n, (int(columns[b - 1]) - first) // 64 + 1), np.uint64)
        c = columns[a:b] - first
        np.bitwise_or.at(bits, (rows[a:b], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        yield bits


class Block:
    """The links between the nodes `left` and `right` of a family; all pairs of one list if both are the same."""

    def __init__(self, sets: list[np.ndarray], ls: np.ndarray, lengths: np.ndarray, percent: int, left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right, self.same = left, right, left is right
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
        rows = np.repeat(np.arange(len(sets)), sizes)
        often = np.bincount(where, minlength=len(tokens)) > 1
        kept = often[where]
        place = np.arange(len(where)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        in_prefix = (place < lengths[rows])[kept]
        rows, columns = rows[kept], (np.cumsum(often) - 1)[where[kept]]

        shared = np.zeros((len(left), len(right)), np.uint32)
        for bits in _tiles(rows[in_prefix], columns[in_prefix], len(sets)):
            others = bits[right]
            for i, x in enumerate(left):
                at = i + 1 if self.same else 0
                shared[i, at:] += np.bitwise_count(others[at:] & bits[x]).sum(1, dtype=np.uint32)
        self.found: list[np.ndarray] = []  # for each left node the places of right ones
        for i, x in enumerate(left):
            small, large = np.minimum(sizes[right], sizes[x]), np.maximum(sizes[right], sizes[x])
            self.found.append(np.flatnonzero((shared[i] >= np.minimum(ls[right], ls[x])) & (small * 100 >= large * percent)))
        both = [np.zeros(len(f), np.int64) for f in self.found]
        for bits in _tiles(rows, columns, len(sets)):
            for i, f in enumerate(self.found):
                if len(f):
                    both[i] += np.bitwise_count(bits[right[f]] & bits[left[i]]).sum(1, dtype=np.int64)
        for i, (f, n) in enumerate(zip(self.found, both, strict=True)):
            self.found[i] = f[n * 100 >= (sizes[right[f]] + sizes[left[i]] - n) * percent]

    def forest(self, n: int) -> list[tuple[int, int]]:
        """Links that span the components of n nodes."""
        label, out = np.arange(n), []
        for x, f in zip(self.left.tolist(), self.found, strict=True):
            others, first = np.unique(label[self.right[f]], return_index=True)
            for other, k in zip(others.tolist(), f[first].tolist(), strict=True):
                if other != label[x]:
                    out.append((x, int(self.right[k])))
                    label[label == other] = label[x]
        return out

    def degrees(self, weights: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
        """Each node's weight of links, without those of pairs that share an earlier family."""
        out = np.zeros(len(weights), np.int64)
        _, column = np.unique(np.concatenate(earlier), return_inverse=True)
        row = np.repeat(np.arange(len(earlier)), [len(e) for e in earlier])
        tiles = list(_tiles(row, column, len(earlier)))
        for x, f in zip(self.left.tolist(), self.found, strict=True):
            y = self.right[f]
            for bits in tiles:
                y = y[~(bits[y] & bits[x]).any(1)]
            out[x] += weights[y].sum()
            out[y] += weights[x]
        return out


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), n_links (other rows it is linked with)."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if texts.schema["id"].dataType.typeName() == "long" and texts.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        found = _components_of(texts, width, percent)
    else:  # rows get ids of their own, and components the smallest of their members' ids
        named = materialise(texts.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "join-rows")
        found = _components_of(named.select(F.col("row").alias("id"), "text"), width, percent).withColumnRenamed("id", "r")
        found = materialise(found.join(named.select("row", "id"), F.col("r") == F.col("row")).select("id", "n", F.col("component_id").alias("c"), "n_links"), "join-found")
        discard(named)
        names = materialise(found.groupBy("c").agg(F.min("id").alias("component_id")), "join-names").withColumnRenamed("c", "k")
        found = found.join(names, F.col("c") == F.col("k")).select("id", "n", "component_id", "n_links")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def _components_of(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """id, n, component_id, n_links; ids are unique and not null."""
    spark = texts.sparkSession
    classes = count_classes(texts.select("text"), width)
    table = spark.sparkContext.broadcast(classes)  # four megabytes

    def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ranks = Hasher(), table.value
        for batch in batches:
            for some in slices(batch):
                ns, keys, ls, prefixes = [], [], [], []
                for s in sets_of(hasher.column(some.column("text")), width):
                    many, length = 0, 0
                    if len(s):
                        o = in_order(s, ranks)
                        many, length = choose(o, ranks, percent)
                    ns.append(len(s))
                    keys.append(hashlib.md5(s.tobytes(), usedforsecurity=False).digest())
                    ls.append(many)
                    prefixes.append(o[:length] if length else s)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes).view(np.int64)))
                yield pa.record_batch(
                    [some.column("id"), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(ls, pa.int32()), lists],
                    names=["id", "n", "key", "l", "prefix"],
                )

    sets = materialise(texts.mapInArrow(prefix_rows, "id long, n long, key binary, l int, prefix array<bigint>"), "join-sets")
    linkable = sets.where("n > 0")
    folded = materialise(linkable.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("weight")), "join-nodes").withColumnRenamed("key", "k")
    members = linkable.select("id", "key", "n").join(folded, F.col("key") == F.col("k")).select("id", "n", "node", "weight")

    nodes = linkable.join(folded, (F.col("key") == F.col("k")) & (F.col("id") == F.col("node")))
    posts = nodes.select("node", "weight", "n", "l", F.explode("prefix").alias("token"))
    lists = materialise(posts.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select(F.col("token").alias("t")), "join-lists")
    shared = materialise(posts.join(lists, F.col("token") == F.col("t")).drop("t"), "join-shared")
    discard(lists)
    # sets of similar enough sizes lie in one size band or in neighbours: each posts to its own and the next
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.01 / percent))).cast("int")
    banded = shared.withColumn("band", F.explode(F.array(band, band + 1)))
    groups = banded.groupBy("token", "band").agg(F.count("*").alias("m"), F.min("l").alias("least"), F.min("node").alias("family")).where("m > 1")
    groups = materialise(groups.select(F.col("token").alias("t"), F.col("band").alias("b"), "least", "family"), "join-groups")
    hits = banded.join(groups, (F.col("token") == F.col("t")) & (F.col("band") == F.col("b"))).select("node", "weight", "n", "family", "token", "least")
    met = materialise(hits.groupBy("node", "weight", "n", "family").agg(F.countDistinct("token").alias("met"), F.min("least").alias("least")), "join-met")
    discard(shared, groups)
    # a node stays if the others meet enough of its shingles, and leaves its smallest families while both members of a
    # pair that shares enough must still meet in another: each may lose less than half of what they share
    per_node = Window.partitionBy("node")
    up = per_node.orderBy("met", "family").rowsBetween(Window.unboundedPreceding, 0)
    member = met.withColumn("all_least", F.min("least").over(per_node)).withColumn("all_met", F.sum("met").over(per_node)).withColumn("lost", F.sum("met").over(up))
    member = materialise(member.where("all_met >= all_least and lost > floor((all_least - 1) / 2)").select("node", "weight", "n", "family"), "join-members")
    discard(met)

    # sizes of the families give their chunks
    many = F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / NODES)).cast("int")
    family = member.groupBy("family").agg(F.count("*").alias("size"), many.alias("chunks")).where("size > 1").withColumnRenamed("family", "f")
    member = member.join(family.drop("size"), F.col("family") == F.col("f")).select("node", "weight", "family", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    earlier = F.collect_list("family").over(per_node.orderBy("family").rowsBetween(Window.unboundedPreceding, -1))
    member = materialise(member.withColumn("earlier", earlier), "join-chunks")

    ids = member.select(F.col("node").alias("i")).distinct()
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("i"), "left_semi")

    def ordered_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ranks = Hasher(), table.value
        for batch in batches:
            for some in slices(batch):
                made = [in_order(s, ranks) for s in sets_of(hasher.column(some.column("text")), width)]
                chosen = [choose(s, ranks, percent) for s in made]
                yield pa.record_batch(
                    [some.column("id"), *(pa.array([c[j] for c in chosen], pa.int32()) for j in (0, 1)), pa.array([s.tobytes() for s in made], pa.binary())],
                    names=["w", "l", "length", "shingles"],
                )

    wanted = materialise(wanted.mapInArrow(ordered_sets, "w long, l int, length int, shingles binary"), "join-wanted")
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(rows: pa.Table) -> pa.Table:
        if rows.num_rows < 2:
            return kinds.empty_table()
        ids, ls, lengths, weights, chunks = (rows.column(c).to_numpy() for c in ("node", "l", "length", "weight", "chunk"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
        left = np.flatnonzero(chunks == chunks.min())
        right = left if chunks.min() == chunks.max() else np.flatnonzero(chunks != chunks.min())
        if rows.column("one")[0].as_py() != rows.column("two")[0].as_py() and right is left:
            return kinds.empty_table()  # one of the two chunks is empty
        block = Block(sets, ls, lengths, percent, left, right)
        degrees = block.degrees(weights, [np.array(e, np.int64) for e in rows.column("earlier").to_pylist()])
        forest = np.array(block.forest(len(ids)), np.int64).reshape(-1, 2)
        some = np.flatnonzero(degrees)
        return pa.table([pa.array(np.concatenate(c)) for c in ((ids[forest[:, 0]], ids[some]), (ids[forest[:, 1]], ids[some]), (0 * forest[:, 0], degrees[some]))], schema=kinds)

    # every two chunks of a family meet, and each with itself
    met = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumn("one", F.least("chunk", "other")).withColumn("two", F.greatest("chunk", "other")).drop("chunks", "other")
    grouped = met.join(wanted, F.col("node") == F.col("w")).drop("w")
    links = materialise(grouped.groupBy("family", "one", "two").applyInArrow(compare, "a long, b long, links long"), "join-links")
    discard(member, wanted)

    labels = materialise(connected_components(links.where("a <> b").select("a", "b")), "join-components").withColumnRenamed("node", "v")
    degrees = links.where("a = b").groupBy(F.col("a").alias("d")).agg(F.sum("links").alias("links"))
    out = members.join(labels, F.col("node") == F.col("v"), "left").join(degrees, F.col("node") == F.col("d"), "left")
    linked = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    out = out.select("id", "n", F.coalesce("component", "node").alias("component_id"), linked)
    return out.unionByName(sets.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
