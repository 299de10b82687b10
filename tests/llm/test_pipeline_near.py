from collections import defaultdict

from corpus_pipeline import dedup_near

from test_free_ops import shingles


def test_near_copies_by_row(spark, edge):
    """Against brute force, with null and shared ids: each component keeps one row, the one of the smallest id."""
    base = [f"b{i}" for i in range(60)]
    near = lambda i: " ".join([*base[:i], "changed", *base[i + 1 :]])
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, near(0)), (9, near(59)), (9, "an unrelated text under an id that is taken"), (None, other), (None, other + " more"), (4, "other " + other.upper())]
    rows += [(5, " ".join(f"t{i}" for i in range(50))), (5, " ".join(f"t{i}" for i in range(51))), (None, " ".join(f"n{i}" for i in range(50))), (None, " ".join(f"n{i}" for i in range(51)))]
    small = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for docs in (small, edge):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        left = [tuple(r) for r in dedup_near(spark, docs, "").select("doc_id", "text").collect()]
        sets = [shingles(t, 5) for _, t in rows]
        of = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and both * 100 >= 80 * len(sets[i] | sets[j]):
                    of = [of[j] if x == of[i] else x for x in of]
        groups = defaultdict(list)
        for i, c in enumerate(of):
            groups[c].append(rows[i])
        assert len(left) == len(groups)
        for members in groups.values():
            least = min((d for d, _ in members if d is not None), default=None)
            kept = next(r for r in left if r in members)
            assert kept[0] == least
            left.remove(kept)
        assert not left
