"""What documents give, and where, comes from the schedule's slots."""

from collections import Counter

import corpus_pipeline as P
from tripleloom.llm import mixing
from tripleloom.llm.mixing import mix_sources

SIZES = {"a": 9_000, "b": 6_000, "c": 31_000, None: 2_500}


def rows():
    out = []
    for s, n in SIZES.items():
        while n > 0:
            k = min(n, 1 + len(out) * 37 % 190)
            out.append((len(out), s, " ".join([f"w{len(out)}"] * k)))
            n -= k
    return out


def table(spark):
    return spark.createDataFrame(rows(), "doc_id long, source string, text string").repartition(3)


def test_documents_give_what_the_slots_read(spark, monkeypatch):
    """Every document against a walk through the slots word by word; then with a part of the slots gone."""
    kept = []

    def some(*args, **kw):
        out = schedule(*args, **kw).where(keep)
        kept.append(sorted(out.collect(), key=lambda r: (r.slot, r.sid)))
        return out

    schedule = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", some)
    source, takens = {i: s for i, s, _ in rows()}, []
    for keep in ("true", "slot % 3 <> 1"):
        got = mix_sources(table(spark), block=64).collect()
        sids = {s: k for k, s in enumerate(SIZES)}
        line = {}
        for r in got:
            line.setdefault(sids[source[r.doc_id]], {}).update({r.position + j: (r.doc_id, j) for j in range(r["size"])})
        taken, places, at = Counter(), {}, 0
        for slot in kept[-1]:
            for x in range(slot.start, slot.end):
                doc, j = line[slot.sid][x % len(line[slot.sid])]
                taken[doc] += 1
                if j == 0:
                    places.setdefault(doc, []).append(at)
                at += 1
        assert {r.doc_id: r.taken for r in got} == {r.doc_id: taken[r.doc_id] for r in got}
        assert {r.doc_id: sorted(r.places) for r in got} == {r.doc_id: places.get(r.doc_id, []) for r in got}
        assert {r.mix_words for r in got} == {at}
        takens.append(sum(taken.values()))
    assert takens[1] < 0.8 * takens[0]


def test_pipeline_writes_the_mix_in_its_order(spark):
    """Any stretch of the mixed rows has the sources in their shares, and a rerun from other partitions gives the same rows in the same order."""
    first, again = (P.mix(spark, table(spark).repartition(n), "").collect() for n in (2, 7))
    assert [tuple(r) for r in first] == [tuple(r) for r in again]
    total = Counter()
    for r in first:
        total[r.source] += len(r.text.split())
    whole, so_far, at = sum(total.values()), Counter(), 0
    for r in first:
        n = len(r.text.split())
        so_far[r.source] += n
        at += n
        assert all(abs(so_far[s] - total[s] * at / whole) < 6_000 for s in total)
    assert so_far == total
