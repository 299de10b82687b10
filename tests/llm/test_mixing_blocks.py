from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleloom.llm.mixing import mix_sources, schedule, source_targets

SIZES = {"a": 300, "b": 700, "c": 1100, "d": 5200, "e": 1024, "f": 20 * 1024, "g": 7, "h": 400_000, "i": 1}


@pytest.mark.parametrize("block", [1, 1024])
def test_targets_are_met_at_any_block(spark, block):
    """Sources of less than a block up to 20 blocks, and one word, take their targets whatever the block."""
    rows = []
    for s, n in SIZES.items():
        each = max(1, n // 9)
        rows += [(len(rows) + i, s, " ".join(["w"] * min(each, n - at))) for i, at in enumerate(range(0, n, each))]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=block).collect()
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[r.source_size] - r.target) <= 1 for r in got)
    sizes = spark.createDataFrame([(s, n) for s, n in SIZES.items()], "source string, size long")
    targets = source_targets(sizes)
    plan = schedule(targets, len(SIZES), sum(SIZES.values()), block).groupBy("sid").agg(F.sum(F.col("end") - F.col("start")).alias("words")).join(targets, "sid").collect()
    assert len(plan) == len(SIZES) and all(abs(r.words - r.target) <= 1 for r in plan)
