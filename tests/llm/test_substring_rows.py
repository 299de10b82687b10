import random
from collections import Counter

import pytest

from tripleloom.llm.substring_dedup import substring_dedup

SHARED = "this passage has certainly more than forty words " + " ".join(f"n{i}" for i in range(40)) + " as one sees."


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n))


@pytest.mark.parametrize("id_", [None, 7])
def test_rows_of_one_id_keep_their_own_text(spark, id_):
    """Spans of one row are not cut from others that share its id or also have none."""
    lead = [*(prose(i, 15) for i in range(5)), prose(5, 45)]
    texts = [f"{lead[0]}. {SHARED}", f"{SHARED} {lead[1]}.", f"{lead[2]}.", f"{lead[3]}. {SHARED} {lead[4]}.", lead[5], lead[5]]
    out = substring_dedup(spark.createDataFrame([(id_, t) for t in texts], "doc_id long, text string").repartition(3)).collect()
    left = Counter(w for r in out for w in r.text.split())
    # every text of its own stays, and one copy of what repeats
    assert left == Counter(w for t in [*lead, SHARED] for w in (t + "." if t in lead[:5] else t).split())
    assert sorted(r.n_chars for r in out) == sorted(map(len, texts)) and sum(r.n_removed for r in out) == 3
