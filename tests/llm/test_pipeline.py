"""Each stage of the pipeline against brute force, and all in a row."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from test_free_ops import LOW, WORD, shingles
from test_native_ops import brute_line, brute_rules, brute_targets


def texts(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def brute_clean(rows):
    out = Counter()
    for d, t, s in rows:
        n, *_, repeated = brute_rules(t)
        kept, removed = [], 0
        for x in (t or "").split("\n"):
            if WORD.search(x) and brute_line(x):
                removed += len(WORD.findall(x))
            else:
                kept.append(x)
        if n >= 20 and 100 * repeated <= 30 * n and 100 * removed <= 40 * n:
            out[d, "\n".join(kept), s] += 1
    return out


def near_groups(rows):
    """Sizes of the components of rows (id, text, source) and the smallest id of each, by all pairs that share a shingle."""
    sets, of, where = [shingles(t, 5) for _, t, _ in rows], list(range(len(rows))), defaultdict(list)

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    shared = Counter()
    for i, s in enumerate(sets):
        for x in s:
            for j in where[x]:
                shared[j, i] += 1
            where[x].append(i)
    for (i, j), n in shared.items():
        if n * 100 >= 80 * (len(sets[i]) + len(sets[j]) - n):
            of[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return groups


def check_dedup_exact(rows, left):
    want = {}
    for d, t, _ in rows:
        key = (t or "").translate(LOW)
        want[key] = min([x for x in (want.get(key), d) if x is not None], default=None)
    assert Counter((d, (t or "").translate(LOW)) for d, t, _ in left) == Counter((d, t) for t, d in want.items())


def check_dedup_near(rows, left):
    groups, left = near_groups(rows), Counter(left)
    assert sum(left.values()) == len(groups)
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        kept = next(rows[i] for i in members if left[rows[i]] and rows[i][0] == least)
        left[kept] -= 1


def check_mix(rows, mixed):
    sizes, target_words, taken = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target_words.update(brute_targets(sizes))
    whole = Counter(rows)
    cut = defaultdict(list)
    times = Counter()
    for d, t, s in mixed:
        taken[s] += len(WORD.findall(t))
        if whole[d, t, s]:
            times[d, t, s] += 1
        else:
            cut[s].append((d, t))
    assert all(abs(taken[s] - n) <= 1 for s, n in target_words.items())
    assert all(n <= 3 * whole[x] for x, n in times.items())
    for s, some in cut.items():  # a source's line ends inside one document, whose text goes on
        assert len(some) == 1
        d, t = some[0]
        assert any(x == d and (y or "").startswith(t) and (y or "")[len(t)] in " \t\n\x0b\x0c\r" for x, y, z in rows if z == s)


def check_pack(rows, pieces):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.pack.__globals__["default_tokenizer"]())
    want = Counter((d, len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t, _ in rows)
    ids, lengths, fill = Counter(), Counter(), defaultdict(list)
    for p in pieces:
        lengths[p.doc_id, p.doc_tokens] += p.length
        ids.update(p.ids)
        fill[p.sequence_id].append((p.offset, p.length))
    assert {k: n * k[1] for k, n in want.items()} == dict(lengths)
    assert ids == sum((Counter([*tok.encode(t, add_special_tokens=False).ids, 0]) for _, t, _ in rows), Counter())
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    assert len(fill) == -(-sum(lengths.values()) // 1024)


@pytest.mark.parametrize("table", ["edge", "corpus"])
def test_stages_in_a_row(table, spark, request, tmp_path):
    """Every stage's rows from those of the stage before, which each writes and the next reads; then run() over the same documents."""
    docs = request.getfixturevalue(table)
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "in" / "documents.parquet"))
    checks = [lambda a, b: b == brute_clean(a) or pytest.fail("clean"), check_dedup_exact, check_dedup_near, check_mix]
    for (name, stage), check in zip(P.STAGES, checks, strict=False):
        out = stage(spark, docs, str(tmp_path / "in"))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        check(texts(docs), Counter(texts(after)) if name == "quality_rules" else texts(after))
        assert after.where("n_chars <> length(text)").count() == 0 or name in ("exact_dedup",)
        docs = after
    pieces = P.STAGES[-1][1](spark, docs, str(tmp_path / "in")).collect()
    check_pack(texts(docs), pieces)
    again = P.run(spark, str(tmp_path / "in")).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in again) == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) or table == "edge"
    assert sum(r.length for r in again) == sum(r.length for r in pieces)


def test_lines_survive_the_mix(spark):
    rows = [(i, "\n".join(f"w{i} w{j} end." for j in range(40)), "a" if i else "b", None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = P.mix(spark, docs, "").collect()
    assert all(r.text.count("\n") == (len(r.text.split()) - 1) // 3 for r in out) and any(len(r.text.split()) < 120 for r in out)


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
