import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tripleloom.llm.components import connected_components
from tripleloom.llm.license_scan import Automaton, scan_licenses
from tripleloom.llm.ngram_join import jaccard_components
from tripleloom.llm.packing import default_tokenizer, pack
from tripleloom.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    ws = WORD.findall((text or "").translate(LOW))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute_components(rows, k, percent):
    """rows: (id, text) with ids that may repeat; the result as a multiset."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    links = Counter()
    for (a, b), n in shared.items():
        if n * 100 >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
            links.update((a, b))
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[root(i)] = min(name.get(root(i), d), d)
    return Counter((d, len(sets[i]), name.get(root(i)), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("table", ["edge", "unique", "corpus", "empty"])
def test_jaccard_components(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, jaccard_components(docs).collect())) == brute_components(rows, 4, 85)


def test_jaccard_large_families(spark, monkeypatch):
    """Families of several chunks, with members that only some others match."""
    from tripleloom.llm import ngram_join

    for name, value in (("CHUNK", 1500), ("TILE", 64)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for j in rng.choice(120, rng.integers(0, 9), replace=False):
            t[j] = f"x{rng.integers(0, 1000)}"
        rows.append((int(i), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (70, 80, 85, 90):
        assert Counter(map(tuple, jaccard_components(docs, percent=percent).collect())) == brute_components(rows, 4, percent)


def test_jaccard_many_short_texts(spark, monkeypatch):
    """A family of many small sets splits by nodes; ids are strings."""
    from tripleloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "NODES", 40)
    rng = np.random.default_rng(5)
    rows = [(f"d{i:03}", " ".join(["a b c d e f g h i j k l", *(f"y{rng.integers(0, 4)}" for _ in range(rng.integers(0, 4)))])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert Counter(map(tuple, jaccard_components(docs, percent=75).collect())) == brute_components(rows, 4, 75)


def test_prefixes_adapt(spark):
    """Sets of shingles that many others have take longer prefixes; sets of rare ones the shortest."""
    from tripleloom.llm import ngram_join

    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(600):
        t = [f"z{rng.integers(0, 10**9)}" for _ in range(300)] if i % 2 else list(base)
        if i % 2 == 0:
            t[rng.integers(0, 300)] = f"x{i}"
        rows.append((i, " ".join(t)))
    classes = ngram_join.count_classes(spark.createDataFrame(rows, "doc_id long, text string").select("text"), 4)
    hasher = ngram_join.Hasher()
    chosen = [ngram_join.choose(ngram_join.in_order(s, classes), classes, 85)[0] for s in ngram_join.sets_of(hasher.words([t.encode() for _, t in rows]), 4)]
    shortest = 1 + 297 // 50
    assert all(c == shortest for c in chosen[1::2]) and sum(c > shortest for c in chosen[::2]) > 250


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


def test_licenses(spark, edge, empty):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "cc by cc BY; CC-by-nc ccby", "All rights, reserved. General Public\nLicense", None, "",
        "Copyright (c) 2020 Some Body Here. All Rights Reserved", "Copyright one two three four five six seven all rights reserved", "licensed under the GNU Lesser General Public License, version 3",
    ]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].labels == "apache-2.0" and got[0].base_labels == "" and got[0].score == 1 - 2 ** (-1 - 7 / 8) and got[0].n_words == 8
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 4, "cc-by") and got[1].score == 0.25
    assert got[2].labels == "gpl,reserved" and got[2].n_base == 2
    assert got[3].n_words == got[4].n_words == 0 and got[3].first_word is None and got[3].score == 0
    assert "copyright-notice" in got[5].labels and "copyright-notice" not in got[6].labels
    assert got[7].labels == "gpl,gpl-any"
    assert scan_licenses(edge).count() == edge.count() and scan_licenses(empty).count() == 0


def as_pattern(markup):
    """Template markup as a regular expression over words with a space after each."""
    out = ""
    for item in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if item == "<<optional>>":
            out += "(?:"
        elif item == "<</optional>>":
            out += ")?"
        elif item.startswith("<<"):
            out += "(?:[^ ]+ ){0,%s}" % re.search(r"\d+", item)[0]
        else:
            out += "".join(re.escape(w) + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.translate(LOW)))
    return re.compile("(?<![^ ])" + out)


def test_licenses_against_brute_force(spark, corpus):
    """All columns, over the corpus and over texts made of the templates themselves."""
    from tripleloom.llm.license_scan import PHRASES
    from tripleloom.llm.license_texts import TEMPLATES

    rng = random.Random(3)
    patterns = [(label, as_pattern(m)) for label, m in TEMPLATES]
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    for i, (_, markup) in enumerate(TEMPLATES):
        whole = re.sub(r"<<var[^>]*>>", " Some Holder ", re.sub(r"<</?optional>>", " ", markup))
        bare = re.sub(r"<<var[^>]*>>", "", re.sub(r"<<optional>>.*?<</optional>>", " ", re.sub(r"<<optional>>s<</optional>>", "", markup), flags=re.S))
        words = whole.split()
        broken = " ".join([*words[: len(words) // 2], "other", *words[len(words) // 2 :]])
        for j, t in enumerate((whole, bare, broken, whole.upper() + rows[i][1], bare + "\n" + whole)):
            rows.append((10**6 + 10 * i + j, rng.choice(["", "Before. ", "cc by "]) + t))
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    found = Counter()
    for d, text in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
        places = [(i, label) for p, label in PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        base = {label for _, label in places}
        norm = "".join(w + " " for w in ws)
        labels = base | {label for label, p in patterns if p.search(norm)}
        found.update(labels)
        r, at = got[d], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(labels))), text[:300]
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    assert {label for label, _ in TEMPLATES} <= set(found)


def test_automaton():
    a = Automaton("<<optional>>a<</optional>> b c <<var max=2>> d <<optional>>e f<</optional>> g")
    for text, ok in (("a b c d g", True), ("b c d g", True), ("b c x d e f g", True), ("b c x y d g", True), ("b c x y z d g", False), ("b c d e g", False), ("b d g", False)):
        assert (a.end(text.encode().split(), 0) is not None) == ok, text


@pytest.mark.parametrize("table", ["edge", "corpus", "empty"])
def test_packing(table, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    got = pack(docs).collect()
    tok = Tokenizer.from_file(default_tokenizer())
    want = Counter((r.doc_id, tuple([*tok.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    open_, whole = defaultdict(list), Counter()
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        open_[r.doc_id, r.doc_tokens].append(r)
    for (d, n), pieces in open_.items():
        at = defaultdict(list)
        for p in pieces:
            at[p.start].append(p)
        for p in list(at[0]):  # rows of one id: follow any piece that continues
            ids, cur = list(p.ids), p
            while len(ids) < n:
                cur = next(x for x in at[len(ids)] if any(k[0] == d and list(k[1][: len(ids) + x.length]) == ids + x.ids for k in want))
                at[cur.start].remove(cur)
                ids += cur.ids
            whole[d, tuple(ids)] += 1
    assert whole == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    used = sum(sum(n for _, n in s) for s in fill.values())
    assert len(fill) == -(-used // 1024)


def test_substring_dedup(spark, edge, corpus, empty):
    line = "This line has, as one may count " + " ".join(f"word{i}" for i in range(40)) + " as one sees."
    other = line.upper().replace(" ", " \t ") + "!"
    short = "A line of few words that many documents share without being copies of each other."
    texts = [f"{short}\n{line}\nAfter it.", f"{short}\nOther words.\n  {other}\nEnding differently here.", f"{line}\n{line}", "Short. Short.", None, f"x{line}"[: len(line) // 2]]
    got = substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].spans == [] and got[0].text == texts[0]
    assert [texts[1][s.start : s.end] for s in got[1].spans] == [other] and got[1].text == f"{short}\nOther words.\n  \nEnding differently here."
    assert got[2].text == "\n" and got[2].n_removed == 2 and got[3].spans == [] and got[4].text == "" and got[5].spans == []
    for docs in (edge, corpus, empty):
        rows = docs.select("doc_id", "text").collect()
        out = substring_dedup(docs).collect()
        assert Counter((r.doc_id, len(r.text or "")) for r in rows) == Counter((r.doc_id, r.n_chars) for r in out)
    by_id = {r.doc_id: r.text for r in corpus.collect()}
    firsts = set()
    for r in sorted(substring_dedup(corpus).collect(), key=lambda r: r.doc_id):
        text, at, left = by_id[r.doc_id], 0, []
        for s in r.spans:
            left.append(text[at : s.start])
            at = s.end
        assert "".join([*left, text[at:]]) == r.text
        for l in r.text.split("\n"):
            ws = l.lower().split()
            if len(ws) >= 40 and l in text.split("\n"):
                key = " ".join(ws).strip(" .,;:!?\"'()[]{}-")
                assert key not in firsts
                firsts.add(key)


def test_repeats_against_brute_force(corpus):
    """Every run of 40 words and more that the corpus repeats goes but for once, and no other word does."""
    rows = sorted(((r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()), key=lambda r: r[0])
    out = {r.doc_id: r for r in substring_dedup(corpus).collect()}
    seen: set = set()
    more = less = repeated_words = 0
    for d, text in rows:
        spans = [m.span() for m in WORD.finditer(text)]
        ws = [text[s:e].translate(LOW) for s, e in spans]
        grams = [tuple(ws[i : i + 40]) for i in range(len(ws) - 39)]
        repeated = np.zeros(len(ws), bool)
        for i, g in enumerate(grams):
            if i >= 20:
                seen.add(grams[i - 20])  # a text that repeats itself keeps a window at least
            if g in seen:
                repeated[i : i + 40] = True
        seen.update(grams)
        cut = np.zeros(len(text) + 1, bool)
        for s in out[d].spans:
            cut[s.start : s.end] = True
        gone = np.array([cut[s] for s, _ in spans], bool)
        repeated_words += repeated.sum()
        more += (gone & ~repeated).sum()
        less += (repeated & ~gone).sum()
    assert repeated_words > 5000 and less <= 0.01 * repeated_words and more <= 0.01 * repeated_words, (repeated_words, less, more)
