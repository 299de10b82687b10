import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tripleloom.llm.chat_format import expand_prefixes, read_back
from tripleloom.llm.exact_dedup import exact_dedup, survivors
from tripleloom.llm.mixing import mix_sources
from tripleloom.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rules(text):
    t = text or ""
    ws = WORD.findall(t)
    places = defaultdict(list)
    for i in range(len(ws) - 7):
        places[tuple(ws[i : i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("table", ["edge", "corpus", "empty"])
def test_quality_counts(table, request):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "text").collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules(docs).collect())
    assert got == Counter((r.doc_id, *brute_rules(r.text)) for r in rows)


def brute_line(line):
    """Whether a line with words must go."""
    from tripleloom.llm import quality_rules as Q

    n = len(WORD.findall(line))
    if n < 5 and not re.search(r"""[.!?:;,…。！？"'”’»)\]}][\x20\x09-\x0D]*$""", line):
        return True
    if 3 * len(re.findall(r"(?:^|[\x20\x09])[|>»›•·/\\](?=[\x20\x09]|$)", line)) > n:
        return True
    phrases = [x for p in (Q.MENU_WORDS, Q.BOILERPLATE_PHRASES) for x in p.values()]
    rest = line.strip(" \t\n\x0b\x0c\r")
    while rest and (m := max((m for p in phrases[:4] for w in p.split("|") if (m := re.match(w, rest, re.I))), key=lambda m: m.end(), default=None)):
        rest = rest[m.end() :].lstrip(" \t|>»›•·/,")
    if not rest:
        return True
    starts = [i for i in range(len(line)) if i == 0 or not re.match("[A-Za-z]", line[i - 1])]
    if n <= 25 and any(re.match(p, line[i:], re.I) for p in phrases[4:] for i in starts):
        return True
    return len(re.findall(r"[#*$%&|<>]", line)) > n or (n >= 5 and 3 * len(re.findall(r"[!?]{2,}", line)) > n)


def test_quality_verdicts(spark, corpus, edge):
    """kept, cleaned_text and removed words against brute force, over the corpus, the edge cases and lines of all languages."""
    more = ["Startseite | Kontakt | Impressum", "Alle Rechte vorbehalten und noch mehr Worte dazu.", "Accueil > Aide", "Tous droits Réservés, dit le monsieur de la maison.", "INICIO / AYUDA", "Leer más sobre todo esto en la red.",
            "Ends well.", "no end", "A, b!! c!! d!! e!! f!!", "# * $ % a", "unpowered by nothing at all, it said to them.", "Home is where the heart is, they say."]
    body = "This line has quite a few words and ends with a mark, so that it is kept in any case."
    rows = [(10**6 + i, f"{body}\n{x}\n{body} Indeed.") for i, x in enumerate(more)] + [(10**6 + 99, "\n".join(more)), (10**6 + 100, f"{body}\n" + "\n".join(more))]
    rows += [(r.doc_id, r.text) for df in (corpus, edge) for r in df.select("doc_id", "text").collect()]
    want = Counter()
    for d, t in rows:
        t = t or ""
        n, *_, repeated = brute_rules(t)
        lines = t.split("\n")
        gone = [bool(WORD.search(x)) and brute_line(x) for x in lines]
        removed = sum(len(WORD.findall(x)) for x, g in zip(lines, gone, strict=True) if g)
        failed = n < 20 or 100 * repeated > 30 * n
        want[d, failed, not failed and 100 * removed <= 40 * n, sum(gone), removed, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)] += 1
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.base_failed, r.kept, r.removed_lines, r.removed_words, r.cleaned_text) for r in got)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_quality_lines(spark):
    good = "This line has quite a few words and ends with a mark."
    more = "Another one follows here, also long enough to be kept."
    texts = [f"{good}\n{more}\nHome | About | Contact | Login\nshort one", "Home | About\nLogin | Search", f"{good}\n{more}\n{more[::-1]}."]
    got = quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].cleaned_text == f"{good}\n{more}" and got[0].removed_lines == 2 and got[0].kept
    assert not got[1].kept and got[2].kept and got[2].removed_lines == 0 and got[2].cleaned_text == texts[2]


@pytest.mark.parametrize("table", ["edge", "corpus", "empty"])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(table, keep, request):
    docs = request.getfixturevalue(table)
    groups = defaultdict(list)
    rows = [(r.doc_id, (r.text or "").translate(LOW)) for r in docs.collect()]
    for i, t in rows:
        groups[t].append(i)
    pick = min if keep == "smallest" else max
    best = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = Counter((i, best[t], len(groups[t]), i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert Counter(map(tuple, exact_dedup(docs, keep=keep).collect())) == want
    weak = exact_dedup(docs, keep=keep, digest=lambda c: F.length(c) % 2)
    assert Counter(map(tuple, weak.collect())) == want
    left = survivors(docs, keep=keep)
    assert left.columns == docs.columns and sorted(((r.doc_id, (r.text or "").translate(LOW)) for r in left.collect()), key=str) == sorted(((i, t) for t, i in best.items()), key=str)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.remove(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("table", ["edge", "corpus", "empty"])
def test_mixing(table, request):
    docs = request.getfixturevalue(table)
    got = mix_sources(docs).collect()
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = brute_targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {round(t, 4) for t in target.values()}
    assert {round(r.target, 4) for r in got} <= by
    taken = Counter()
    for r in got:
        taken[(r.source_size, round(r.target, 4))] += r.taken
    for (size, t), n in taken.items():
        many = sum(1 for s in sizes if sizes[s] == size and round(target[s], 4) == t)
        assert abs(n - many * t) <= max(3, 0.01 * t) * many
    assert sorted(map(str, mix_sources(docs).collect())) == sorted(map(str, got))


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<|end|>\\<|turn|>", None, "", "a\\nb\n<s>", "<<s>>", "[[INST]"]
    rows = [(c, i, ["user", "assistant", "system", None, "x<|text|>\n"][(c + i) % 5], nasty[(c * 3 + i) % 8], "clash") for c in range(12) for i in range(c % 7 + 1)]
    rows += [(None, 1, "user", "a", None), (None, None, "assistant", "b", None), (5, 1, "assistant", "tie", None), (5, 1, "assistant", "tie", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    want = {}
    by = defaultdict(list)
    for k, (c, t, r, x, _) in enumerate(rows):
        by[c if c is not None else f"lone {k}"].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        want[len(want), None if str(c).startswith("lone") else c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = expand_prefixes(df)
    assert Counter(tuple(r)[:5] for r in read_back(examples).collect()) == Counter((c, *x) for (_, c), x in want.items())
    for e in examples.collect():
        assert e.text.count("<|turn|>") == e.n_context + 1 and "[INST]" not in e.text and "</s>" not in e.text
    assert read_back(expand_prefixes(df.where("false"))).count() == 0
