"""Operator 8, license scans: template markup compiled into token automata.

A template is license wording with two kinds of markup, `<<optional>>...<</optional>>` around words that may be missing
and `<<var max=N>>` for 0 to N replaceable words. It compiles to an automaton over words, run from each place where the
longest run of its mandatory words stands; a text is accepted where all mandatory wording follows in order, nothing else
between but what the markup allows. Beside the templates, plain phrases are found wherever their words stand in a row.

Defined cases: a null text is empty (no words, no label, score 0). Texts are read whole. Rows are independent, so repeated
rows and tied or null ids give a row each. Other columns are ignored. Empty in, empty out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: phrase, label
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Bytes of words stay (A-Z in lower case), all others part words.
TABLE = bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


class Automaton:
    """States 0..n; state i has word edges, wildcard edges and empty edges."""

    def __init__(self, markup: str) -> None:
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.skip: list[list[int]] = [[]]
        state, opened, self.mandatory = 0, [], 0
        run, self.anchor, self.before, seen_max, anchor_before = [], [], 0, 0, 0
        for item in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
            if not item.startswith("<<"):
                for word in item.encode().translate(TABLE).split():
                    state = self._add(state, word)
                    if not opened:
                        self.mandatory += 1
                        if not run:
                            anchor_before = seen_max
                        run.append(word)
                        if len(run) > len(self.anchor):
                            self.anchor, self.before = list(run), anchor_before
                    seen_max += 1
                continue
            run = []
            if item == "<<optional>>":
                opened.append(state)
            elif item == "<</optional>>":
                self.skip[opened.pop()].append(state)
            else:
                n = int(re.search(r"max=(\d+)", item)[1])
                ends = [state]
                for _ in range(n):
                    state = self._add(state, None)
                    ends.append(state)
                for e in ends[:-1]:
                    self.skip[e].append(state)
                seen_max += n
        if opened or not self.anchor:
            raise ValueError(f"markup isn't closed or has no mandatory word: {markup}")
        self.final = state
        self.needle = b" " + b" ".join(self.anchor) + b" "

    def _add(self, state: int, word: bytes | None) -> int:
        self.words.append({})
        self.any.append(None)
        self.skip.append([])
        if word is None:
            self.any[state] = len(self.any) - 1
        else:
            self.words[state][word] = len(self.any) - 1
        return len(self.any) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def end(self, words: list[bytes], start: int) -> int | None:
        """Where the first match from start ends, None without one."""
        states = self._closed({0})
        for i in range(start, len(words) + 1):
            if self.final in states:
                return i
            if i == len(words):
                return None
            nxt = {t for s in states if (t := self.words[s].get(words[i])) is not None}
            nxt |= {t for s in states if (t := self.any[s]) is not None}
            if not nxt:
                return None
            states = self._closed(nxt)
        return None


def places(norm: bytes, needle: bytes) -> list[int]:
    """Word positions of needle (with its outer spaces) in norm (words with one space before, between and after)."""
    found, at, spaces, done = [], norm.find(needle), 0, 0
    while at >= 0:
        spaces += norm.count(b" ", done, at)
        done = at
        found.append(spaces)
        at = norm.find(needle, at + 1)
    return found


def scan_text(text: str | None, phrases: list[tuple[bytes, str]], automata: list[tuple[str, Automaton]]) -> dict:
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    norm = b" " + b" ".join(words) + b" "
    hits = [(p, label) for needle, label in phrases for p in places(norm, needle)]
    base = {label for _, label in hits}
    starts = [p for p, _ in hits]
    spans = []
    for label, a in automata:
        free = 0
        for p in places(norm, a.needle):
            for start in range(max(free, p - a.before), p + 1):
                if (end := a.end(words, start)) is not None and end > p:
                    spans.append((label, start, end, a.mandatory))
                    free = end
                    break
    labels = base | {label for label, *_ in spans}
    # the more mandatory words of an accepted wording stand there, the surer
    best = max((m for *_, m in spans), default=0)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": 1 - 2 ** (-1 - best / 8) if spans else 0.25 if base else 0.0,
        "spans": [{"label": label, "start": s, "end": e} for label, s, e, _ in spans],
    }


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, end in words).

    score: with an accepted template 1 - 2**(-1 - m / 8), m the most mandatory words of one; 0.25 with phrases alone, else 0.
    """
    needles = [(b" " + b" ".join(p.encode().translate(TABLE).split()) + b" ", label) for p, label in phrases]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long>>"
    out = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
        ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(label, Automaton(markup)) for label, markup in templates]
        for batch in batches:
            found = [scan_text(t, needles, automata) for t in batch.column("text").to_pylist()]
            made = pa.Table.from_pylist(found, schema=out).combine_chunks()
            yield from pa.table([batch.column("id"), *made.columns], names=["id", *out.names]).to_batches()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
