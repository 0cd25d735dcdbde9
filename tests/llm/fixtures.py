"""Small tables with the cases that every operator must stand, and plain re-statements of the operators."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, key bigint, node bigint, score double, rows int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text(seed: int, n: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" + rnd.choice(["", "", ",", "."]) for _ in range(n))


def edited(base: str, seed: int, edits: int) -> str:
    rnd, words = random.Random(seed), base.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(1000)}"
    return " ".join(words)


def odd_rows() -> list[tuple]:
    """Nulls everywhere, empty, blank, short, very long and repeated texts, ties, and extra columns with clashing names."""
    base = text(1, 200)
    rows = [
        (None, None, None, None), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "One", "en", None), (5, "one two", "en", "b"),
        (6, base, "en", "b"), (7, base, "en", "b"), (7, base, "en", "b"), (None, base, None, "c"), (8, edited(base, 2, 2), "en", "c"),
        (9, text(3, 30_000, 5000), "en", "c"), (10, "12 34 !!", None, "a"), (11, "É\x1c ü one", "fr", "a"), (12, "the of " * 500, "en", "a"),
    ]
    return [(i, t, lang, source, None, 1, 2, 3, 0.5, 4) for i, t, lang, source in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def of_texts(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, k: int) -> set:
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute_components(rows: list[tuple], k: int, percent: int) -> list[int]:
    """Least id reachable for each (id, text)."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            shared = len(a & b)
            if shared and 100 * shared >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), doc) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [doc if not sets[i] else least[find(i)] for i, (doc, _) in enumerate(rows)]


def brute_repeats(texts: list[str | None], length: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def in_training(doc_id: int, fold: int, rest: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % fold != rest


LETTERS = re.compile(r"[^\W\d_]+")


def brute_language(labelled, smooth=0.1, longest=4, certain=10):
    """A function from text to (language, score), learned from (text, lang) pairs; None for no letter."""

    def pieces(word, n):
        marked = f"^{word}$" if n > 1 else word
        return [marked[i : i + n] for i in range(len(marked) - n + 1)]

    seen, parts = {}, {}
    for t, lang in labelled:
        if t is not None and lang is not None:
            seen.setdefault(lang, Counter()).update(LETTERS.findall(t.lower()))
    seen = {lang: c for lang, c in seen.items() if c}
    for lang, c in seen.items():
        for word, times in c.items():
            for n in range(1, longest + 1):
                for g in pieces(word, n):
                    parts.setdefault((lang, n), Counter())[g] += times
    names = sorted(seen)
    by_size = [[seen[x] for x in names]] + [[parts.get((x, n), Counter()) for x in names] for n in range(1, longest + 1)]
    counted = [([sum(c.values()) for c in tables], len(set().union(*tables))) for tables in by_size]

    def logs(item, n):
        tables, (totals, kinds) = by_size[n], counted[n]
        every = sum(totals)
        shares = [(c[item] / n if n else 0) + smooth / every for c, n in zip(tables, totals)]
        return np.array([math.log(s / (1 + smooth * kinds / every)) for s in shares])

    @cache
    def word_score(word):
        if any(word in c for c in seen.values()):
            return logs(word, 0)
        for n in range(longest, 0, -1):
            known = [g for g in pieces(word, n) if any(g in t for t in by_size[n])]
            if known:
                return sum(logs(g, n) for g in known) / len(known)
        return np.zeros(len(names))

    def judge(t):
        found = LETTERS.findall((t or "").lower())
        if not any(c.isalpha() for w in found for c in w) or not names:
            return None
        v = sum(word_score(w) for w in found) / len(found) * min(len(found), certain)
        e = np.exp(v - v.max())
        return names[int(np.argmax(v))], float(1 / e.sum())

    return judge
