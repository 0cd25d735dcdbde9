"""Piecewise n-gram counts against brute force, at the seams of pieces above all."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from snippetry.operators import gram_counting, tfidf

TEXTS = ["", "a", "ab", "abc", "abcabcabc", "é😀é😀 é😀", "x" * 50, "the cat sat on the mat " * 9]


def brute(text, low, high):
    return Counter(text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1))


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    return TEXTS + ["".join(rnd.choice("ab é😀\n") for _ in range(rnd.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 16])
@pytest.mark.parametrize("low, high", [(1, 1), (1, 4), (3, 6), (2, 7)])
def test_known_grams_at_every_seam(monkeypatch, piece, low, high):
    monkeypatch.setattr(gram_counting, "PIECE", piece)
    texts = random_texts(40)
    every = sorted(set().union(*[brute(t, low, high) for t in texts]))
    grams = random.Random(1).sample(every, len(every) // 2)
    table = gram_counting.GramTable(grams, low, high)
    for t in texts:
        want = brute(t, low, high)
        numbers, counts = table.counts(t)
        assert list(numbers) == sorted(numbers)
        assert {grams[i]: c for i, c in zip(numbers, counts)} == {g: want[g] for g in grams if want[g]}


def test_hashes_that_meet_are_told_apart():
    grams = ["abc", "abd", "abcd", "xyzxyz"]
    table = gram_counting.GramTable(grams, 3, 6)
    # Every text now hashes like some n-gram of the vocabulary: only the full comparison tells.
    table._hash = lambda keys: table.hashes[[hash(int(k)) % 4 for k in keys[0]]]
    numbers, counts = table.counts("abd abd")
    assert set(numbers) <= {1} and sum(counts) <= 2


@pytest.mark.parametrize("held", [3, 300_000])
def test_corpus_and_row_counts(spark, monkeypatch, held):
    monkeypatch.setattr(gram_counting, "HELD", held)
    texts = [*random_texts(30), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    corpus = sum((brute((t or "").lower(), 3, 6) for t in texts), Counter())
    assert {r["gram"]: r["cf"] for r in tfidf.corpus_counts(df, "t").collect()} == dict(corpus)
    want = {(i, g): n for i, t in enumerate(texts) for g, n in brute((t or "").lower(), 3, 6).items()}
    assert {(r["id"], r["gram"]): r["tf"] for r in tfidf.gram_counts(df, "id", "t").collect()} == want
    monkeypatch.setattr(tfidf, "LONG_TEXT", 20)
    assert {(r["id"], r["gram"]): r["tf"] for r in tfidf.gram_counts(df, "id", "t").collect()} == want


@pytest.mark.parametrize("bits, sorted_, held", [(10, 5, 3), (2, 1 << 21, 1 << 21)])
def test_packed_counts_and_summaries(spark, monkeypatch, bits, sorted_, held):
    monkeypatch.setattr(gram_counting, "SORTED", sorted_)
    monkeypatch.setattr(gram_counting, "HELD_KEYS", held)
    # High n-grams leave few bits a character, so that texts of many characters are counted as strings.
    low, high = (3, 6) if bits == 10 else (3, 30)
    many = "".join(chr(0x4E00 + i) for i in range(1500))
    texts = [*random_texts(30), None, many, "a\0b\0\0c\0", "zebra ézebra", many[:40] + "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    each = [brute((t or "").lower(), low, high) for t in texts]
    assert {r["gram"]: r["cf"] for r in tfidf.corpus_counts(df, "t", (low, high)).collect()} == dict(sum(each, Counter()))
    got = {(r["id"], r["gram"]): r["tf"] for r in tfidf.gram_counts(df, "id", "t", (low, high)).collect()}
    assert got == {(i, g): n for i, own in enumerate(each) for g, n in own.items()}
    want = set()
    for i, own in enumerate(each):
        for n in {len(g) for g in own}:
            of = [g for g in own if len(g) == n]
            want.add((i, n, sum(own[g] for g in of), len(of), min(of), max(of)))
    assert {tuple(r) for r in gram_counting.row_gram_summary(df, "id", "t", low, high).collect()} == want


def test_packed_numbers_give_the_same_strings():
    packer = gram_counting.Packer(6)
    numbers = packer.numbers("é😀abcabca")
    keys = packer.keys(numbers, 7, 6)
    assert packer.strings(keys).to_pylist() == ["é😀abca", "😀abcab", "abcabc", "bcabca", "cabca", "abca", "bca"]
    assert packer.numbers("a\0") is None and packer.numbers("".join(map(chr, range(1, 1200)))) is None


def test_a_very_long_text(spark):
    text = "".join(random.Random(2).choices("abcde ", k=300_000))
    df = spark.createDataFrame([(1, text), (2, "abc")], "id bigint, code_clean string")
    model = tfidf.CharTfidf(max_features=200).fit(df)
    counts = model.weights(df, "id").where("id = 1").select("gram", "tf").collect()
    want = brute(text, 3, 6)
    assert len(counts) == 200 and all(r["tf"] == want[r["gram"]] for r in counts)


def test_stage_saves_and_loads(spark, tmp_path):
    counter = gram_counting.GramCounter(inputCol="t", outputCol="c", vocabulary=["abc", "é😀é"], low=3, high=6)
    counter.write().save(f"{tmp_path}/counter")
    loaded = gram_counting.GramCounter.load(f"{tmp_path}/counter")
    df = spark.createDataFrame([("ABCabc é😀é",), (None,)], "t string")
    out = [r["c"] for r in loaded.transform(df).select("c").collect()]
    assert out[0].size == 2 and list(out[0].toArray()) == [2, 1] and list(out[1].toArray()) == [0, 0]


def test_vectors_leave_a_batch_in_bounded_parts(spark, monkeypatch):
    texts = random_texts(200) + [None]
    grams = sorted(set().union(*[brute(t, 1, 3) for t in texts if t]))
    monkeypatch.setattr(gram_counting, "HELD_HITS", 60)
    table = gram_counting.GramTable(grams, 1, 3)
    parts = [p.to_pylist() for p in gram_counting.vectors(iter([pa.array(texts), pa.array(texts[:3])]), table)]
    assert len(parts) > 20
    assert all(sum(len(v["indices"]) for v in part[:-1]) < 60 for part in parts)
    found = [dict(zip(v["indices"], v["values"])) for part in parts for v in part]
    assert found == [{grams.index(g): c for g, c in brute(t or "", 1, 3).items()} for t in texts + texts[:3]]
    monkeypatch.undo()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, code_clean string").coalesce(1)
    counted = gram_counting.GramCounter(vocabulary=grams, low=1, high=3).transform(rows).orderBy("id").collect()
    assert [dict(zip(r["_tf"].indices.tolist(), r["_tf"].values.tolist())) for r in counted] == found[: len(texts)]
