"""Fill-in-the-middle against a plain re-statement, and exact round trips."""

import hashlib
import random
import re

import fixtures as fx
import pytest

from snippetry.llm import fill_in_middle as fim

UNITS = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"\A[ \t-\r]+|[^ \t-\r]+[ \t-\r]*"}


def expected(doc_id, text, unit="char", seed="1", plain=10, spm=20, marks=fim.Sentinels()):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), marks.suffix + suffix + marks.prefix + prefix + marks.middle + middle
    return n, "psm", len(prefix), len(middle), marks.prefix + prefix + marks.suffix + suffix + marks.middle + middle


def mixed_texts():
    rnd = random.Random(5)
    fixed = [None, "", "a", "<P>", "x <S> y", "<M", "a<", "<", ">", "\n\n", " ", "é", "😀é", "\u0000", "x " * 30]
    return fixed + ["".join(rnd.choice("ab é\n😀 <P>SM\t") for _ in range(rnd.randrange(60))) for _ in range(300)]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equals_a_plain_restatement(spark, unit):
    texts = mixed_texts()
    rows = fim.restored(fim.transform(fx.of_texts(spark, texts), unit=unit)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = expected(r["doc_id"], texts[r["doc_id"]], unit)
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["restored"] == (texts[r["doc_id"]] or "")
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("part", [1, 5, 64])
def test_long_texts_pass_in_parts(monkeypatch, part, unit):
    import pyarrow as pa

    monkeypatch.setattr(fim, "PART", part)
    monkeypatch.setattr(fim, "_SLICE", 4 * part)
    texts = mixed_texts()
    got = fim.arrange(pa.array(texts), list(range(len(texts))), "1", 10, 20, unit, fim.Sentinels())
    for i, row in enumerate(zip(*[c.to_pylist() for c in got])):
        assert row == expected(i, texts[i], unit)


def test_very_long_and_repeated_and_odd_rows(spark):
    long = fx.text(4, 300_000, 5000)
    docs = fx.documents(spark).unionByName(fx.documents(spark, [(77, long, "en", "a", None, 1, 2, 3, 0.5, 4)] * 2))
    rows = fim.restored(fim.transform(docs)).collect()
    assert sorted((repr((r["doc_id"], r["restored"])) for r in rows)) == sorted(repr((r["doc_id"], r["text"] or "")) for r in docs.collect())
    for r in rows:
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected(r["doc_id"], r["text"])
        assert r["score"] == 0.5 and r["rows"] == 4


def test_clashing_names_and_empty_tables(spark):
    docs = fx.documents(spark).withColumnRenamed("size", "output").withColumnRenamed("key", "form")
    got = fim.transform(docs)
    assert got.columns == [c for c in docs.columns if c not in ("output", "form")] + ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.restored(fim.transform(docs.where("false"))).count() == 0 and got.count() == docs.count()


def test_shares_and_seeds(spark):
    docs = fx.of_texts(spark, ["some words of text"] * 400)
    forms = [r["form"] for r in fim.transform(docs, plain_percent=0, spm_percent=100).collect()]
    assert set(forms) == {"spm"}
    assert {r["form"] for r in fim.transform(docs, plain_percent=100).collect()} == {"plain"}
    a, b = (sorted(r["output"] for r in fim.transform(docs, seed=s).collect()) for s in ("1", "2"))
    assert a != b


@pytest.mark.parametrize("marks", [("<P>", "<S>", "S>"), ("<P>", "<P>", "<M>"), ("<P", "<Px>", "<M>"), ("", "<S>", "<M>"), ("<<", "<S>", "<M>")])
def test_sentinels_that_could_not_be_read_back_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Sentinels(*marks)


def test_other_sentinels(spark):
    marks = fim.Sentinels("|pre|".replace("|", "\u0001", 1), "\u0001suf", "\u0001mid")
    texts = ["abc def", "with \u0001mid inside", "\u0001", "m\u0001s"]
    rows = fim.restored(fim.transform(fx.of_texts(spark, texts), marks=marks, plain_percent=0), marks).collect()
    assert [r["restored"] for r in sorted(rows, key=lambda r: r["doc_id"])] == texts
    assert {r["doc_id"] for r in rows if r["form"] == "plain"} == {1}
