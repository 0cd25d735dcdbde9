import hashlib
import zlib
from collections import Counter

import fixtures as fx
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from snippetry.llm import chat, decontamination, language_id, line_dedup, quality_classifier, quality_rules, token_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


# --- decontamination


def hits(spark, texts, items, window=10, slop=0, segment_words=2_000_000):
    index = decontamination.build_index(fx.of_texts(spark, texts), segment_words)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.matches(index, bench, window, slop, block_words=15)
    return {r["doc_id"]: r for r in decontamination.contamination(index, found).collect()}


def test_windows_short_items_and_document_borders(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    texts = ["x " + passage.upper() + " y", "p0 p1 p2 p3 p4", "p5 p6 p7 p8 p9 p10", "A tiny-item here. tiny item", None, "", "p3 " * 3 + " ".join(f"p{i}" for i in range(3, 13))]
    got = hits(spark, texts, [(1, passage), (2, "tiny item"), (2, "tiny item"), (3, None), (4, " ..."), (None, "Y")], segment_words=8)
    assert [got[i]["n_hit"] for i in range(7)] == [15, 0, 0, 4, 0, 0, 10]
    assert [got[i]["items"] for i in range(7)] == [["1", "null"], [], [], ["2"], [], [], ["1"]]
    assert [got[i]["n_words"] for i in range(7)] == [16, 5, 6, 6, 0, 0, 13]


def test_proximity_is_told_from_phrases(spark):
    got = hits(spark, ["a b c d", "a x b c d", "d c b a q q q q", "a b"], [(1, "a b c d")], window=4, slop=1)
    assert [(got[i]["n_hit"], got[i]["n_near"]) for i in range(4)] == [(4, 0), (0, 1), (0, 0), (0, 0)]


def test_proximity_does_not_reach_the_next_document(spark):
    item = [(1, "a a a a a a a a a f")]
    with pytest.raises(ValueError, match="slop and window"):
        hits(spark, ["a", "f"], item, slop=57)
    got = hits(spark, ["a", "f"], item, slop=decontamination.GAP - 10)
    assert [got[i]["n_near"] for i in range(2)] == [0, 0]


def test_decontamination_of_odd_and_empty_tables(spark):
    docs = fx.documents(spark)
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    left = decontamination.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    none = bench.where("false")
    assert decontamination.decontaminated(docs, none).count() == docs.count()
    assert decontamination.decontaminated(docs.where("false"), bench).count() == 0


# --- chat


def test_chat_round_trip_and_loss(spark):
    said = ["\\### Assistant: </turn> ok", "<turn>user\n\\l\\\\l<<\\n", "", None, "plain\nlines \\"]
    given = [(1, i, ("user", "assistant", "a<b\n\\n", None, "assistant")[i], t) for i, t in enumerate(said)] + [(None, None, "user", "x"), (1, 4, "assistant", said[4])]
    turns = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(turns)
    body = [r["formatted"] for r in formatted.collect()]
    assert all(t.count("<turn>") == 1 and t.count("</turn>") == 1 for t in body)
    read = chat.read_turns(formatted)
    assert rows(read, "role", "text") == sorted(((r or "", t or "") for _, _, r, t in given), key=repr)
    got = {r["conv_id"]: r for r in chat.conversation_digests(read).collect()}
    full = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in given if _ is not None and r != "user" or t == said[0])
    ordered = [g for g in given if g[0] == 1]
    full = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in ordered)
    loss = "".join(t for _, _, r, t in ordered if r == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256(full.encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1]["n_turns"] == 6 and got[None]["n_turns"] == 1
    assert chat.conversation_digests(chat.read_turns(chat.format_turns(turns.where("false")))).count() == 0


def test_content_parts_become_placeholders(spark):
    def part(kind, **more):
        return (kind, more.get("text"), more.get("uri"), more.get("width"), more.get("height"), more.get("seconds"), more.get("pages"))

    parts = [part("image", uri="i.png", width=28, height=15), part("text", text="a <image 1>"), part("audio", uri="a.wav", seconds=1.5), part("document", uri="d.pdf", pages=3), part("odd"), part(None, text="z")]
    df = spark.createDataFrame([(1, 0, "user", parts), (2, 0, "user", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_turns(df, parts=F.col("parts")).collect()}
    assert got[1]["formatted"] == "<turn>user\n<image 1>a \\limage 1><audio 2><document 3><odd 4>z</turn>\n"
    assert [(a["number"], a["kind"], a["uri"], a["tokens"]) for a in got[1]["attachments"]] == [(1, "image", "i.png", 4), (2, "audio", "a.wav", 38), (3, "document", "d.pdf", 768), (4, "odd", None, 0)]
    assert got[1]["attachment_tokens"] == 810 and got[2]["formatted"] == "<turn>user\n</turn>\n"


# --- quality rules


def test_rules_on_odd_rows(spark):
    docs = fx.documents(spark)
    got = quality_rules.judge(docs).collect()
    assert len(got) == docs.count() and set(docs.columns) <= set(got[0].asDict())
    for r in got:
        words = fx.WORD.findall(r["text"] or "")
        triples = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(docs.where("false")).count() == 0


def test_order_is_rejections_per_second_and_does_not_change_the_verdict(spark):
    rules = quality_rules.default_rules()
    measured = [quality_rules.Measured(r, s, x) for r, s, x in zip(rules, (2, 1, 1, 4, 1), (0.2, 0.2, 0, 0.8, 0.1))]
    assert [m.name for m in quality_rules.ordered(measured)] == ["shouting", "word length", "exclamation", "symbols", "line copies"]
    worth = [m.worth for m in sorted(measured, key=lambda m: -m.worth)]
    assert worth == sorted(worth, reverse=True)
    docs = quality_rules.with_base_counts(fx.of_texts(spark, ["a# b", "AAA BB", "good words here", "# !!! A"]))
    for order in (rules, rules[::-1]):
        assert rows(docs.where(quality_rules.first_failed(order).isNull()), "doc_id") == [(2,)]
    assert quality_rules.measure(docs, rules, sample_rows=10)[0].rejected == 0.5


# --- token files


def test_token_files_read_back_exactly(spark, tmp_path):
    docs = fx.documents(spark).union(fx.documents(spark, [(20, "it's <|endoftext|> a<|x", None, None, 0, 0, 0, 0, 0.0, 0), (21, "İ É. Á, x.", None, None, 0, 0, 0, 0, 0.0, 0)]))
    files = token_files.write(docs, TOKENIZER, f"file://{tmp_path}/out", shard_bytes=50_000, frame_bytes=300)
    got = token_files.starts(token_files.read_all(files)).orderBy("start").collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    asked = spark.createDataFrame([(6,), (7,), (99,)], "doc_id bigint")
    some = token_files.read_documents(token_files.open_files(spark, files.path), asked).collect()
    ids = t.encode(fx.text(1, 200), add_special_tokens=False).ids + [1]
    assert sorted((r["doc_id"], list(r["token_ids"])) for r in some) == [(6, ids), (7, ids), (7, ids)]


def test_damaged_frames_are_noticed(tmp_path):
    writer = token_files.FrameWriter(open(tmp_path / "x", "wb"))
    for data in (b"abc" * 50, b"", b"q"):
        writer.add(data)
    writer.close()
    import pyarrow as pa

    raw = (tmp_path / "x").read_bytes()
    reader = token_files.FrameReader(pa.PythonFile(open(tmp_path / "x", "rb"), "r"))
    assert [reader.frame(i) for i in range(3)] == [b"abc" * 50, b"", b"q"]
    at = reader.frames[2][0]
    (tmp_path / "y").write_bytes(raw[: at + reader.frames[2][1] - 1] + b"Q" + raw[at + reader.frames[2][1] :])
    with pytest.raises(Exception):
        token_files.FrameReader(pa.PythonFile(open(tmp_path / "y", "rb"), "r")).frame(2)


def test_no_documents_give_no_tokens(spark):
    files = token_files.write(fx.documents(spark).where("false"), TOKENIZER)
    assert token_files.starts(token_files.read_all(files)).count() == 0


# --- language


def test_language_of_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    got = language_id.predict(docs, model).where(language_id.held_out(F.col("doc_id")))
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect() if not fx.in_training(r["doc_id"], 5, 0)}


def test_language_back_off_and_odd_rows(spark):
    rows_ = [(1, "strasse über wasser", "de"), (2, "water over street", "en"), (3, None, "xx"), (4, "x", None)]
    model = language_id.train(spark.createDataFrame(rows_, "doc_id bigint, text string, lang string"), lexicon=2)
    assert model.languages == ["de", "en"] and len(model.words) == 2
    assert model.backed_off("wasserer")[0] > model.backed_off("wasserer")[1]
    assert list(model.backed_off("жук")) == [0, 0]
    got = {r["doc_id"]: r for r in language_id.predict(fx.documents(spark), model).collect() if r["doc_id"] is not None}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 10))
    assert all(0 < got[i]["score"] <= 1 for i in (4, 6, 9, 11)) and set(got[4].asDict()) == {c.split()[0] for c in fx.DOCS.split(", ")} | {"lang_pred"}
    nothing = language_id.train(fx.documents(spark).where("false"))
    assert {r["lang_pred"] for r in language_id.predict(fx.documents(spark), nothing).collect()} == {"und"}


# --- quality classifier


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = language_id.held_out(F.col("doc_id"), 3, 1)
    features = quality_classifier.with_trust(quality_classifier.featured(docs), labels, ~held).cache()
    scored = quality_classifier.fit(features).scored(features).join(labels.withColumnRenamed("quality", "truth"), "doc_id").where(~F.col("learn"))
    right = scored.where("(score >= 0.5) = (truth = 1)").count()
    assert right >= 0.95 * scored.count() > 0


def test_classifier_on_odd_rows(spark):
    docs = fx.documents(spark)
    labels = spark.createDataFrame([(6, 1), (6, 0), (8, 1), (12, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    features = quality_classifier.with_trust(quality_classifier.featured(docs), labels, F.lit(True)).cache()
    assert features.count() == docs.count() and rows(features.where("doc_id = 6"), "quality") == [(0,)]
    scored = quality_classifier.fit(features).scored(features)
    assert scored.where("score BETWEEN 0 AND 1").count() == docs.count()
    unlabelled = quality_classifier.with_trust(quality_classifier.featured(docs), labels.where("false"), F.lit(True))
    assert {r["score"] for r in quality_classifier.fit(unlabelled).scored(unlabelled).collect()} == {0.5}
    assert quality_classifier.fit(unlabelled.where("false")).scored(unlabelled.where("false")).count() == 0


# --- line dedup


@pytest.mark.parametrize("list_bytes", [line_dedup.LIST_BYTES, 0])
def test_boilerplate_is_relative_to_the_site(spark, list_bytes):
    page = "<nav>Home</nav><p>text {0}</p><script>var x</script><!-- Home --><p>{1}"
    given = [(i, f"http://A.example/{i}", page.format(i, "shared" if i < 2 else f"own {i}")) for i in range(4)]
    given += [(9, "http://b.example/", "<p>Home</p><p>Home</p>"), (10, None, "<p>Home</p>"), (11, "http://a.example:80/x", None), (12, "odd", "")]
    pages = spark.createDataFrame(given, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in line_dedup.drop_boilerplate(pages, list_bytes=list_bytes).collect()}
    assert got[0]["kept"] == ["text 0", "shared"] and got[3]["kept"] == ["text 3", "own 3"] and got[0]["host"] == "a.example"
    assert got[9]["kept"] == ["Home", "Home"] and got[10]["kept"] == ["Home"] and got[11]["lines"] == [] and got[12]["host"] is None
    assert line_dedup.drop_boilerplate(pages.where("false"), list_bytes=list_bytes).count() == 0
    # A repeated page is a page of its own, and keeps its row.
    assert line_dedup.drop_boilerplate(pages.union(pages), list_bytes=list_bytes).count() == 2 * len(given)


def test_language_keeps_rare_words_and_grams(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs.where(~language_id.held_out(F.col("doc_id")))
    wide = {r["doc_id"]: r for r in language_id.predict(docs, language_id.train(seen)).select("doc_id", "lang_pred", "score").collect()}
    tiny = language_id.predict(docs, language_id.train(seen, lexicon=3)).select("doc_id", "lang_pred", "score").collect()
    assert len(tiny) == len(wide) == docs.count()
    for r in tiny:
        assert r["lang_pred"] == wide[r["doc_id"]]["lang_pred"] and abs(r["score"] - wide[r["doc_id"]]["score"]) < 1e-9


def test_frequent_words_reach_the_driver_as_columns(spark, monkeypatch):
    """Held words are those of highest count, ties by word, and no word is a row that the driver collects."""
    counts = {f"{chr(97 + i // 26)}{chr(97 + i % 26)}": 1 + i % 7 for i in range(120)}
    rows_ = [(" ".join([w] * n), "de" if i % 3 else "en") for i, (w, n) in enumerate(counts.items())]
    docs, sizes = spark.createDataFrame(rows_, "text string, lang string"), []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: sizes.append(collect(df)) or sizes[-1])
    model = language_id.train(docs, lexicon=60)
    assert list(model.words) == sorted(counts, key=lambda w: (-counts[w], w))[:60] and model.log_words.shape == (60, 2)
    assert max(map(len, sizes)) < 30
    held = {r["item"]: r["scores"] for r in collect(model.word_table)}
    assert all(list(model.log_words[i]) == held[w] for w, i in model.words.items())


def test_language_of_rare_words_and_copies(spark):
    rows_ = [(i, "aa aa aa bb", "de") for i in range(9)] + [(9, "cc", "en"), (10, "cc dd", "en")]
    model = language_id.train(spark.createDataFrame(rows_, "doc_id bigint, text string, lang string"), lexicon=1)
    docs = spark.createDataFrame([(1, "cc dd cc"), (2, "cc dd cc"), (2, "cc dd cc"), (None, "bb"), (3, None)], "doc_id bigint, text string")
    got = language_id.predict(docs, model).collect()
    assert sorted(r["lang_pred"] for r in got) == ["de", "en", "en", "en", "und"]
    # By hand: 36 running words in de and 3 in en; each language's share of a word, and 0.1 of 39 on top.
    top = 0.1 / 39
    de, en = 3 * np.log(top), 2 * np.log(2 / 3 + top) + np.log(1 / 3 + top)
    assert all(abs(r["score"] - 1 / (1 + np.exp(de - en))) < 1e-9 for r in got if r["lang_pred"] == "en")


def test_language_scores_by_restatement(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    seen = [(r["text"], r["lang"]) for r in docs if fx.in_training(r["doc_id"], 5, 0)]
    # Another language with little text, with words that back off to each order of n-grams.
    seen += [("zażółć gęślą jaźń", "pl"), ("łódź jest", "pl"), (None, "pl"), ("x", None)]
    asked = [r["text"] for r in docs] + ["gęślami", "zaz", "ł", "жук", "ł жук", "123", "", None, "jest " * 40]
    judge = fx.brute_language(seen)
    for lexicon in (5, 50_000):
        model = language_id.train(spark.createDataFrame(seen, "text string, lang string"), lexicon=lexicon)
        got = language_id.predict(fx.of_texts(spark, asked), model).collect()
        kept = {r["doc_id"] for r in language_id.confident(fx.of_texts(spark, asked), model, 0.9).collect()}
        assert len(got) == len(asked)
        for r in got:
            name, score = judge(asked[r["doc_id"]]) or ("und", 0.0)
            assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-9
            assert (r["doc_id"] in kept) == (score >= 0.9)
        model.drop()


def test_language_sums_leave_a_task_in_pieces():
    texts = [f"known rare{chr(97 + i % 26)} known" if i % 3 else None for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i % 256]) for i in range(1200)]), pa.array(texts)], ["digest", "text"])
    out = list(language_id._summed(iter([batch]), {"known": 0}, np.array([[-1.0, -2.0]])))
    assert [b.num_rows for b in out] == [500, 500, 200]
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[1] == {"digest": b"\x01", "letters": True, "n": 3, "sums": [-2.0, -4.0], "rest": [{"item": "rareb", "times": 1}]}
    assert rows[600] == {"digest": bytes([600 % 256]), "letters": False, "n": 0, "sums": [0.0, 0.0], "rest": []}


def test_a_language_without_a_word_never_beats_the_only_one_with_it(spark):
    large = [("alpha beta gamma " * 50 + f"only{i:c}", "big") for i in range(97, 123)]
    model = language_id.train(spark.createDataFrame(large + [("delta rare", "small"), ("epsilon", "tiny")], "text string, lang string"))
    alone = ["alpha", "delta", "epsilon"] + [f"only{i:c}" for i in range(97, 123)]
    got = {r["text"]: r["lang_pred"] for r in language_id.predict(fx.of_texts(spark, alone), model).collect()}
    assert got == {w: "small" if w == "delta" else "tiny" if w == "epsilon" else "big" for w in alone}


def test_cased_tokenizer_files_keep_case(spark, tmp_path):
    cased = Tokenizer(models.WordLevel({"[UNK]": 0, "A": 2, "a": 3}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    cased.save(f"{tmp_path}/cased.json")
    files = token_files.write(spark.createDataFrame([(1, "A a")], "doc_id bigint, text string"), f"{tmp_path}/cased.json")
    row = token_files.starts(token_files.read_all(files)).first()
    assert (row["n_tokens"], row["ids_crc32"]) == (3, zlib.crc32(np.array([2, 3, 1], "<u4").tobytes()))
