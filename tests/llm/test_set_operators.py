import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest

from snippetry.llm import count_tree, jaccard_join, mixing, queries, repeated_bytes


def components(spark, given, shingle, percent, **options):
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    got = jaccard_join.components(docs, shingle, percent)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)


def near_groups():
    """Copies that drift apart: chains, stars, texts just above and below the threshold."""
    texts = []
    for g in range(6):
        base = fx.text(g, 30 + 60 * g)
        texts += [base, base] + [fx.edited(base, 100 * g + i, 1 + i % 5) for i in range(12)]
        for i in range(6):
            texts.append(fx.edited(texts[-1], 7 * g + i, 1))
    return texts


@pytest.mark.parametrize("shingle, percent", [(3, 90), (5, 80), (1, 50)])
def test_components_match_brute_force(spark, shingle, percent):
    given = list(enumerate(near_groups()))
    want = fx.brute_components(given, shingle, percent)
    assert [(c, n) for _, n, c in sorted(components(spark, given, shingle, percent))] == [(c, len(fx.shingles(t, shingle))) for c, (_, t) in zip(want, given)]


def test_components_of_odd_rows(spark):
    given = [(r[0], r[1]) for r in fx.odd_rows()]
    want = fx.brute_components(given, 3, 90)
    assert components(spark, given, 3, 90) == sorted(((i, len(fx.shingles(t, 3)), c) for (i, t), c in zip(given, want)), key=repr)
    assert components(spark, [], 3, 90) == []
    kept = jaccard_join.one_of_each(fx.documents(spark), 3, 90)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)[:5] and kept.columns == fx.documents(spark).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12]


def test_every_link_shares_a_block():
    rnd = np.random.default_rng(5)
    for percent in (50, 80, 90, 95):
        blocks = jaccard_join.Blocks(percent)
        for _ in range(200):
            n = int(rnd.integers(2, 400)) if rnd.random() < 0.8 else int(rnd.integers(400, 5000))
            a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a[rnd.random(len(a)) > (100 - percent) / 150]
            b = np.unique(np.concatenate([b, rnd.integers(0, 1 << 63, int(rnd.integers(0, max(n // 20, 1) + 1)), dtype=np.uint64)]))
            if len(b) and count_tree.similar(a, b, percent) and len(np.setxor1d(a, b)):
                (x, left_a), (y, left_b) = blocks.of(a), blocks.of(b)
                shared = np.intersect1d(x, y).size
                assert shared
                if min(len(a), len(b)) >= blocks.smallest:
                    assert shared >= blocks.least_shared(np.array([len(a)]), np.array([len(b)]), np.array([max(left_a, left_b)]))[0]


def test_no_link_is_below_the_fewest_blocks():
    rnd = np.random.default_rng(6)
    seen = 0
    for percent in (50, 80, 90, 95):
        blocks = jaccard_join.Blocks(percent)
        for _ in range(300):
            a = np.unique(rnd.integers(0, 1 << 63, int(rnd.integers(2, 1500)), dtype=np.uint64))
            cut = int(rnd.integers(0, len(a) * (100 - percent) // 100 + 1))
            b = np.unique(np.concatenate([a[cut:], rnd.integers(0, 1 << 63, int(rnd.integers(0, cut // 2 + 2)), dtype=np.uint64)]))
            if min(len(a), len(b)) >= blocks.smallest and count_tree.similar(a, b, percent) and len(np.setxor1d(a, b)):
                (x, left_a), (y, left_b) = blocks.of(a), blocks.of(b)
                shared = np.intersect1d(x, y).size
                assert shared >= max(blocks.bounds(a)[0], blocks.bounds(b)[0])
                assert (left_a, left_b) == (blocks.bounds(a)[1], blocks.bounds(b)[1])
                seen += blocks.bounds(a)[0] > 1
    assert seen > 200


def test_texts_that_share_a_passage_only_are_not_looked_at(spark, monkeypatch):
    """They share blocks, but fewer than near copies must: their sets are never made."""
    wanted, made = [], jaccard_join._sets_of
    monkeypatch.setattr(jaccard_join, "_sets_of", lambda docs, nodes, *more: wanted.append(nodes.count()) or made(docs, nodes, *more))
    passage = fx.text(77, 40)
    texts = [fx.text(1000 + i, 300) + " " + passage for i in range(12)]
    texts.append(fx.edited(texts[0], 5, 2))
    got = components(spark, list(enumerate(texts)), 5, 80)
    assert [c for _, _, c in sorted(got)] == [*range(12), 0]
    assert wanted == [2]


@pytest.mark.parametrize("chunk, bucket", [(40, 30), (10_000, 1_000_000)])
def test_shared_blocks_are_all_found(spark, chunk, bucket):
    """Whatever the chunks and buckets, exactly the blocks of two sets or more come back, with all their members."""
    given = list(enumerate(dict.fromkeys(near_groups()[:40])))
    docs = spark.createDataFrame(given + given[:5], "doc_id bigint, text string").selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    got = {(r["key"], r["short"]) for r in jaccard_join.shared_blocks(docs, 5_000, 3, 90, chunk, bucket).collect()}
    rows = jaccard_join.sets(docs, 3).select("doc_id", jaccard_join.short_digest("digest").alias("short")).collect()
    short = {r["doc_id"]: r["short"] for r in rows}
    blocks, members = jaccard_join.Blocks(90), {}
    for i, text in given:
        (words,) = jaccard_join.word_hashes([text.lower().encode().split()])
        for key in blocks.of(jaccard_join.shingle_set(words, 3))[0] >> np.uint64(16):
            members.setdefault(int(key), set()).add(short[i])
    assert got == {(key, i) for key, of in members.items() if len(of) > 1 for i in of}
    assert len(got) > 100


def test_tree_finds_all_within_the_bound():
    rnd = np.random.default_rng(3)
    bases = [rnd.integers(0, 1 << 63, 120, dtype=np.uint64) for _ in range(9)]
    sets = [np.unique(np.concatenate([b[: 120 - k], rnd.integers(0, 1 << 63, k, dtype=np.uint64)])) for b in bases for k in range(0, 30, 2)]
    points = np.array([count_tree.point(s) for s in sets])
    tree = count_tree.CountTree(points, np.array(list(map(len, sets))))
    for s, p in zip(sets, points):
        near = set(tree.near(p, len(s), 80).tolist())
        assert {i for i, t in enumerate(sets) if count_tree.similar(s, t, 80)} <= near < set(range(len(sets)))
    members = [(i, i, s, p) for i, (s, p) in enumerate(zip(sets, points))]
    whole = count_tree.Union()
    for a, b in [*count_tree.links(members[:60], None, 80), *count_tree.links(members[60:], None, 80), *count_tree.links(members[:60], members[60:], 80)]:
        whole.join(a, b)
    for i, s in enumerate(sets):
        assert all(whole.root(i) == whole.root(j) for j, t in enumerate(sets) if count_tree.similar(s, t, 80))


def test_leaves_join_what_the_first_round_leaves(spark, monkeypatch):
    """With leaves of two members all of the tree's ways are taken."""
    monkeypatch.setattr(jaccard_join.links, "__defaults__", (2, 1))
    given = list(enumerate(near_groups()))
    assert [c for _, _, c in sorted(components(spark, given, 3, 90))] == fx.brute_components(given, 3, 90)


# --- repeated bytes


def removed(spark, texts, length, **options):
    got = {r["doc_id"]: r for r in repeated_bytes.remove_repeated(fx.of_texts(spark, texts), length, **options).collect()}
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in (got[i] for i in range(len(texts)))]


@pytest.mark.parametrize("length, crowd", [(40, 20_000), (41, 0), (100, 3)])
def test_repeats_match_brute_force(spark, length, crowd):
    base = fx.text(1, 60)
    texts = [base, base[10:] + "q" + base[:90], fx.edited(base, 3, 3), "é" * 120 + "a", "ab" * 70, "x" * 39, "x" * 41, None, "", base[:150] + fx.text(9, 20) + base[100:], fx.text(5, 40)]
    texts += [fx.edited(base, i, 2) for i in range(12)] + [base]
    assert removed(spark, texts, length, crowd=crowd) == fx.brute_repeats(texts, length)


def test_blocks_of_long_texts_meet(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "BLOCK", 64)
    base = fx.text(1, 120)
    texts = [base + fx.text(2, 50), fx.text(3, 33) + base, base[200:500] * 2]
    assert removed(spark, texts, 40) == fx.brute_repeats(texts, 40)


def test_repeats_of_odd_rows(spark):
    docs = fx.documents(spark)
    got = repeated_bytes.remove_repeated(docs, 400)
    want = fx.brute_repeats([r["text"] for r in docs.collect()], 400)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()) == sorted(w[:3] for w in want)
    assert repeated_bytes.remove_repeated(docs.where("false")).count() == 0


def test_given_table_matches_brute_force(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = dict(zip(texts, fx.brute_repeats(list(texts.values()), 400)))
    for r in queries.op10_repeated_bytes(spark, folder).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == want[r["doc_id"]][:3]


# --- mixing


def test_mix_meets_its_targets(spark):
    given = [(i, fx.text(i, 1 + i % 90), None, f"s{i % 7}" if i % 3 else "big", 0) for i in range(3000)] + [(None, "a b", None, None, 0), (None, None, None, None, 0), (5, "", None, "s1", 0)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, size bigint")
    got = mixing.mix(docs).collect()
    assert len(got) == len(given)
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len(fx.WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    live, left, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    while True:
        share = {s: left * w / sum(live.values()) for s, w in live.items()}
        over = [s for s in share if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            del live[s]
    want |= share
    assert target == pytest.approx(want) and all(abs(taken[s] - want[s]) <= 46 for s in order)
    again = {(r["doc_id"], r["text"]): r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["taken"] for r in got)
    assert mixing.sampled(docs).count() == sum(r["copies"] for r in got) and mixing.sampled(docs).columns == docs.columns


def test_mix_of_odd_and_empty_tables(spark):
    docs = fx.documents(spark)
    assert mixing.mix(docs).count() == docs.count() and set(docs.columns) <= set(mixing.mix(docs).columns)
    assert mixing.mix(docs.where("false")).count() == 0
    blank = mixing.mix(docs.where("text IS NULL"))
    assert {(r["size"], r["taken"]) for r in blank.collect()} == {(0, 0)}


def test_weights_make_documents_likelier(spark):
    from pyspark.sql import functions as F

    docs = fx.of_texts(spark, ["a b c"] * 4000, "only").withColumn("w", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    got = mixing.mix(docs, percent=40, cap=1, weight=F.col("w"))
    even, odd = (got.where(f"doc_id % 2 = {k} AND taken > 0").count() for k in (0, 1))
    assert 1200 < even and odd < 500 and abs(even + odd - 1600) <= 1


def test_dealt_sets_go_before_their_keys_are_ordered(monkeypatch):
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        groupBy = applyInArrow = select

    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(jaccard_join, "TaskContext", Task)
    texts = [" ".join(f"w{i}_{k}" for k in range(60)) for i in range(200)]
    docs = jaccard_join.shared_blocks(Docs(), 10_000, 5, 80, chunk=500)
    dealt = docs.run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert next(dealt).num_rows and not dealt.gi_frame.f_locals["held"]
