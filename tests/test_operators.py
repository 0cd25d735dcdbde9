"""Splits, n-grams, scaling, labels and evaluation against brute force on small data."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from snippetry.operators.bounded import join_checked
from snippetry.operators.embedding import embedding_dim
from snippetry.operators.evaluation import roc_auc
from snippetry.operators.labels import LabelIndex
from snippetry.operators.profiling import histogram
from snippetry.operators.scaling import ScalerModel, align, fit_scaler, scale
from snippetry.operators.splitting import assign_folds, split_corpus
from snippetry.operators.tfidf import CharTfidf, CharTfidfModel, char_grams, corpus_counts, top_grams


def grams(text, low=3, high=6):
    text = text.lower()
    return [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]


def test_split_quotas_with_a_dominant_label(spark):
    rows = [(i, "big" if i % 10 else "small" if i % 20 else None) for i in range(1001)]
    df = spark.createDataFrame(rows, "snippet_id long, label string")
    got = {r["snippet_id"]: r["split"] for r in split_corpus(df).collect()}
    for label in ("big", "small", None):
        ids = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i, x in rows if x == label)
        held = -(-len(ids) * 2 // 10)
        test = -(-held // 2)
        want = ["test"] * test + ["validation"] * (held - test) + ["train"] * (len(ids) - held)
        assert [got[i] for _, i in ids] == want
    again = {r["snippet_id"]: r["split"] for r in split_corpus(df.repartition(7)).collect()}
    assert again == got


def test_folds_are_even(spark):
    df = spark.range(103).select(F.col("id").alias("snippet_id"), (F.col("id") % 3).cast("string").alias("label"))
    sizes = assign_folds(df).groupBy("label", "fold").count().collect()
    assert len(sizes) == 15
    for label in "012":
        ns = [r["count"] for r in sizes if r["label"] == label]
        assert max(ns) - min(ns) <= 1


@pytest.mark.parametrize("text,n", [("", 0), ("ab", 0), ("abc", 1), ("abcdef", 10), ("a\U0001f600B\U0001f600cd\n", 14)])
def test_char_grams(spark, text, n):
    got = spark.createDataFrame([(text,)], "t string").select(char_grams("t").alias("g")).first()["g"]
    assert sorted(got) == sorted(grams(text)) and len(got) == n


def test_top_grams_break_ties_by_gram(spark):
    counts = spark.createDataFrame(
        [(chr(97 + i), c) for i, c in enumerate([5, 1, 1, 1, 200_000, 300_000, 5])], "gram string, cf long"
    )
    for k in range(1, 8):
        want = sorted((-r["cf"], r["gram"]) for r in counts.collect())[:k]
        assert [(-r["cf"], r["gram"]) for r in top_grams(counts, k).collect()] == want


def test_tfidf_matches_brute_force(spark):
    rng = random.Random(3)
    docs = ["".join(rng.choice("ab \U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [""]
    df = spark.createDataFrame(list(enumerate(docs)), "snippet_id long, code_clean string")
    cf, df_n = Counter(), Counter()
    for d in docs:
        cf.update(grams(d))
        df_n.update(set(grams(d)))
    assert {r["gram"]: r["cf"] for r in corpus_counts(df, "code_clean").collect()} == dict(cf)
    top = sorted(sorted(cf), key=lambda g: -cf[g])[:50]
    idf = {g: math.log((1 + len(docs)) / (1 + df_n[g])) + 1 for g in top}
    model, counted = CharTfidf("code_clean", (3, 6), 50).fit_counted(df)
    assert [(r[0], r[1], r[2], r[3]) for r in model.table] == [(g, i, cf[g], df_n[g]) for i, g in enumerate(sorted(top))]
    want = {}
    for i, d in enumerate(docs):
        w = {g: n * idf[g] for g, n in Counter(grams(d)).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, g): x / norm for g, x in w.items()})
    for rows in (model.weights(df, "snippet_id"), model.weights(counted, "snippet_id")):
        got = {(r["snippet_id"], r["gram"]): r["weight"] for r in rows.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert model.transform(df).count() == len(docs)
    rebuilt = CharTfidfModel.from_vocabulary(model.vocabulary(spark), model.n_docs)
    assert rebuilt.table == model.table


def test_scaler_population_std_and_constants(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "a double, b double")
    model = fit_scaler(df, ["a", "b"])
    assert model.table[0][2] == pytest.approx(1.247219, abs=1e-6)
    rows = scale(df, model, []).collect()
    assert [r["b"] for r in rows] == [0.0, 0.0, 0.0] and sum(r["a"] for r in rows) == pytest.approx(0)
    assert ScalerModel.from_table(model.table_df(spark)).table == model.table
    with pytest.raises(ValueError):
        scale(df, None, [])
    with pytest.raises(ValueError):
        model.check_width(["a"])


def test_scaler_fits_each_cell_once(spark, monkeypatch):
    asked = []
    own = fit_scaler.__globals__["F"].stddev_pop
    monkeypatch.setattr(fit_scaler.__globals__["F"], "stddev_pop", lambda c: asked.append(c) or own(c))
    names = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([tuple(float(i * k) for i in range(59)) + (None,) for k in range(4)], ", ".join(f"{n} double" for n in names))
    model = fit_scaler(df, names)
    # One pair of aggregates for all columns.
    assert len(asked) == 1 and model.names == names
    assert [x for _, *own in model.table[:3] for x in own] == pytest.approx([0, 0, 1.5, 1.25**0.5, 3, 2 * 1.25**0.5])
    assert model.table[59] == ("c59", 0.0, 0.0)
    assert fit_scaler(df.where("false"), ["c1"]).table == [("c1", 0.0, 0.0)]


def test_align(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, x double, y double")
    assert align(df, ["y", "z", "x"], ["id"]).first() == (1, 0.0, 0.0, 2.0)


def test_label_guards(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    index = LabelIndex.fit(df).require_two()
    assert index.classes == ["a", "b"] and index.position("b") == 1
    with pytest.raises(ValueError):
        index.position("c")
    with pytest.raises(ValueError):
        LabelIndex.fit(df.where("label = 'a'")).require_two()
    with pytest.raises(Exception, match="(?i)unseen label"):
        index.encode(spark.createDataFrame([("c",)], "label string")).collect()


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_and_hot_scores(spark):
    ties = list(zip([0.5, 0.5, 0.9, 0.1, 0.1], [0, 1, 1, 0, 1]))
    assert roc_auc(spark.createDataFrame(ties, "s double, y int"), "s", "y").first()["auc"] == pytest.approx(0.666667, abs=1e-6)
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert roc_auc(one, "s", "y").first()["auc"] is None
    rng = random.Random(5)
    rows = [(g, 0.5 if rng.random() < 0.4 else round(rng.random(), 3), rng.randint(0, 1)) for g in "ab" for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    want = {g: brute_auc([(s, y) for h, s, y in rows if h == g]) for g in "ab"}
    for limit in (4096, 10):
        got = {r["g"]: r["auc"] for r in roc_auc(df, "s", "y", ["g"], buckets=limit).collect()}
        assert got == pytest.approx(want)


def test_histogram_and_dim_edges(spark):
    same = spark.createDataFrame([(3,), (3,)], "v int")
    assert [(r["bin"], r["n"]) for r in histogram(same, "v").collect()] == [(0, 2)]
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(ValueError):
        embedding_dim(ragged)


def test_join_checked_leaves_large_sides_to_a_shuffle(spark):
    left, small = spark.range(20), spark.range(10).withColumn("x", F.lit(1))
    assert join_checked(left, small, "id", max_rows=5).count() == join_checked(left, small, "id").count() == 10


def test_rows_that_cannot_be_judged_are_errors(spark):
    from snippetry.operators.evaluation import confusion_matrix, roc_auc

    for rows in ([(None, 1)], [(float("nan"), 1)], [(0.5, 2)], [(0.5, None)]):
        df = spark.createDataFrame([(0.1, 0), (0.2, 1), *rows], "s double, y int")
        with pytest.raises(Exception, match="is not a number|neither 0 nor 1"):
            roc_auc(df, "s", "y").collect()
    for truth in ("c", None):
        df = spark.createDataFrame([("a", "a"), (truth, "b")], "t string, p string")
        with pytest.raises(Exception, match="not among the classes"):
            confusion_matrix(df, "t", "p", ["a", "b"]).collect()


def test_split_refuses_missing_and_repeated_ids(spark):
    from snippetry.operators.splitting import split_corpus

    good = [(i, "x") for i in range(20)]
    for rows in ([(None, "x")], [(3, "x")], [(None, None)]):
        with pytest.raises(ValueError, match="unique"):
            split_corpus(spark.createDataFrame(good + rows, "snippet_id long, label string"))


def test_training_takes_exactly_two_classes():
    from snippetry.operators.labels import LabelIndex

    for classes in (["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError, match="exactly two"):
            LabelIndex(classes).require_two()


def test_label_table_numbers_any_number_of_classes(spark):
    from snippetry.operators.labels import LabelTable

    names = F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 7, "0"))
    rows = spark.range(1_000_000).select(names.alias("label"), F.col("id"))
    index = LabelTable.fit(rows)
    assert index.table.count() == 1_000_000
    assert index.table.where("label_idx <> CAST(substr(label, 2) AS DOUBLE)").count() == 0
    some = rows.where("id % 1000 = 7").withColumn("label_idx", F.lit("old"))
    back = index.decode(index.encode(some), "label_idx", "again")
    assert back.count() == 1000 and back.where("NOT (label <=> again) OR label_idx <> id").count() == 0


def test_label_table_refuses_unseen_labels(spark):
    from snippetry.operators.labels import LabelTable

    index = LabelTable.fit(spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "label string"))
    assert sorted(map(tuple, index.table.collect())) == [("a", 0.0), ("b", 1.0)]
    for wrong in ("c", None):
        with pytest.raises(Exception, match="unknown label"):
            index.encode(spark.createDataFrame([("a",), (wrong,)], "label string")).collect()
    assert index.encode(spark.createDataFrame([], "label string")).count() == 0
