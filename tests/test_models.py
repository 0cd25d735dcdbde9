"""Training, saving, scoring, search, streaming and sinks."""

import datetime
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from snippetry.checks import model_checks
from snippetry.checks.registry import QUERIES
from snippetry.operators.splitting import split_corpus
from snippetry.plans import jobs, training
from snippetry.plans.scoring import evaluate, score
from snippetry.plans.search import search_best, search_space
from snippetry.sources.corpus import read_csv, read_json, require_columns, with_content_id
from snippetry.sources.sinks import load_model, save_model, write_csv, write_features, write_metrics
from snippetry.sources.tables import HUMAN, MACHINE
from snippetry.streaming.score_stream import read_scores, snippet_stream, start_scoring, start_scoring_once


@pytest.fixture(scope="module")
def corpus(spark):
    """Two clearly different styles of code, one per label."""
    rows = []
    for i in range(120):
        if i % 3:
            rows.append((i, f"def run_{i}(x):\n    for v in x:\n        print(v + {i})\n    return x\n", HUMAN, "t1"))
        else:
            rows.append((i, f"class Value{i}:\n    MAX = {i}\n    items = [q for q in range({i})]\n", MACHINE, "t2"))
    df = spark.createDataFrame(rows, "snippet_id long, code string, label string, task_name string")
    return split_corpus(df)


@pytest.fixture(scope="module")
def parts(corpus):
    return [corpus.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")]


@pytest.fixture(scope="module")
def lr(parts):
    return training.train_lr(parts[0], max_features=100)


def test_lr_separates_and_reports(lr, parts):
    row = evaluate(lr, parts[2], "lr").first()
    assert row["auc"] == 1.0 and row["classes"] == [MACHINE, HUMAN]
    assert sum(map(sum, row["cm"])) == parts[2].count()
    assert [(r["label"], r["label_idx"]) for r in row["report"]] == [(c, i) for i, c in enumerate(row["classes"])]
    assert [(a["average"], a["f1"]) for a in row["averages"]] == [(n, 1.0) for n in ("accuracy", "macro avg", "weighted avg")] and row["run_date"] == datetime.date.today()


def test_scores_columns_and_threshold(lr, parts):
    rows = score(lr, parts[2], "lr")
    assert rows.columns == ["snippet_id", "task_name", "pred_label", "prob_human", "true_label", "correct"]
    assert all((r["prob_human"] >= 0.5) == (r["pred_label"] == HUMAN) for r in rows.collect())
    assert all(r["prob_human"] + r["prob_other"] == 1 for r in score(lr, parts[2], "lr", both=True).collect())
    assert score(lr, parts[2].drop("label", "task_name"), "lr").columns == ["snippet_id", "pred_label", "prob_human"]
    assert score(lr, parts[2], "lr", clean="rstrip").count() == parts[2].count()
    with pytest.raises(KeyError):
        score(lr, parts[2].drop("code"), "lr")
    with pytest.raises(ValueError):
        score(lr, parts[2], "lr", positive="nobody")


def test_save_and_load_give_the_same_scores(spark, lr, parts):
    path = tempfile.mkdtemp(prefix="snippetry-model-")
    save_model(spark, lr, path)
    again = load_model(spark, path)
    twice = tempfile.mkdtemp(prefix="snippetry-model-")
    save_model(spark, again, twice)
    for name in ("labels", "scaler", "vocabulary", "state"):
        first, second = (sorted(map(str, spark.read.parquet(f"{p}/{name}").collect())) for p in (path, twice))
        assert first == second and first
    assert again.scaler.table == lr.scaler.table and again.tfidf.table == lr.tfidf.table and again.tfidf.n_docs == lr.tfidf.n_docs
    a = score(lr, parts[2], "lr").orderBy("snippet_id").collect()
    assert a == score(again, parts[2], "lr").orderBy("snippet_id").collect()
    assert spark.read.parquet(f"{path}/scaler").count() == 44 and spark.read.parquet(f"{path}/vocabulary").count() == 100


def test_stream_equals_batch(spark, lr, parts):
    root = tempfile.mkdtemp(prefix="snippetry-stream-")
    parts[2].repartition(3).write.parquet(f"{root}/in")
    stream = snippet_stream(spark, f"{root}/in", parts[2].schema, files_per_trigger=1)
    start_scoring(lr, stream, f"{root}/out", f"{root}/state").awaitTermination()
    got = spark.read.parquet(f"{root}/out").orderBy("snippet_id").collect()
    assert got == score(lr, parts[2], "lr").orderBy("snippet_id").collect()


def test_replayed_batches_give_their_rows_once(spark, lr, parts):
    """The last batch is scored again after its commit is lost; a second stream on the same sink adds rows and replaces none."""
    root = tempfile.mkdtemp(prefix="snippetry-once-")
    parts[2].repartition(3).write.parquet(f"{root}/in")
    want = score(lr, parts[2], "lr").orderBy("snippet_id").collect()

    def run(state):
        stream = snippet_stream(spark, f"{root}/in", parts[2].schema, files_per_trigger=1)
        query = start_scoring_once(lr, stream, f"{root}/out", f"{root}/{state}", "v1")
        query.awaitTermination()
        return [p["batchId"] for p in query.recentProgress if p["numInputRows"]]

    def got():
        scores = read_scores(spark, f"{root}/out")
        return scores.select(*want[0].__fields__, "stream", "batch", "model_version").orderBy("snippet_id", "stream").collect()

    first = run("state")
    assert [r[: len(want[0])] for r in got()] == [tuple(r) for r in want]
    assert {(r["batch"], r["model_version"]) for r in got()} == {(b, "v1") for b in first}
    before = got()
    for name in (f"{max(first)}", f".{max(first)}.crc"):
        os.remove(f"{root}/state/commits/{name}")
    assert run("state") == [max(first)]
    assert got() == before
    run("other")
    assert len(got()) == 2 * len(want)
    with pytest.raises(ValueError, match="cannot name"):
        start_scoring_once(lr, parts[2], root, root, "a/b")


def test_boosted_trees_with_early_stopping(parts):
    trained = training.train_gbt_tfidf(parts[0], parts[1], rounds=5, patience=2, depth=2, max_features=50)
    assert 1 <= trained.rounds <= 5
    best = max(a for _, a in trained.curve)
    assert trained.curve[trained.rounds - 1][1] == best
    assert len(trained.pipeline.stages[-1].trees) == trained.rounds
    assert evaluate(trained, parts[2], "gbt_tfidf").first()["auc"] == 1.0


def test_early_stop_curve_matches_model_margins(parts):
    """The AUC at the full tree count is that of the model's own probability."""
    from pyspark.ml.functions import vector_to_array

    from snippetry.operators.evaluation import auc_value
    from snippetry.operators.labels import LabelIndex

    trained = training.train_gbt_tfidf(parts[0], None, rounds=3, depth=1, max_features=20)
    rows = trained.labels.encode(parts[1])
    scored = trained.pipeline.transform(rows)
    whole = auc_value(scored.withColumn("p", vector_to_array("probability")[1]), "p", "label_idx")
    _, curve = training.best_prefix(trained.pipeline.stages[-1], scored.select("features", "label_idx"), 2)
    assert LabelIndex.fit(parts[0]).classes == trained.labels.classes
    if len(curve) == 3:
        assert curve[-1][1] == pytest.approx(whole)


def test_fewer_rounds_give_the_first_trees_of_more(parts):
    small, large = (training.train_gbt_tfidf(parts[0], None, rounds=n, depth=2, max_features=30).pipeline.stages[-1] for n in (2, 5))
    assert [t.toDebugString for t in small.trees] and small.treeWeights == large.treeWeights[:2]
    bodies = [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in (small, large)]
    assert bodies[0] == bodies[1][:2]


def test_a_cut_ensemble_scores_as_its_curve_says(spark, parts):
    """On labels that trees cannot learn at once: the cut model's AUC is the curve's at its number of trees, also when loaded."""
    from pyspark.ml.functions import vector_to_array

    from snippetry.operators.evaluation import auc_value

    mixed = [p.withColumn("label", F.when(F.xxhash64("snippet_id") % 4 == 0, MACHINE).otherwise(F.col("label"))) for p in parts]
    trained = training.train_gbt_tfidf(mixed[0], mixed[1], rounds=12, patience=4, depth=2, max_features=40)
    model = trained.pipeline.stages[-1]
    assert len(model.trees) == len(model.treeWeights) == trained.rounds < 12
    rows = trained.labels.encode(mixed[1])
    whole = auc_value(trained.pipeline.transform(rows).withColumn("p", vector_to_array("probability")[1]), "p", "label_idx")
    assert whole == pytest.approx(dict(trained.curve)[trained.rounds])
    path = tempfile.mkdtemp(prefix="snippetry-cut-")
    save_model(spark, trained, path)
    again = load_model(spark, path)
    assert again.rounds == trained.rounds and again.curve == [tuple(p) for p in trained.curve]
    assert score(again, parts[2], "gbt_tfidf").collect() == score(trained, parts[2], "gbt_tfidf").collect()


def test_few_rows_are_packed(parts):
    rows = training.fit_features(parts[0], max_features=50).training_rows(training.LabelIndex.fit(parts[0])).repartition(9)
    assert training.packed(rows).rdd.getNumPartitions() == 1
    assert training.packed(rows, part_bytes=4000).rdd.getNumPartitions() == 9


def test_embedding_families(parts):
    gbt = training.train_gbt_embedding(parts[0], rounds=2, depth=2)
    assert "prob_positive" in score(gbt, parts[2], "gbt_embedding").columns
    mlp = training.train_mlp(parts[0], parts[1], hidden=(8, 4), epochs=2, steps_per_epoch=5)
    assert len(mlp.curve) == 2
    assert score(mlp, parts[2], "mlp").columns == ["snippet_id", "pred", "prob_human", "true", "correct"]


def test_search(parts):
    assert len(search_space()) == len(set(search_space())) == 200
    assert search_space()[0][0] == pytest.approx(0.1) and search_space()[-1][0] == pytest.approx(10)
    board, best = search_best(parts[0], draws=2, folds=2, max_iter=10, max_features=20)
    board = board.collect()
    learner = best.pipeline.stages[-1]
    assert learner.getTol() == board[0]["tol"] and learner.getWeightCol() == f"w_{board[0]['weighting']}"
    assert evaluate(best, parts[2], "lr").first()["auc"] == 1.0
    assert [r["rank"] for r in board] == [1, 2] and board[0]["mean_auc"] >= board[1]["mean_auc"]


def test_jobs(corpus):
    model, vectors = jobs.build_tfidf(corpus, max_features=30)
    assert vectors.count() == 120 and len(model.table) == 30
    assert jobs.build_embeddings(corpus).columns == ["snippet_id", "split", "label", "embedding"]
    with pytest.raises(KeyError):
        jobs.build_splits(corpus.drop("label"))


def test_csv_json_and_feature_sinks(spark, corpus):
    root = tempfile.mkdtemp(prefix="snippetry-io-")
    cells = ['  lead, "quoted"\r\nline\n\ttail  ', "a,b", 'x""y', "NA", "None", "plain\\"]
    df = spark.createDataFrame([(i, c, "l", "t") for i, c in enumerate(cells)], "snippet_id long, code string, label string, task_name string")
    write_csv(df, f"{root}/csv")
    back = {r["snippet_id"]: r["code"] for r in read_csv(spark, f"{root}/csv").collect()}
    assert back == {i: None if c in ("NA", "None") else c for i, c in enumerate(cells)}
    df.write.json(f"{root}/json")
    assert {r["code"] for r in read_json(spark, f"{root}/json").collect()} == set(cells)
    write_features(jobs.build_code_features(corpus), f"{root}/feats")
    assert spark.read.parquet(f"{root}/feats").where("split = 'test'").count() > 0
    with pytest.raises(KeyError):
        require_columns(df, "code", "missing")


def test_metrics_sink_appends(spark, lr, parts):
    root = tempfile.mkdtemp(prefix="snippetry-metrics-")
    for _ in range(2):
        write_metrics(evaluate(lr, parts[2]), f"{root}/m")
    rows = spark.read.json(f"{root}/m").collect()
    assert len(rows) == 2 and rows[0]["run_date"] == datetime.date.today().strftime("%d-%m-%Y")


def test_content_ids(spark):
    df = spark.createDataFrame([("a", None)] * 7 + [("b", "x"), (None, "x"), ("", "x")], "code string, label string")
    rows = with_content_id(df, chunk=3).collect()
    assert len({r["snippet_id"] for r in rows}) == len(rows) == 10
    again = with_content_id(df.repartition(5), chunk=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


@pytest.mark.parametrize("name", ["train_lr", "train_gbt_tfidf", "train_gbt_embed", "early_stop_prefix", "search_lr", "score_lr",
                                  "score_gbt_tfidf", "score_gbt_embed", "score_stream", "score_stream_once"])
def test_registered_jobs_run_with_the_defaults(spark, folder, monkeypatch, name):
    class Called(Exception):
        pass

    def called(*_, **options):
        raise Called(options)

    for job in ("train_lr", "train_gbt_tfidf", "train_gbt_embedding"):
        monkeypatch.setattr(training, job, called)
    monkeypatch.setattr(model_checks, "run_search", called)
    with pytest.raises(Called) as seen:
        QUERIES[name](spark, folder)
    assert set(seen.value.args[0]) <= {"text"}


def test_stored_vectors_are_stacked_on_dense_features(spark, folder):
    train = model_checks._parts(spark, folder, stored=True)["train"]
    fitted = training.fit_features(train, "stored")
    assert fitted.training_rows(training.LabelIndex.fit(train)).count() == train.count()
    assert fitted.rows(train, training.LabelIndex.fit(train)).first()["features"].size == 64 + 44
