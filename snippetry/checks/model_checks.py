"""Labels, weights, decisions, evaluation, training, scoring, search and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from snippetry.checks.feature_checks import LINE_FEATURES
from snippetry.checks.registry import query, r6, rounded
from snippetry.checks.sql_text import LABELLED, LINE_COLUMNS, SNIPPETS, SPLIT, line_stats
from snippetry.functions.decisions import complement, correctness, decide
from snippetry.functions.lines import with_line_stats
from snippetry.operators.evaluation import classification_report, confusion_matrix, report_averages, roc_auc
from snippetry.operators.labels import LabelIndex, LabelTable, class_weights, positive_weight
from snippetry.operators.splitting import split_corpus
from snippetry.plans import scoring, training
from snippetry.plans.scoring import linear_score
from snippetry.plans.search import search_lr as run_search
from snippetry.session import staging_path, stage
from snippetry.sources.sinks import metrics_record
from snippetry.sources.tables import HUMAN, labelled_snippets, labels, snippets, stored_snippets, table
from snippetry.streaming.score_stream import read_scores, snippet_stream, start_scoring, start_scoring_once


@query("SELECT DISTINCT source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS DOUBLE) AS label_idx FROM documents")
def label_index(spark, folder):
    rows = snippets(spark, folder).withColumnRenamed("task_name", "label")
    return LabelTable.fit(rows).encode(rows.select("label")).distinct()


@query(f"WITH {LABELLED} SELECT snippet_id, CASE WHEN length(code) % 2 = 1 THEN 'Human_written' ELSE 'AI_generated' END AS decoded FROM labelled")
def label_decode(spark, folder):
    rows = labelled_snippets(spark, folder)
    index = LabelIndex.fit(rows)
    marked = rows.withColumn("idx", (F.length("code") % 2).cast("double"))
    return index.decoder("idx", "decoded").transform(marked).select("snippet_id", "decoded")


@query(f"""WITH {LABELLED}, c AS (SELECT count(*) FILTER (WHERE label = 'Human_written') AS pos,
    count(*) FILTER (WHERE label <> 'Human_written') AS neg FROM labelled)
SELECT pos, neg, round(neg / greatest(pos, 1), 6) AS scale_pos_weight, round(greatest(neg, 1) / greatest(pos, 1), 6) AS clamped_weight FROM c""")
def scale_pos_weight(spark, folder):
    rows = labelled_snippets(spark, folder)
    return rounded(positive_weight(LabelIndex.fit(rows).encode(rows)), "scale_pos_weight", "clamped_weight")


@query(f"""WITH {LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""", name="class_weights")
def class_weights_(spark, folder):
    return rounded(class_weights(labelled_snippets(spark, folder)), "weight")


def _scored(spark, folder):
    """A deterministic score with ties from the text length."""
    score = (F.length("code") % 101) / 100.0
    rows = snippets(spark, folder).join(labels(spark, folder), "snippet_id")
    return rows.select("snippet_id", "task_name", "label", score.alias("score"), (F.col("label") == HUMAN).cast("double").alias("y"))


SCORED = f"""{LABELLED}, scored AS (SELECT snippet_id, task_name, label, (length(code) % 101) / 100.0 AS score,
    CASE WHEN label = 'Human_written' THEN 1 ELSE 0 END AS y FROM labelled),
decided AS (SELECT *, CASE WHEN score >= 0.5 THEN 'Human_written' ELSE 'AI_generated' END AS pred_label FROM scored)"""


@query(f"""WITH {SCORED} SELECT snippet_id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS decision, round(CAST(score AS DOUBLE), 6) AS p_human,
    round(CAST(1 - score AS DOUBLE), 6) AS p_machine FROM scored""")
def threshold_decide(spark, folder):
    return _scored(spark, folder).select(
        "snippet_id", decide("score").alias("decision"), r6("score").alias("p_human"), r6(complement("score")).alias("p_machine")
    )


def _decided(spark, folder):
    rows = _scored(spark, folder)
    return rows.withColumn("pred_label", LabelIndex.fit(rows).decode_column(decide("score")))


@query(f"""WITH {SCORED} SELECT snippet_id, label, pred_label,
    CASE WHEN label = pred_label THEN 'CorrectPred' ELSE 'IncorrectPred' END AS correct FROM decided""")
def correct_flag(spark, folder):
    return _decided(spark, folder).select("snippet_id", "label", "pred_label", correctness("pred_label", "label").alias("correct"))


def _linear_sql():
    terms = " + ".join(f"({(i % 5 - 2) / 100}) * {c}" for i, c in enumerate(LINE_COLUMNS))
    return f"0.25 + {terms}"


@query(f"""WITH {SNIPPETS}, {line_stats("snippets")}, m AS (SELECT snippet_id, CAST({_linear_sql()} AS DOUBLE) AS margin FROM line_stats)
SELECT snippet_id, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS p FROM m""")
def score_linear_fixed_weights(spark, folder):
    weights = {c: (i % 5 - 2) / 100 for i, c in enumerate(LINE_FEATURES)}
    return rounded(linear_score(with_line_stats(snippets(spark, folder)), weights, 0.25, ["snippet_id"]), "margin", "p")


def _auc_sql(group: str | None) -> str:
    g, by = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    tail = f"GROUP BY {group}" if group else ""
    return f"""WITH {SCORED}, s AS (SELECT {g}score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY {g}score),
r AS (SELECT *, sum(neg) OVER ({by} ORDER BY score) - neg AS below FROM s)
SELECT {g}round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos,
    CAST(sum(neg) AS BIGINT) AS n_neg FROM r {tail}"""


@query(_auc_sql(None), name="roc_auc")
def roc_auc_(spark, folder):
    return rounded(roc_auc(_scored(spark, folder), "score", "y"), "auc")


@query(_auc_sql("task_name"))
def auc_by_group(spark, folder):
    return rounded(roc_auc(_scored(spark, folder), "score", "y", ["task_name"]), "auc")


def _matrix(spark, folder):
    rows = _decided(spark, folder)
    return stage(confusion_matrix(rows, "label", "pred_label", LabelIndex.fit(rows).classes), "confusion")


MATRIX = f"""{SCORED}, classes AS (SELECT DISTINCT label FROM labelled),
matrix AS (SELECT a.label AS truth, b.label AS predicted, count(d.snippet_id) AS n FROM classes a CROSS JOIN classes b
    LEFT JOIN decided d ON d.label = a.label AND d.pred_label = b.label GROUP BY a.label, b.label)"""


@query(f"WITH {MATRIX} SELECT * FROM matrix", name="confusion_matrix")
def confusion_matrix_(spark, folder):
    return _matrix(spark, folder)


REPORT = f"""{MATRIX}, sums AS (SELECT c.label, CAST(sum(n) FILTER (WHERE truth = c.label) AS BIGINT) AS support,
    sum(n) FILTER (WHERE predicted = c.label) AS guessed, sum(n) FILTER (WHERE truth = c.label AND predicted = c.label) AS hit
    FROM classes c CROSS JOIN matrix GROUP BY c.label),
report AS (SELECT label, coalesce(hit / nullif(guessed, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
    coalesce(2 * hit / nullif(guessed + support, 0), 0) AS f1, support FROM sums)"""


@query(f"WITH {REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report",
       name="classification_report")
def classification_report_(spark, folder):
    return rounded(classification_report(_matrix(spark, folder)), "precision", "recall", "f1")


@query(f"""WITH {REPORT}, rows AS (
SELECT 'accuracy' AS average, sum(recall * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
    sum(recall * support) / sum(support) AS f1, CAST(sum(support) AS BIGINT) AS support FROM report
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM report
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM report)
SELECT average, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rows""",
       name="report_averages")
def report_averages_(spark, folder):
    return rounded(report_averages(classification_report(_matrix(spark, folder))), "precision", "recall", "f1")


@query(f"""WITH {REPORT}, rows AS (
SELECT label AS name, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS idx, precision, recall, f1, support FROM report
UNION ALL SELECT 'accuracy', NULL, sum(recall * support) / sum(support), sum(recall * support) / sum(support),
    sum(recall * support) / sum(support), CAST(sum(support) AS BIGINT) FROM report
UNION ALL SELECT 'macro avg', NULL, avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM report
UNION ALL SELECT 'weighted avg', NULL, sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM report)
SELECT name, idx, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rows""", name="metrics_record")
def metrics_record_(spark, folder):
    """Report and averages as one run's record holds them."""
    classes = LabelIndex.fit(_decided(spark, folder)).classes
    matrix = _matrix(spark, folder)
    record = metrics_record(spark, None, classification_report(matrix), matrix, classes)
    report = record.select(F.inline("report")).withColumnsRenamed({"label": "name", "label_idx": "idx"})
    averages = record.select(F.inline("averages")).withColumnRenamed("average", "name").withColumn("idx", F.lit(None).cast("int"))
    return rounded(report.unionByName(averages), "precision", "recall", "f1")


def _parts(spark, folder, stored: bool = False):
    """Splits of the labelled documents, or of all stored vectors."""
    rows = split_corpus(stored_snippets(spark, folder) if stored else labelled_snippets(spark, folder))
    return {s: rows.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}


def _metrics(trained, test, family):
    """Flat view of the metrics row."""
    return scoring.evaluate(trained, test, family).select("auc", "classes", "cm", F.size("report").alias("n_classes"))


@query()
def train_lr(spark, folder):
    parts = _parts(spark, folder)
    return _metrics(training.train_lr(parts["train"]), parts["test"], "lr")


@query()
def train_gbt_tfidf(spark, folder):
    parts = _parts(spark, folder)
    return _metrics(training.train_gbt_tfidf(parts["train"], parts["validation"]), parts["test"], "gbt_tfidf")


@query()
def train_gbt_embed(spark, folder):
    parts = _parts(spark, folder, stored=True)
    trained = training.train_gbt_embedding(parts["train"], parts["validation"], text="stored")
    return _metrics(trained, parts["test"], "gbt_embedding")


@query()
def train_mlp(spark, folder):
    """Validation AUC per round, the round kept, and the test rows' AUC and accuracy with it."""
    parts = _parts(spark, folder, stored=True)
    trained = training.train_mlp(parts["train"], parts["validation"], text="stored")
    tested = scoring.evaluate(trained, parts["test"], "mlp").first()
    accuracy = next(a["f1"] for a in tested["averages"] if a["average"] == "accuracy")
    rows = [(epoch, auc, epoch == trained.rounds, tested["auc"], accuracy) for epoch, auc in trained.curve]
    return spark.createDataFrame(rows, "epoch int, auc double, kept boolean, test_auc double, test_accuracy double")


@query()
def early_stop_prefix(spark, folder):
    """Validation AUC of every tree prefix that was looked at."""
    parts = _parts(spark, folder, stored=True)
    trained = training.train_gbt_embedding(parts["train"], parts["validation"], text="stored")
    return spark.createDataFrame(trained.curve, "trees int, auc double").withColumn("chosen", F.col("trees") == trained.rounds)


@query()
def search_lr(spark, folder):
    return run_search(_parts(spark, folder)["train"])


@query()
def score_lr(spark, folder):
    parts = _parts(spark, folder)
    return scoring.score(training.train_lr(parts["train"]), snippets(spark, folder), "lr")


@query()
def score_gbt_tfidf(spark, folder):
    parts = _parts(spark, folder)
    return scoring.score(training.train_gbt_tfidf(parts["train"], parts["validation"]), snippets(spark, folder), "gbt_tfidf")


@query()
def score_gbt_embed(spark, folder):
    """Embeddings encoded from the text on both sides."""
    parts = _parts(spark, folder)
    trained = training.train_gbt_embedding(parts["train"], parts["validation"])
    return scoring.score(trained, snippets(spark, folder), "gbt_embedding")


@query()
def score_mlp(spark, folder):
    parts = _parts(spark, folder)
    trained = training.train_mlp(parts["train"], parts["validation"])
    return scoring.score(trained, snippets(spark, folder), "mlp")


@query()
def score_stream(spark, folder):
    """Documents arriving as a file stream, scored by the pipeline the batch job uses."""
    trained = training.train_lr(_parts(spark, folder)["train"])
    schema = table(spark, folder, "documents").schema
    arriving = snippet_stream(spark, f"{folder}/documents*.parquet", schema).select(
        F.col("doc_id").alias("snippet_id"), F.col("text").alias("code"), F.col("source").alias("task_name")
    )
    sink = staging_path(spark, "stream-scores")
    start_scoring(trained, arriving, sink, staging_path(spark, "stream-state"), both=True).awaitTermination()
    return spark.read.parquet(sink)


@query()
def score_stream_once(spark, folder):
    """The same through the sink that survives replays of a batch."""
    trained = training.train_lr(_parts(spark, folder)["train"])
    schema = table(spark, folder, "documents").schema
    arriving = snippet_stream(spark, f"{folder}/documents*.parquet", schema).select(
        F.col("doc_id").alias("snippet_id"), F.col("text").alias("code"), F.col("source").alias("task_name")
    )
    sink = staging_path(spark, "stream-scores")
    start_scoring_once(trained, arriving, sink, staging_path(spark, "stream-state"), "v1", both=True).awaitTermination()
    return read_scores(spark, sink).drop("stream")
