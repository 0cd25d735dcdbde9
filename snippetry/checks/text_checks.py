"""Sources, cleaning, line statistics, splits, exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from snippetry.checks.registry import query, rounded
from snippetry.checks.sql_text import (
    COLLAPSED, LABELLED, LINE_COLUMNS, NEWLINES, PERTURBED, SNIPPETS, SPLIT, WS, line_stats,
)
from snippetry.functions.lines import INDENT_STATS, LINE_STATS, with_line_stats
from snippetry.functions.text import collapse_whitespace, normalise_newlines, rstrip_lines, split_lines
from snippetry.operators import profiling
from snippetry.operators.splitting import assign_folds, split_corpus
from snippetry.session import staging_path
from snippetry.sources.corpus import read_csv
from snippetry.sources.csv_blocks import read_csv_blocks
from snippetry.sources.sinks import write_csv
from snippetry.sources.tables import labelled_snippets, perturbed_snippets, snippets
from snippetry.schemas import CORPUS


def _r(names, prefix=""):
    return ", ".join(f"round(CAST({prefix}{c} AS DOUBLE), 6) AS {c}" for c in names)


@query(f"WITH {LABELLED} SELECT snippet_id, code, label, task_name FROM labelled")
def src_corpus(spark, folder):
    return labelled_snippets(spark, folder)


@query("SELECT doc_id AS snippet_id, text AS code, 'x' AS label, source AS task_name FROM documents")
def csv_roundtrip(spark, folder):
    path = staging_path(spark, "csv")
    write_csv(snippets(spark, folder).select("snippet_id", "code", F.lit("x").alias("label"), "task_name"), path)
    return read_csv(spark, path, CORPUS)


@query("SELECT doc_id AS snippet_id, text AS code, 'x' AS label, source AS task_name FROM documents")
def csv_blocks_roundtrip(spark, folder):
    """The same through the reader that cuts files into blocks."""
    path = staging_path(spark, "csv")
    write_csv(snippets(spark, folder).select("snippet_id", "code", F.lit("x").alias("label"), "task_name"), path)
    return read_csv_blocks(spark, path, CORPUS)


@query(f"WITH {PERTURBED} SELECT snippet_id, {COLLAPSED} AS code_clean FROM perturbed")
def clean_collapse_ws(spark, folder):
    return perturbed_snippets(spark, folder).select("snippet_id", collapse_whitespace("code").alias("code_clean"))


@query(f"""WITH {PERTURBED} SELECT snippet_id, array_to_string(list_transform(string_split({NEWLINES}, chr(10)),
    lambda x: regexp_replace(x, '[{WS}]+$', '')), chr(10)) AS code_clean FROM perturbed""")
def clean_rstrip_lines(spark, folder):
    return perturbed_snippets(spark, folder).select("snippet_id", rstrip_lines("code").alias("code_clean"))


@query(f"WITH {PERTURBED} SELECT snippet_id, {NEWLINES} AS code_clean FROM perturbed")
def clean_newlines(spark, folder):
    return perturbed_snippets(spark, folder).select("snippet_id", normalise_newlines("code").alias("code_clean"))


@query(f"""WITH {PERTURBED}, ls AS (SELECT snippet_id, string_split({NEWLINES}, chr(10)) AS ls FROM perturbed)
SELECT snippet_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM ls""")
def lines_exploded(spark, folder):
    lines = split_lines(normalise_newlines("code"))
    return perturbed_snippets(spark, folder).select("snippet_id", F.posexplode_outer(lines).alias("line_no", "line")).select(
        "snippet_id", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


@query(f"WITH {PERTURBED}, {line_stats('perturbed')} SELECT snippet_id, {_r(LINE_COLUMNS[:6])} FROM line_stats")
def feat_line_stats(spark, folder):
    stats = with_line_stats(perturbed_snippets(spark, folder).select("snippet_id", "code"))
    return rounded(stats.select("snippet_id", *LINE_STATS), *LINE_STATS)


@query(f"WITH {PERTURBED}, {line_stats('perturbed')} SELECT snippet_id, {_r(LINE_COLUMNS[6:])} FROM line_stats")
def feat_indent_stats(spark, folder):
    stats = with_line_stats(perturbed_snippets(spark, folder).select("snippet_id", "code"))
    return rounded(stats.select("snippet_id", *INDENT_STATS), *INDENT_STATS)


@query(f"WITH {SPLIT} SELECT snippet_id, label, split FROM splitted")
def split_stratified(spark, folder):
    return split_corpus(labelled_snippets(spark, folder)).select("snippet_id", "label", "split")


@query(f"""WITH {LABELLED}, ranked AS (SELECT snippet_id, label, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(snippet_id AS VARCHAR), ':42')), snippet_id) AS rn FROM labelled)
SELECT snippet_id, label, CAST((rn > n * 1 // 5)::INT + (rn > n * 2 // 5)::INT + (rn > n * 3 // 5)::INT + (rn > n * 4 // 5)::INT AS INT) AS fold
FROM ranked""")
def cv_folds(spark, folder):
    return assign_folds(labelled_snippets(spark, folder)).select("snippet_id", "label", "fold")


FLAGSHIP_SQL = f"""WITH {SPLIT}, {line_stats('splitted')}
SELECT split, label, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}" for c in LINE_COLUMNS)}
FROM splitted JOIN line_stats USING (snippet_id) GROUP BY split, label"""


@query(FLAGSHIP_SQL)
def split_feature_means(spark, folder):
    """Label join, line statistics, stratified split, then means per split and label."""
    stats = with_line_stats(split_corpus(labelled_snippets(spark, folder)))
    names = [*LINE_STATS, *INDENT_STATS]
    means = [F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in names]
    return stats.groupBy("split", "label").agg(F.count("*").alias("n"), *means)


@query(f"WITH {SPLIT} SELECT split, count(*) AS n_rows, 4 AS n_cols FROM splitted GROUP BY split")
def eda_shapes(spark, folder):
    return profiling.shapes(split_corpus(labelled_snippets(spark, folder)))


@query(f"WITH {SNIPPETS} SELECT * FROM snippets ORDER BY snippet_id LIMIT 5")
def eda_head(spark, folder):
    return profiling.head(snippets(spark, folder))


@query(f"WITH {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label")
def eda_class_balance(spark, folder):
    return profiling.class_balance(labelled_snippets(spark, folder))


@query(f"WITH {SNIPPETS} SELECT snippet_id, length(code) AS char_len FROM snippets")
def eda_char_len(spark, folder):
    return profiling.char_lengths(snippets(spark, folder)).select("snippet_id", "char_len")


@query(f"""WITH {SNIPPETS}, x AS (SELECT CAST(length(code) AS DOUBLE) AS v FROM snippets),
b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM x),
c AS (SELECT least(floor((v - lo) / w), 49) AS bin, count(*) AS n FROM x, b GROUP BY 1)
SELECT CAST(r.bin AS BIGINT) AS bin, round(lo + r.bin * w, 6) AS lo, round(lo + (r.bin + 1) * w, 6) AS hi, coalesce(c.n, 0) AS n
FROM (SELECT unnest(range(50)) AS bin) r CROSS JOIN b LEFT JOIN c ON c.bin = r.bin""")
def eda_length_histogram(spark, folder):
    return rounded(profiling.histogram(profiling.char_lengths(snippets(spark, folder)), "char_len"), "lo", "hi")


@query(f"""WITH {SNIPPETS},
a AS (SELECT 'shortest' AS which, snippet_id, length(code) AS char_len, code FROM snippets ORDER BY char_len, snippet_id LIMIT 1),
b AS (SELECT 'longest' AS which, snippet_id, length(code) AS char_len, left(code, 300) AS code FROM snippets
    ORDER BY char_len DESC, snippet_id LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def eda_extremes(spark, folder):
    return profiling.extremes(snippets(spark, folder))
