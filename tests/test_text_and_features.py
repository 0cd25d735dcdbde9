"""Adversarial snippets against values worked out independently."""

import pytest
from pyspark.sql import functions as F

from snippetry.checks import feature_checks
from snippetry.checks.registry import ORACLES, QUERIES
from snippetry.functions.text import collapse_whitespace, normalise_newlines, rstrip_lines
from snippetry.operators.code_features import FEATURES, with_code_features
from snippetry.operators.syntax_facts import facts_of, with_syntax_facts

BLANKS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
TEXTS = [
    None, "", "   ", "a" + "b".join(BLANKS) + "c", BLANKS, "a\r\nb\rc\n", "x \t\n\ty\u2003\r\n", "tail  \u00a0",
    "inner   run  x \n\n\n", "\u0130\U0001f600 e\u0301",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "snippet_id long, code string")


def test_python_whitespace_has_29_code_points():
    assert len(BLANKS) == 29


def test_cleaners(texts):
    rows = texts.select(
        "code", collapse_whitespace("code").alias("a"), normalise_newlines("code").alias("b"), rstrip_lines("code").alias("c")
    ).collect()
    for code, a, b, c in rows:
        text = code or ""
        unified = text.replace("\r\n", "\n").replace("\r", "\n")
        assert (a, b) == (" ".join(text.split()), unified)
        assert c == "\n".join(line.rstrip() for line in unified.split("\n"))


def features(spark, code, **kw):
    df = spark.createDataFrame([(1, code)], "snippet_id long, code string")
    return with_code_features(df, **kw).first().asDict()


def test_feature_list():
    assert len(FEATURES) == len(set(FEATURES)) == 44
    assert FEATURES[0] == "n_lines" and FEATURES[29] == "n_unique_imports" and FEATURES[43] == "n_unique_imports_per_kloc"


@pytest.mark.parametrize("code", [None, ""])
def test_empty_snippet(spark, code):
    row = features(spark, code)
    assert (row["n_lines"], row["blank_ratio"], row["avg_line_len"], row["max_indent"]) == (1, 1, 0, 0)
    assert all(row[f] == 0 for f in FEATURES[9:])


def test_line_breaks_count(spark):
    row = features(spark, "a\r\nb\rc\n")
    assert row["n_lines"] == 4 and row["blank_ratio"] == 0.25
    crlf, lf = features(spark, "def f():\r\n\tpass \r\n"), features(spark, "def f():\n\tpass \n")
    assert crlf["trailing_ws_ratio"] == pytest.approx(1 / 3) and crlf["tab_leading_ratio"] == 0.5
    assert {k: v for k, v in crlf.items() if k != "code"} == {k: v for k, v in lf.items() if k != "code"}
    assert features(spark, "def f():\n\tpass \n", clean="rstrip")["trailing_ws_ratio"] == 0


@pytest.mark.parametrize("code", ["bad(", "a\x00b", "\ufeffx = 1", "(" * 300 + ")" * 300])
def test_unparseable_rows_are_kept(spark, code):
    df = spark.createDataFrame([(1, code)], "snippet_id long, code string")
    facts = with_syntax_facts(df).first()["facts"]
    assert not facts["parse_ok"] and facts["names"] == [] and facts["max_depth"] == 0
    row = with_code_features(df).first()
    assert all(row[f] == 0 for f in FEATURES[9:])


def test_deep_expression_gives_depth():
    facts = facts_of("+".join(["1"] * 900))
    assert facts["parse_ok"] and facts["max_depth"] == 2 + 899


def test_very_deep_expression_keeps_the_row(spark):
    row = features(spark, "+".join(["1"] * 3000))
    assert row["n_lines"] == 1 and row["max_ast_depth"] == 3001


def test_imports(spark):
    code = "from . import a\nfrom x import *\nimport p.q\nimport p.r as z\n"
    facts = facts_of(code)
    assert sorted(facts["names"]) == ["*", "a", "q", "z"]
    row = features(spark, code)
    assert (row["n_imports"], row["n_from_imports"], row["n_unique_imports"]) == (2, 2, 3)
    assert row["single_letter_ratio"] == 1.0 and row["n_imports_per_kloc"] == 2 / (5 / 1000)


def test_functions_and_styles(spark):
    code = "@deco\ndef outer():\n    async def inner():\n        return 1\n    return inner\n"
    row = features(spark, code)
    assert row["n_FunctionDef"] == 2 and row["avg_func_len"] == (4 + 2) / 2
    row = features(spark, "_ = __ = x = myVar = MyVar = MAX_N = 1")
    assert row["snake_ratio"] == 3 / 6 and row["camel_ratio"] == 1 / 6 and row["upper_ratio"] == 3 / 6


def test_partitions_do_not_matter(spark, texts):
    a = with_code_features(texts.repartition(1)).orderBy("snippet_id").collect()
    b = with_code_features(texts.orderBy(F.desc("snippet_id")).repartition(5)).orderBy("snippet_id").collect()
    assert a == b


def test_parsed_once(spark, texts, capsys):
    with_code_features(texts).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_code_features_of_all_documents(spark, folder):
    got = QUERIES["build_code_features"](spark, folder)
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got.where("split IS NOT NULL").count() == n > spark.read.parquet(f"{folder}/labels.parquet").count()
    assert got.select("snippet_id").distinct().count() == n


def test_registered_vocabulary_is_that_of_the_job(spark, folder):
    assert QUERIES["ngram_vocab_topk"](spark, folder).count() == 50_000
    width = f"CAST({50_000 + len(feature_checks.LINE_FEATURES)} AS BIGINT) AS width"
    assert all("LIMIT 50000" in ORACLES[q] for q in ("ngram_vocab_index", "idf_smooth", "tfidf_weights", "tfidf_transform_unseen"))
    assert width in ORACLES["stack_sparse_dense"]
