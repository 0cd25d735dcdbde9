"""Syntax features on templates, character n-grams, TF-IDF, embeddings, scaling and stacking."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from snippetry.checks.registry import query, r6, rounded
from snippetry.checks.sql_text import (
    COLLAPSED, LINE_COLUMNS, SNIPPETS, SPLIT, STORED_SPLIT, all_features, grams, line_stats, templates, tree_columns, vocabulary,
)
from snippetry.functions.lines import INDENT_STATS, LINE_STATS, with_line_stats
from snippetry.functions.syntax import IDENTIFIERS, IMPORTS, SHAPE
from snippetry.functions.text import collapse_whitespace
from snippetry.operators.code_features import FEATURES, PER_KLOC_OF, with_code_features
from snippetry.operators.embedding import encode
from snippetry.operators.gram_counting import row_gram_summary
from snippetry.operators.scaling import align, fit_scaler, scale
from snippetry.operators.splitting import split_corpus
from snippetry.operators.syntax_facts import with_syntax_facts
from snippetry.operators.tfidf import CharTfidf, char_grams, corpus_counts, gram_counts, top_grams
from snippetry.plans.jobs import build_code_features as code_features_job
from snippetry.plans.training import fit_features
from snippetry.sources.corpus import spread
from snippetry.sources.tables import labelled_snippets, labels, snippets, stored_snippets, table, template_snippets

LINE_FEATURES = [*LINE_STATS, *INDENT_STATS]
VOCABULARY_SIZE = WEIGHTS_VOCABULARY = 50_000  # the operator's max_features


def _r(names, prefix=""):
    return ", ".join(f"round(CAST({prefix}{c} AS DOUBLE), 6) AS {c}" for c in names)


def _tree_sql(names):
    cells = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in tree_columns() if n in names)
    return f"WITH {templates()} SELECT f.snippet_id, {cells} FROM tree_facts f"


@query(f"""WITH {templates()} SELECT snippet_id, ok AS parse_ok, n_names, len_names, n_FunctionDef AS n_funcs, n_If AS n_ifs,
    4 * n_FunctionDef AS func_lines, max_ast_depth AS max_depth, n_imports AS n_import, n_from_imports AS n_from,
    CASE WHEN ok THEN 'os,sys' ELSE '' END AS pkgs FROM tree_facts""")
def ast_facts(spark, folder):
    facts = with_syntax_facts(template_snippets(spark, folder))
    count = "coalesce(facts.node_counts['{}'], 0L)".format

    def total(expr):
        return F.aggregate(expr, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return facts.select(
        "snippet_id",
        "facts.parse_ok",
        F.size("facts.names").cast("bigint").alias("n_names"),
        total(F.transform("facts.names", lambda x: F.length(x))).alias("len_names"),
        F.expr(f"{count('FunctionDef')} + {count('AsyncFunctionDef')}").alias("n_funcs"),
        F.expr(count("If")).alias("n_ifs"),
        total(F.col("facts.func_lens")).alias("func_lines"),
        F.col("facts.max_depth").alias("max_depth"),
        F.col("facts.n_import").alias("n_import"),
        F.col("facts.n_from").alias("n_from"),
        F.array_join(F.sort_array("facts.pkgs"), ",").alias("pkgs"),
    )


def _tree_query(spark, folder, names):
    return rounded(with_code_features(template_snippets(spark, folder)).select("snippet_id", *names), *names)


@query(_tree_sql(IDENTIFIERS))
def feat_identifiers(spark, folder):
    return _tree_query(spark, folder, IDENTIFIERS)


@query(_tree_sql(SHAPE))
def feat_ast_shape(spark, folder):
    return _tree_query(spark, folder, SHAPE)


@query(_tree_sql(IMPORTS))
def feat_imports(spark, folder):
    return _tree_query(spark, folder, IMPORTS)


PER_KLOC = [f"{n}_per_kloc" for n in PER_KLOC_OF]


@query(f"WITH {all_features()} SELECT snippet_id, {_r(PER_KLOC)} FROM feats")
def feat_per_kloc(spark, folder):
    return _tree_query(spark, folder, PER_KLOC)


@query(f"WITH {all_features()} SELECT snippet_id, {_r(FEATURES)} FROM feats")
def feat_all44(spark, folder):
    return _tree_query(spark, folder, FEATURES)


@query()
def build_code_features(spark, folder):
    """All documents; those without a label are a stratum of their own."""
    rows = snippets(spark, folder).join(labels(spark, folder), "snippet_id", "left")
    return code_features_job(split_corpus(rows))


@query(f"""WITH {SNIPPETS}, {grams("snippets")}
SELECT snippet_id, n, count(*) AS n_grams, count(DISTINCT gram) AS n_distinct, min(gram) AS first_gram, max(gram) AS last_gram
FROM grams GROUP BY snippet_id, n""")
def char_ngrams(spark, folder):
    cleaned = snippets(spark, folder).select("snippet_id", collapse_whitespace("code").alias("t"))
    return row_gram_summary(cleaned, "snippet_id", "t", 3, 6)


@query(f"""WITH {SNIPPETS}, {grams("snippets")},
tf AS (SELECT snippet_id, gram, count(*) AS tf FROM grams GROUP BY ALL)
SELECT snippet_id, count(*) AS n_pairs, CAST(sum(tf) AS BIGINT) AS n_grams, CAST(sum(tf * tf) AS BIGINT) AS sum_sq, max(tf) AS max_tf,
    CAST(sum(tf * length(replace(gram, 'e', ''))) AS BIGINT) AS without_e FROM tf GROUP BY snippet_id""")
def ngram_tf(spark, folder):
    cleaned = snippets(spark, folder).select("snippet_id", collapse_whitespace("code").alias("t"))
    return gram_counts(cleaned, "snippet_id", "t").groupBy("snippet_id").agg(
        F.count("*").alias("n_pairs"), F.sum("tf").alias("n_grams"), F.sum(F.col("tf") * F.col("tf")).alias("sum_sq"),
        F.max("tf").alias("max_tf"),
        F.sum(F.col("tf") * F.length(F.replace("gram", F.lit("e"), F.lit("")))).alias("without_e"),
    )


@query(f"""WITH {SNIPPETS}, {grams("snippets")}
SELECT gram, count(*) AS cf FROM grams GROUP BY gram ORDER BY cf DESC, gram LIMIT {VOCABULARY_SIZE}""")
def ngram_vocab_topk(spark, folder):
    cleaned = snippets(spark, folder).select(collapse_whitespace("code").alias("t"))
    return top_grams(corpus_counts(cleaned, "t"), VOCABULARY_SIZE)


def _cleaned_split(spark, folder):
    return split_corpus(labelled_snippets(spark, folder)).select(
        "snippet_id", "split", collapse_whitespace("code").alias("code_clean")
    )


def _fitted(spark, folder, k):
    return CharTfidf("code_clean", (3, 6), k).fit(_cleaned_split(spark, folder).where("split = 'train'"))


TRAIN = f"{SPLIT}, train AS (SELECT snippet_id, code FROM splitted WHERE split = 'train')"


@query(f"WITH {TRAIN}, {vocabulary(VOCABULARY_SIZE)} SELECT gram, CAST(idx AS INT) AS idx, cf FROM vocab")
def ngram_vocab_index(spark, folder):
    return _fitted(spark, folder, VOCABULARY_SIZE).vocabulary(spark).select("gram", "idx", "cf")


@query(f"WITH {TRAIN}, {vocabulary(VOCABULARY_SIZE)} SELECT gram, df, round(idf, 6) AS idf FROM vocab")
def idf_smooth(spark, folder):
    return rounded(_fitted(spark, folder, VOCABULARY_SIZE).vocabulary(spark).select("gram", "df", "idf"), "idf")


_WEIGHTS = """raw_w AS (SELECT t.{key}, t.gram, t.tf, t.tf * v.idf AS w FROM {tf} t JOIN vocab v ON t.gram = v.gram),
norms AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM raw_w GROUP BY {key}),
weights AS (SELECT {key}, gram, tf, w / norm AS weight FROM raw_w JOIN norms USING ({key}))"""


@query(f"""WITH {TRAIN}, {vocabulary(WEIGHTS_VOCABULARY)}, {_WEIGHTS.format(key="snippet_id", tf="tf")}
SELECT snippet_id, gram, tf, round(weight, 6) AS weight FROM weights""")
def tfidf_weights(spark, folder):
    train = _cleaned_split(spark, folder).where("split = 'train'")
    model, counted = CharTfidf("code_clean", (3, 6), WEIGHTS_VOCABULARY).fit_counted(train)
    return rounded(model.weights(counted, "snippet_id"), "weight")


_SPOKEN = """spoken AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS k, text AS code FROM conversations)"""


@query(f"""WITH {TRAIN}, {vocabulary(VOCABULARY_SIZE)}, {_SPOKEN}, {grams("spoken", "k", name="heard")},
heard_tf AS (SELECT k, gram, count(*) AS tf FROM heard GROUP BY ALL), {_WEIGHTS.format(key="k", tf="heard_tf")},
sums AS (SELECT k, count(*) AS n_known, round(sum(weight), 5) AS total, round(max(weight), 5) AS top FROM weights GROUP BY k)
SELECT spoken.k, coalesce(n_known, 0) AS n_known, coalesce(total, 0) AS total, coalesce(top, 0) AS top
FROM spoken LEFT JOIN sums ON spoken.k = sums.k""")
def tfidf_transform_unseen(spark, folder):
    model = _fitted(spark, folder, VOCABULARY_SIZE)
    spoken = spread(table(spark, folder, "conversations"), "conv_id").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"),
        collapse_whitespace("text").alias("code_clean"),
    )
    w = F.col("v.values")
    return model.transform(spoken).select("k", F.unwrap_udt("tfidf").alias("v")).select(
        "k", F.size(w).cast("bigint").alias("n_known"),
        F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
        F.round(F.coalesce(F.array_max(w), F.lit(0.0)), 5).alias("top"),
    )


@query(f"""WITH {SNIPPETS}, words AS (SELECT snippet_id, unnest(string_split({COLLAPSED}, ' ')) AS w FROM snippets),
codes AS (SELECT snippet_id, CAST('0x' || md5(w)[1:8] AS BIGINT) AS code FROM words WHERE w <> ''),
sums AS (SELECT snippet_id, code % 64 AS pos, sum(CASE WHEN (code // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM codes GROUP BY ALL)
SELECT s.snippet_id, CAST(r.pos AS INT) AS pos, CAST(coalesce(v, 0) AS DOUBLE) AS value
FROM snippets s CROSS JOIN (SELECT unnest(range(64)) AS pos) r LEFT JOIN sums ON sums.snippet_id = s.snippet_id AND sums.pos = r.pos""")
def embed_encode(spark, folder):
    vectors = snippets(spark, folder).select("snippet_id", encode(collapse_whitespace("code")).alias("e"))
    return vectors.select("snippet_id", F.posexplode_outer("e").alias("pos", "value")).select(
        "snippet_id", "pos", F.col("value").cast("double").alias("value")
    )


@query("""SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm
FROM embeddings""")
def embed_load_stats(spark, folder):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, folder, "embeddings").select(
        "vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.sqrt(square), 5).alias("norm")
    )


@query("SELECT min(len(embedding)) AS lo, max(len(embedding)) AS hi, count(*) AS n FROM embeddings")
def embed_dim(spark, folder):
    width = F.size("embedding").cast("bigint")
    return table(spark, folder, "embeddings").agg(F.min(width).alias("lo"), F.max(width).alias("hi"), F.count("*").alias("n"))


@query(f"""WITH {all_features()}, cells AS (UNPIVOT feats ON COLUMNS(* EXCLUDE (snippet_id)) INTO NAME name VALUE v),
names AS (SELECT unnest({FEATURES}) AS name, unnest(range(44)) AS pos)
SELECT name, CAST(pos AS INT) AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
FROM cells JOIN names USING (name) GROUP BY name, pos""")
def scaler_fit(spark, folder):
    model = fit_scaler(with_code_features(template_snippets(spark, folder)), FEATURES)
    return rounded(model.table_df(spark), "mean", "std")


_SPLIT_STATS = f"""{SPLIT}, {line_stats('splitted')},
stats AS (SELECT splitted.snippet_id, split, {", ".join("line_stats." + c for c in LINE_COLUMNS)}
    FROM splitted JOIN line_stats ON splitted.snippet_id = line_stats.snippet_id)"""


def _fit_sql(source="stats WHERE split = 'train'"):
    cells = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_COLUMNS)
    return f"fit AS (SELECT {cells} FROM {source})"


def _scaled_sql(c):
    return f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END"


@query(f"""WITH {_SPLIT_STATS}, {_fit_sql()}
SELECT snippet_id, split, {", ".join(f"round({_scaled_sql(c)}, 5) AS {c}" for c in LINE_COLUMNS)} FROM stats, fit""")
def scaler_transform(spark, folder):
    stats = with_line_stats(split_corpus(labelled_snippets(spark, folder))).drop("code")
    model = fit_scaler(stats.where("split = 'train'"), LINE_FEATURES)
    scaled = scale(stats, model, ["snippet_id", "split"])
    return scaled.select("snippet_id", "split", *[F.round(c, 5).alias(c) for c in LINE_FEATURES])


@query(f"""WITH {SNIPPETS}, {line_stats('snippets')} SELECT snippet_id, CAST(max_line_len AS DOUBLE) AS max_line_len, CAST(0 AS DOUBLE) AS n_tokens,
    CAST(n_lines AS DOUBLE) AS n_lines, CAST(CASE WHEN blank_ratio > 0 THEN blank_ratio ELSE 0 END AS DOUBLE) AS blank_ratio FROM line_stats""")
def align_columns(spark, folder):
    stats = with_line_stats(snippets(spark, folder)).withColumn("blank_ratio", F.expr("nullif(blank_ratio, 0)"))
    return align(stats, ["max_line_len", "n_tokens", "n_lines", "blank_ratio"], ["snippet_id"])


def _stacked(spark, folder, text):
    rows = split_corpus(stored_snippets(spark, folder) if text == "stored" else labelled_snippets(spark, folder))
    fitted = fit_features(rows.where("split = 'train'"), text, LINE_FEATURES, WEIGHTS_VOCABULARY)
    return fitted, PipelineModel(fitted.stages).transform(rows)


_DENSE_SUM = " + ".join(_scaled_sql(c) for c in LINE_COLUMNS)


@query(f"""WITH {_SPLIT_STATS}, {_fit_sql()}, train AS (SELECT snippet_id, code FROM splitted WHERE split = 'train'),
{vocabulary(WEIGHTS_VOCABULARY)}, {grams("splitted", name="each_gram")},
each_tf AS (SELECT snippet_id, gram, count(*) AS tf FROM each_gram GROUP BY ALL), {_WEIGHTS.format(key="snippet_id", tf="each_tf")},
text_sum AS (SELECT snippet_id, sum(weight) AS total FROM weights GROUP BY snippet_id)
SELECT stats.snippet_id, split, CAST({WEIGHTS_VOCABULARY + len(LINE_COLUMNS)} AS BIGINT) AS width,
    round(coalesce(total, 0), 4) AS text_total, round({_DENSE_SUM}, 4) AS dense_total
FROM stats CROSS JOIN fit LEFT JOIN text_sum ON stats.snippet_id = text_sum.snippet_id""")
def stack_sparse_dense(spark, folder):
    return _halves(_stacked(spark, folder, "tfidf")[1], WEIGHTS_VOCABULARY, "text_total")


def _halves(rows, at, name):
    """Totals of the features before ``at`` and from there on, read off the entries a vector holds: none is written out to its full width."""
    def total(a):
        return F.round(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), 4)

    held = rows.select("snippet_id", "split", F.unwrap_udt("features").alias("v"))
    # Indices ascend; a dense vector has none.
    before = F.size(F.filter("v.indices", lambda i: i < at))
    cut = F.when(F.col("v.indices").isNull(), F.lit(at)).otherwise(before)
    return held.select("snippet_id", "split", "v", cut.alias("cut")).select(
        "snippet_id", "split", F.coalesce("v.size", F.size("v.values")).cast("bigint").alias("width"),
        total(F.slice("v.values", 1, F.col("cut"))).alias(name),
        total(F.slice("v.values", F.col("cut") + 1, F.size("v.values"))).alias("dense_total"),
    )


@query(f"""WITH {STORED_SPLIT}, joined AS (SELECT s.*, e.embedding FROM splitted s JOIN embeddings e ON s.snippet_id = e.vec_id),
{line_stats("joined")},
stats AS (SELECT joined.snippet_id, split, embedding, {", ".join("line_stats." + c for c in LINE_COLUMNS)}
    FROM joined JOIN line_stats ON joined.snippet_id = line_stats.snippet_id), {_fit_sql()}
SELECT snippet_id, split, CAST({64 + len(LINE_COLUMNS)} AS BIGINT) AS width,
    round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS embedding_total, round({_DENSE_SUM}, 4) AS dense_total
FROM stats, fit""")
def stack_embed_dense(spark, folder):
    return _halves(_stacked(spark, folder, "stored")[1], 64, "embedding_total")
