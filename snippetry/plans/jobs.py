"""Whole-corpus jobs: split, engineered features, TF-IDF vectors, embeddings."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from snippetry.functions.text import collapse_whitespace
from snippetry.operators.code_features import FEATURES, with_code_features
from snippetry.operators.embedding import encode
from snippetry.operators.splitting import split_corpus
from snippetry.operators.tfidf import CharTfidf, CharTfidfModel
from snippetry.sources.corpus import require_columns


def build_splits(corpus: DataFrame, seed: int = 42) -> DataFrame:
    return split_corpus(require_columns(corpus, "code", "label"), "snippet_id", "label", seed)


def build_code_features(corpus: DataFrame, code: str = "code", clean: str = "raw") -> DataFrame:
    """(snippet_id, split, 44 features as float) of all splits in one pass."""
    require_columns(corpus, code, "split")
    full = with_code_features(corpus.select("snippet_id", "split", code), code, clean)
    return full.select("snippet_id", "split", *[F.col(f).cast("float").alias(f) for f in FEATURES])


def build_tfidf(corpus: DataFrame, code: str = "code", ngram_range: tuple[int, int] = (3, 6),
                max_features: int = 50_000) -> tuple[CharTfidfModel, DataFrame]:
    """Vocabulary and idf from the training rows, vectors (snippet_id, split, label, tfidf) for all."""
    require_columns(corpus, code, "label", "split")
    cleaned = corpus.select("snippet_id", "split", "label", collapse_whitespace(code).alias("code_clean"))
    model, train = CharTfidf("code_clean", ngram_range, max_features).fit_counted(cleaned.where("split = 'train'"))
    rest = PipelineModel(model.count_stages()).transform(cleaned.where("NOT (split <=> 'train')"))
    rows = train.unionByName(rest)
    vectors = PipelineModel(model.weight_stages("tfidf")).transform(rows)
    return model, vectors.select("snippet_id", "split", "label", "tfidf")


def build_embeddings(corpus: DataFrame, code: str = "code", make_predict_fn=None, batch_size: int = 32) -> DataFrame:
    require_columns(corpus, code)
    keep = [c for c in ("snippet_id", "split", "label") if c in corpus.columns]
    return corpus.select(*keep, encode(collapse_whitespace(code), make_predict_fn, batch_size).alias("embedding"))
