"""Staged tables and their scopes."""

import os

import pytest

from snippetry.session import drop_path, stage, stage_scope


def exists(df):
    return os.path.isdir(df.staged_path.removeprefix("file:"))


def test_a_scope_leaves_only_what_it_keeps(spark):
    with stage_scope(spark) as scope:
        inner, out = stage(spark.range(3), "inner"), scope.keep(stage(spark.range(5), "out"))
        assert exists(inner) and inner.count() == 3
    assert not exists(inner) and exists(out) and out.count() == 5
    drop_path(spark, out.staged_path)


def test_scopes_nest_and_hand_kept_tables_on(spark):
    with stage_scope(spark):
        with stage_scope(spark) as scope:
            kept = scope.keep(stage(spark.range(2), "kept"))
            early = stage(spark.range(2), "early")
            scope.drop(early)
            assert not exists(early)
        assert exists(kept)
    assert not exists(kept)


def test_a_scope_cleans_up_after_an_error(spark):
    with pytest.raises(RuntimeError):
        with stage_scope(spark):
            left = stage(spark.range(2), "left")
            raise RuntimeError
    assert not exists(left)


def row_groups(df):
    import pyarrow.parquet as pq

    path = df.staged_path.removeprefix("file:")
    files = [pq.ParquetFile(f"{path}/{f}").metadata for f in os.listdir(path) if f.endswith(".parquet")]
    return [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]


def test_wide_rows_lie_in_small_groups(spark):
    """A reader holds the arrays of a group's rows at once: 4096 rows of long arrays took more than an executor's heap."""
    wide = spark.range(0, 4000, 1, 1).selectExpr("id", "transform(sequence(1, 1000), i -> xxhash64(id, i)) AS numbers")
    whole, parts = stage(wide), stage(wide, wide=True)
    assert row_groups(whole) == [4000] and max(row_groups(parts)) < 1000
    assert parts.exceptAll(wide).isEmpty() and parts.count() == 4000
    drop_path(spark, whole.staged_path)
    drop_path(spark, parts.staged_path)


def test_training_vectors_lie_in_small_groups(spark, monkeypatch):
    from snippetry import session
    from snippetry.operators.tfidf import CharTfidf

    monkeypatch.setattr(session, "WIDE_GROUP", 1 << 14)
    texts = spark.range(0, 2000, 1, 1).selectExpr("concat_ws(' ', transform(sequence(1, 20), i -> hex(xxhash64(id, i)))) AS code_clean")
    _, rows = CharTfidf(max_features=500).fit_counted(texts)
    assert max(row_groups(rows)) < 1000 and rows.count() == 2000
