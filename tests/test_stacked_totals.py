"""Totals of stacked vectors, from sparse and dense ones, without their full width."""

from pyspark.ml.linalg import Vectors

from snippetry.checks.feature_checks import _halves


def test_totals_of_both_halves_come_from_the_entries_held(spark):
    width = 2_000_000_000  # an array of that many doubles does not fit
    vectors = [
        (Vectors.sparse(width, [0, 7, 8, width - 1], [1.0, 2.0, 4.0, 8.0]), (width, 3.0, 12.0)),
        (Vectors.sparse(width, [9], [5.0]), (width, 0.0, 5.0)),
        (Vectors.sparse(width, [3], [6.0]), (width, 6.0, 0.0)),
        (Vectors.sparse(width, [], []), (width, 0.0, 0.0)),
        (Vectors.dense([1.0] * 8 + [0.0, 2.5]), (10, 8.0, 2.5)),
    ]
    rows = spark.createDataFrame([(i, "train", v) for i, (v, _) in enumerate(vectors)], ["snippet_id", "split", "features"])
    found = _halves(rows, 8, "text_total").orderBy("snippet_id").collect()
    assert [tuple(r)[2:] for r in found] == [want for _, want in vectors]
