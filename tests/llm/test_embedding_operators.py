"""Hard negatives and near copies of embeddings against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from snippetry.llm import embedding_copies, hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, node int, score double, n_links string"


def clusters(seed, n, width=12, centres=6, spread=0.1):
    """Near copies in a few clusters of each label, exact copies and ties among them."""
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(centres, width))
    out = []
    for i in range(n):
        v = middle[i % centres] + spread * rnd.normal(size=width)
        if i % 9 == 0 and out:
            v = out[-1][1]
        out.append((i * 5, [float(np.float32(x)) for x in v], int(rnd.integers(3))))
    return out


def odd():
    nan, inf = float("nan"), float("inf")
    base = clusters(7, 60, 4)
    copies = [base[3], base[3], (base[3][0], base[3][1], 2), (None, base[3][1], base[3][2]), (10**6, base[3][1], base[3][2])]
    broken = [(100, None, 1), (200, [1.0, None, 0.0, 0.0], 1), (300, [nan, 0.0, 0.0, 0.0], 1), (400, [inf, 0.0, 0.0, 0.0], 1),
              (500, [0.0] * 4, 1), (600, [], 1), (700, [1.0, 0.0, 0.0, 0.0], None), (None, None, None), (800, [-0.0, 0.0, 0.0, 0.0], 1)]
    lengths = [(900, [0.5, 0.25], 1), (905, [0.5, 0.25, 0.0, 0.0], 1), (1000, [3e38, 3e38, 0.0, 0.0], 0), (1005, [3e38, 3e38, 1.0, 0.0], 0),
               (1100, [1e-38, 0.0, 0.0, 0.0], 2), (1105, [1e-37, 0.0, 0.0, 0.0], 2)]
    return base + copies + broken + lengths


def frame(spark, rows):
    return spark.createDataFrame([(i, x, label, 1, 2, 0.5, "other") for i, x, label in rows], SCHEMA)


def sound(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def brute_negatives(rows, every, n_positives=5, n_negatives=10, low=30, high=90, scale=256, bound=hard_negatives.BOUND):
    part = [(i, [max(min(math.floor(scale * np.float64(c)), bound), -bound) for c in x], label) for i, x, label in rows if label is not None and sound(x)]
    out = []
    for k, (a_id, a, a_label) in enumerate(part):
        if a_id is None or a_id % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, x)), math.inf if i is None else i, label, i) for j, (i, x, label) in enumerate(part) if j != k]
        scored.sort(key=lambda t: t[:2])
        for s, _, _, p_id in [t for t in scored if t[2] == a_label][:n_positives]:
            fits = [t for t in scored if t[2] != a_label and low * -s <= 100 * -t[0] <= high * -s]
            out += [(a_id, p_id, r + 1, t[3], -s, -t[0]) for r, t in enumerate(fits[:n_negatives])]
    return sorted(out, key=repr)


def mined(spark, rows, every, **options):
    given = hard_negatives.quantised(frame(spark, rows))
    got = hard_negatives.mine(given, F.col("vec_id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "anchor_rows": 7}, {"n_positives": 2, "n_negatives": 3, "low": 50, "high": 100}])
def test_negatives_equal_brute_force(spark, options):
    rows = clusters(1, 300)
    bounds = {k: v for k, v in options.items() if not k.endswith("_rows")}
    want = brute_negatives(rows, 25, **bounds)
    assert want and mined(spark, rows, 25, **options) == want


def test_negatives_of_odd_rows_and_ties(spark):
    rows = odd()
    assert mined(spark, rows, 5, block_rows=30) == brute_negatives(rows, 5)
    tied = [(i, [1.0 if i % 2 else 0.9, 0.5], i % 3 % 2) for i in range(120)]
    assert mined(spark, tied, 10) == brute_negatives(tied, 10)


def test_negatives_of_empty_and_one_label_tables(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [(i, [1.0, float(i)], 1) for i in range(20)], 5) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)], 5) == []


def test_reading_ends_once_the_threshold_is_below_every_window():
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(20_000, 3)) * 100
    block = hard_negatives.SortedLists(np.floor(vectors).astype(int), np.arange(20_000) % 2)
    anchor = np.array([200, -30, 10])
    far = 1 << 62
    places, scores, looked = block.search(anchor, 0, -1, [(-far, far)], 5, True)
    want = np.sort((block.vectors @ anchor)[::2])[::-1][:5]
    assert np.sort(scores)[::-1][:5].tolist() == want.tolist() and looked < 10_000
    # A window below all scores, and one above them, are left as soon as that is known.
    assert block.search(anchor, 1, -1, [(far - 1, far)], 5, True)[2] < 1000


def brute_copies(rows, threshold):
    n = len(rows)
    width = max([len(x) for _, x, _ in rows if x] or [1])

    def scaled(x):
        top = max(abs(c) for c in x)
        return np.array([c / top for c in x] + [0.0] * (width - len(x)))

    part = {k: scaled(x) for k, (_, x, label) in enumerate(rows) if label is not None and sound(x) and any(x)}
    links, root = [0] * n, list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in part:
        for b in part:
            if b < a and rows[a][2] == rows[b][2]:
                x, y = part[a], part[b]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a], links[b] = links[a] + 1, links[b] + 1
                    root[find(a)] = find(b)
    least = {}
    for k in range(n):
        ids = [i for i in (least.get(find(k)), rows[k][0]) if i is not None]
        least[find(k)] = min(ids) if ids else None
    return sorted(((i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(rows)), key=repr)


def copies(spark, rows, **options):
    got = embedding_copies.components(frame(spark, rows), **options)
    assert got.columns == ["vec_id", "embedding", "label", "row", "node", "score", "n_links", "component_id", "kept"]
    assert all(r["row"] == 1 and r["node"] == 2 for r in got.collect())
    return sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"tile_rows": 20}, {"tile_rows": 15, "cell_axes": 3}])
def test_copies_equal_brute_force(spark, options):
    rows = clusters(2, 240, spread=0.3)
    want = brute_copies(rows, 0.93)
    assert 20 < sum(1 for r in want if r[1]) < 230 and len({r[2] for r in want}) > 5
    assert copies(spark, rows, threshold=0.93, **options) == want


def test_copies_of_odd_rows(spark):
    rows = odd()
    for options in ({}, {"tile_rows": 10}):
        assert copies(spark, rows, threshold=0.93, **options) == brute_copies(rows, 0.93)
    assert copies(spark, []) == [] and copies(spark, [(1, None, 1), (None, None, None)]) == [(1, 0, 1, True), (None, 0, None, True)]


def test_a_large_group_of_copies_and_near_copies_stays_small(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base], 1) for i in range(500)]
    rows += [(1000 + i, [float(np.float32(x)) for x in base + 0.01 * rnd.normal(size=16)], 1) for i in range(300)]
    got = copies(spark, rows, tile_rows=100)
    assert all(r[1:3] == (799, 0) for r in got)


def test_bounds_end_most_comparisons_early():
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(1000, 64))
    steps = embedding_copies.steps_of(64)
    tile = embedding_copies.Tile(vectors, np.eye(64), steps)
    *_, done = embedding_copies._block_pairs(tile, tile, slice(0, 1000), slice(0, 1000), 0.93, steps, True)
    assert done < 1000 * 1000 * 64 / 3
