"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted candidate lists.

For each anchor the best rows of its own label are its positives. Its hard negatives of a positive are the best rows of other
labels whose score lies in a window: from ``low`` to ``high`` percent of the positive's. Scores are integer inner products.

Candidates are dealt into blocks of bounded size. A block keeps one list a dimension, sorted by that component. An anchor reads
the lists from the end that its sign favours, every list to the same depth; each row met is scored at once by looking up its
whole vector. What no list has shown yet scores at most the threshold, the sum over dimensions of the anchor's component times
the last value read. Reading goes deeper, four times a step, until for every window either as many rows as wanted lie in it with
scores above the threshold (so the threshold is strictly below the window's kth score), or the threshold is below the window, or the
lists end. A block answers with the best rows of each window, and Spark ranks the answers of all blocks. Every block works for
every anchor; anchors come in blocks too, so a task holds one block of each whatever the sizes, and no label or common vector
makes a task larger.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part. Shorter vectors end in
zeros. Scaled components beyond 2^22 in size are held at that bound, so that hundredfold scores fit 64 bits up to 2^11 dimensions. Rows
are told apart by place, so a repeated row is another row, also as anchor and as its copy's positive. Ties go to the smaller
vec_id, an unknown one last. An anchor without positives, and a window without rows, gives nothing; a positive with a score
below 0 has an empty window. An empty table gives an empty table. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from snippetry.session import stage

BOUND = 1 << 22
_FIRST = 16
_EXACT = float(1 << 53)
_FOUND = "a_row bigint, w_row bigint, c_row bigint, c_id bigint, score bigint"


def quantised(vectors: DataFrame, scale: int = 256, label: Column | str = "label", vec_id: str = "vec_id",
              embedding: str = "embedding") -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, with whole-number components, written once so that ``row`` is fixed."""
    label = F.col(label) if isinstance(label, str) else label
    x = F.col("x").cast("array<double>")
    sound = F.col("x").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * scale, F.lit(1e15)), F.lit(-1e15))), F.lit(BOUND)), F.lit(-BOUND)).cast("int"))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.alias("label"), F.col(embedding).alias("x"))
    rows = rows.where(F.col("label").isNotNull() & sound).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", held.alias("v"))
    return stage(rows, "negative-vectors")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class SortedLists:
    """A block of candidates with one list of places a dimension, in ascending order of the component."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        self.labels = labels
        # Products and their sums stay below 2^53 for usual sizes, where doubles are exact whole numbers.
        self.largest = float(np.abs(vectors).max(initial=0))
        self.vectors = vectors.astype(np.float64)
        self.lists = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.lists, axis=0).astype(np.int64)

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(anchor).max(initial=0)) * max(len(anchor), 1) < _EXACT:
            return (self.vectors[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[at].astype(np.int64) @ anchor.astype(np.int64)

    def search(self, anchor: np.ndarray, label, itself: int, windows: list[tuple[int, int]], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, rows looked up) of all that was met before the threshold fell below the kth score of each
        window, rows of the wrong label left out. ``itself`` is the anchor's own place, or -1."""
        n, d = self.vectors.shape
        met, fits = np.zeros(n, bool), (self.labels == label) == same
        if 0 <= itself < n:
            met[itself] = True
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        places, scores, depth, looked = [], [], 0, 0
        while True:
            upto = min(max(depth * 4, _FIRST), n)
            new = np.zeros(n, bool)
            # Components that are 0 add nothing and their lists need not be read.
            new[self.lists[n - upto : n - depth, up].ravel()] = True
            new[self.lists[depth:upto, down].ravel()] = True
            if upto == n:
                new[:] = True
            at = np.flatnonzero(new & ~met)
            met[at] = True
            looked += len(at)
            at = at[fits[at]]
            places.append(at)
            scores.append(self.scores(at, anchor))
            depth = upto
            found = np.concatenate(scores)
            if depth == n:
                break
            threshold = (anchor[up] * self.values[n - depth, up]).sum() + (anchor[down] * self.values[depth - 1, down]).sum()
            if all(threshold < low or ((found <= high) & (found >= low) & (found > threshold)).sum() >= k for low, high in windows):
                break
        return np.concatenate(places), found, looked


def _best(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """Which of the places are the first k of a window, by score and then by id."""
    inside = np.flatnonzero((scores >= low) & (scores <= high))
    if len(inside) > k:
        least = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
        inside = inside[scores[inside] >= least]
    return inside[np.lexsort((ids[places[inside]], -scores[inside]))][:k]


def _searched(candidates: DataFrame, anchors: DataFrame, k: int, same: bool, width: int, blocks: int, anchor_rows: int) -> DataFrame:
    """(a_row, w_row, c_row, c_id, score): for each anchor and window, the first k rows of each block. ``anchors`` has (row,
    vec_id, label, v, windows), where windows is an array of (w_row, low, high)."""
    groups = max(1, -(-anchors.count() // anchor_rows))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))
    group = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(groups))
    columns = ["row", "vec_id", "label", "v"]
    none = F.lit(None).cast(anchors.schema["windows"].dataType)
    left = candidates.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), *columns, none.alias("windows"))
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), group.alias("group"), *columns, "windows")

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("windows").combine_chunks().is_valid()
        rows, asked = table.filter(pc.invert(asks)), table.filter(asks)
        out: list[list[int]] = [[], [], [], [], []]
        if len(rows) and len(asked):
            ids = rows.column("vec_id").to_pandas()
            order = ids.fillna(np.iinfo(np.int64).max).to_numpy(np.int64) if ids.isna().any() else ids.to_numpy(np.int64)
            known = (~ids.isna()).to_numpy()
            numbers = rows.column("row").to_numpy()
            labels = {x: i for i, x in enumerate(rows.column("label").unique().to_pylist())}
            coded = np.array([labels[x] for x in rows.column("label").to_pylist()])
            block = SortedLists(_matrix(rows.column("v").combine_chunks(), width), coded)
            own = {int(r): i for i, r in enumerate(numbers)}
            vectors = _matrix(asked.column("v").combine_chunks(), width).astype(np.int64)
            for vector, row, label, windows in zip(vectors, *[asked.column(c).to_pylist() for c in ("row", "label", "windows")]):
                bounds = [(w["low"], w["high"]) for w in windows]
                places, scores, _ = block.search(vector, labels.get(label, -1), own.get(row, -1), bounds, k, same)
                for w in windows:
                    best = _best(places, scores, order, w["low"], w["high"], k)
                    at = places[best]
                    out[0] += [row] * len(best)
                    out[1] += [w["w_row"]] * len(best)
                    out[2] += numbers[at].tolist()
                    out[3] += [int(order[i]) if known[i] else None for i in at]
                    out[4] += scores[best].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["a_row", "w_row", "c_row", "c_id", "score"])

    return left.unionByName(right).groupBy("block", "group").applyInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor's window, ranked from 1; tasks keep k of what they hold before rows move."""
    order = W.partitionBy("a_row", "w_row").orderBy(F.desc("score"), F.asc_nulls_last("c_id"), "c_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         block_rows: int = 65_536, anchor_rows: int = 16_384) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows of ``quantised``. ``anchors`` says
    which rows ask; ``block_rows`` and ``anchor_rows`` bound what one task holds and do not change the result."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], max(size["width"] or 0, 1)
    blocks = max(-(-n // block_rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // 4096)), 1)
    asking = rows.where(anchors)
    far = 1 << 62
    all_scores = F.array(F.struct(F.lit(0).cast("bigint").alias("w_row"), F.lit(-far).cast("bigint").alias("low"), F.lit(far).cast("bigint").alias("high")))
    same = _searched(rows, asking.withColumn("windows", all_scores), n_positives, True, width, blocks, anchor_rows)
    positives = stage(_first(same, n_positives), "negative-positives")
    # Whole scores from low % up and high % down.
    window = F.struct(F.col("c_row").alias("w_row"), _ceiling(F.col("score") * low).alias("low"), _floor(F.col("score") * high).alias("high"))
    windows = positives.where(window["low"] <= window["high"]).groupBy("a_row").agg(F.collect_list(window).alias("windows"))
    wanted = asking.join(windows, asking.row == windows.a_row).drop("a_row")
    other = _first(_searched(rows, stage(wanted, "negative-windows"), n_negatives, False, width, blocks, anchor_rows), n_negatives)
    negatives = other.select("a_row", "w_row", "rank", F.col("c_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = positives.select("a_row", F.col("c_row").alias("w_row"), F.col("c_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asking.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"))
    out = negatives.join(known, ["a_row", "w_row"]).join(names, "a_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _floor(hundredfold: Column) -> Column:
    """Whole part of a number of hundredths, towards minus infinity."""
    return F.call_function("div", hundredfold - F.pmod(hundredfold, F.lit(100)), F.lit(100))


def _ceiling(hundredfold: Column) -> Column:
    return -_floor(-hundredfold)
