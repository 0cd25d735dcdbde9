"""Near copies among embeddings of one label: tiles of rows compared by their leading principal dimensions first.

Unit vectors are turned into the axes of the corpus, widest first: the eigenvectors of the second moments of all vectors, which
leave every inner product as it is. Two vectors are compared by adding up products of the leading dimensions. What the other
dimensions can still add is at most the product of both suffix norms; as soon as that cannot bring the cosine up to the
threshold, the pair is done with. Most pairs end after a few of the dimensions. Pairs that reach the end are checked by their
cosine in double precision on the vectors as given.

Equal vectors of one label count as one node with a number of copies, so copies are not compared with each other. Nodes of a
label are cut into cells along the widest axes, as broad as linked vectors can lie apart, and cells into tiles of at most about
``tile_rows``; small labels are one tile. Only tiles of the same or adjoining cells of one label meet, in a task of their own.
A task answers with one row a node: the vectors it links with, counted by their copies, and the least node it hangs together with
there. Links are never listed, so a group of many near copies stays as small as its members.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing
and are a component of their own. Shorter vectors end in zeros. Rows are told apart by place: a repeated row is a copy with a
link. The component's id is its smallest known vec_id, null if none is known; kept compares null-safely. An empty table gives an
empty table. Extra columns pass through, except ones named like a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from snippetry.llm.graph import connected
from snippetry.operators.bounded import join_checked
from snippetry.session import stage

# Room for rounding in bounds; what passes by it is checked exactly.
SLACK = 1e-9
_BLOCK = 1024
_FEW = 0.1
RESULTS = ("n_links", "component_id", "kept")
_FOUND = "node bigint, links bigint, root bigint"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    # Squares of very large or small components would leave the range of doubles.
    top = np.abs(out).max(axis=1, initial=0)
    odd = (top > 1e140) | ((top < 1e-140) & (top > 0))
    out[odd] /= top[odd, None]
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1)


class Tile:
    """Unit vectors along the principal axes, their suffix norms at each step, and the vectors as given."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.given = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.turned = unit(vectors) @ axes
        tail = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {k: np.sqrt(tail[:, k]) if k < tail.shape[1] else np.zeros(len(tail)) for k in steps}

    def __len__(self) -> int:
        return len(self.given)


def steps_of(width: int) -> list[int]:
    """Numbers of leading dimensions after which pairs are judged: 8, 16, 32 and so on."""
    steps = [min(8, width)]
    while steps[-1] < width:
        steps.append(min(steps[-1] * 2, width))
    return steps


def _block_pairs(left: Tile, right: Tile, rows: slice, columns: slice, threshold: float, steps: list[int], same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the pairs of one block that no bound ruled out, and the products of components that were computed."""
    u, v, least = left.turned[rows], right.turned[columns], threshold - SLACK
    k = steps[0]
    sums = u[:, :k] @ v[:, :k].T
    alive = sums + np.outer(left.rest[k][rows], right.rest[k][columns]) >= least
    if same and rows == columns:
        alive &= np.tri(len(u), len(v), -1, dtype=bool).T
    done, at = sums.size * k, 1
    while at < len(steps) and np.count_nonzero(alive) > _FEW * alive.size:
        upto = steps[at]
        sums += u[:, k:upto] @ v[:, k:upto].T
        alive &= sums + np.outer(left.rest[upto][rows], right.rest[upto][columns]) >= least
        done += sums.size * (upto - k)
        k, at = upto, at + 1
    i, j = np.nonzero(alive)
    total = sums[i, j]
    for upto in steps[at:]:
        if not len(i):
            break
        total += np.einsum("ij,ij->i", u[i, k:upto], v[j, k:upto])
        done += len(i) * (upto - k)
        left_over = left.rest[upto][rows][i] * right.rest[upto][columns][j]
        near = total + left_over >= least
        i, j, total, k = i[near], j[near], total[near], upto
    return i + rows.start, j + columns.start, done


def linked_pairs(left: Tile, right: Tile, threshold: float, steps: list[int], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs with a cosine of at least ``threshold``; each pair once if both tiles are the same."""
    for a in range(0, len(left), _BLOCK):
        rows = slice(a, min(a + _BLOCK, len(left)))
        for b in range(a if same else 0, len(right), _BLOCK):
            columns = slice(b, min(b + _BLOCK, len(right)))
            i, j, _ = _block_pairs(left, right, rows, columns, threshold, steps, same)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                cosine = np.einsum("ij,ij->i", left.given[p], right.given[q]) / (left.norms[p] * right.norms[q])
                yield p[cosine >= threshold], q[cosine >= threshold]


def hang_together(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``roots`` (each element's least known companion) after linking i with j."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return roots
        np.minimum.at(roots, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (roots[roots] != roots).any():
            roots = roots[roots]


def _moments(nodes: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all unit vectors: one row a dimension is added up on Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = unit(_matrix(batch.column("x"), width))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "m"])

    def added(table: pa.Table) -> pa.Table:
        total = table.column("m").combine_chunks().flatten().to_numpy().reshape(-1, width).sum(axis=0)
        return pa.table({"i": table.column("i")[:1], "m": pa.array([total], pa.list_(pa.float64()))})

    rows = nodes.select("x").mapInArrow(partial, "i bigint, m array<double>").groupBy("i").applyInArrow(added, "i bigint, m array<double>")
    out = np.zeros((width, width))
    for r in rows.collect():
        out[r["i"]] = r["m"]
    return out


def principal_axes(nodes: DataFrame, width: int) -> np.ndarray:
    """Columns: the principal axes of the unit vectors about the origin, widest first."""
    values, vectors = np.linalg.eigh(_moments(nodes, width))
    return vectors[:, np.argsort(-values, kind="stable")]


def _nodes(vectors: DataFrame, label: str, vec_id: str, embedding: str) -> DataFrame:
    """The given columns beside _row, _label, _id, _node (null if it links with nothing), _copies and _least; _x with the row that is the node."""
    x = F.col("_x").cast("array<double>")
    sound = F.col("_label").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    kept = [F.col(f"`{c}`") for c in vectors.columns if c not in RESULTS]
    rows = vectors.select(*kept, F.monotonically_increasing_id().alias("_row"), F.col(label).alias("_label"), F.col(vec_id).cast("bigint").alias("_id"), F.col(embedding).alias("_x"))
    keys = [F.xxhash64(F.lit(1), "_x").alias("_h1"), F.xxhash64(F.lit(2), "_x").alias("_h2")]
    rows = stage(rows.withColumn("_sound", F.coalesce(sound, F.lit(False))).select("*", *keys), "embedding-rows")
    groups = rows.where("_sound").groupBy("_label", "_h1", "_h2").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"), F.min("_id").alias("_min"))
    copied = stage(groups.where("_n > 1").withColumnsRenamed({"_label": "_l", "_h1": "_k1", "_h2": "_k2"}), "embedding-copied")
    joined = join_checked(rows, copied, F.expr("_sound AND _label = _l AND _h1 = _k1 AND _h2 = _k2"), "left")
    node = F.when(F.col("_sound"), F.coalesce("_first", "_row"))
    own = F.when(node == F.col("_row"), F.col("_x"))
    return joined.select(
        *kept, "_row", "_label", "_id", node.alias("_node"), F.coalesce("_n", F.lit(1)).alias("_copies"),
        F.when(F.col("_n").isNotNull(), F.col("_min")).otherwise(F.col("_id")).alias("_least"), own.alias("_x"),
    )


def _celled(nodes: DataFrame, axes: np.ndarray, cell_axes: int, threshold: float, label_type: str) -> DataFrame:
    """(node, label, copies, x, cell): cell numbers along the widest axes. Linked vectors lie at most one cell apart."""
    width, leading = axes.shape[0], axes[:, :cell_axes]
    breadth = max(float(np.sqrt(max(2 - 2 * threshold, 0))), 1e-3) * (1 + 1e-6)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(unit(_matrix(batch.column("x"), width)) @ leading / breadth).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at), pa.list_(pa.int32()))], [*batch.schema.names, "cell"])

    kind = nodes.schema["x"].dataType.simpleString()
    return nodes.mapInArrow(cells, f"node bigint, label {label_type}, copies bigint, x {kind}, cell array<int>")


def _tile_pairs(celled: DataFrame, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """How cells are cut (label, cell, area, tiles), and which tiles meet (label, a, ta, b, tb); areas are cells, or the whole of a small label."""
    counts = stage(celled.groupBy("label", "cell").agg(F.count("*").alias("n")), "embedding-cells")
    totals = counts.groupBy("label").agg(F.sum("n").alias("total")).withColumnRenamed("label", "_l")
    small = F.col("total") <= tile_rows
    cut = join_checked(counts, stage(totals, "embedding-labels"), F.expr("label = _l")).select(
        "label", "cell", F.when(small, F.transform("cell", lambda _: F.lit(0))).otherwise(F.col("cell")).alias("area"),
        F.when(small, F.lit(1)).otherwise(F.ceil(F.col("n") / tile_rows)).cast("int").alias("tiles"),
    )
    cut = stage(cut, "embedding-cuts")
    tiles = cut.select("label", "area", "tiles").distinct().select("label", "area", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    first = counts.select(F.size("cell").alias("n")).first()
    around = [[]]
    for i in range(first["n"] if first else 1):
        around = [[*head, F.col("area")[i] + step] for head in around for step in (-1, 0, 1)]
    near = F.array(*[F.array(*cell) for cell in around])
    left = tiles.select("label", F.col("area").alias("a"), F.col("tile").alias("ta"), F.explode(near).alias("b"))
    right = tiles.select(F.col("label").alias("_l"), F.col("area").alias("_b"), F.col("tile").alias("tb"))
    pairs = left.where("a <= b").join(right, F.expr("label = _l AND b = _b")).where("a < b OR ta <= tb").select("label", "a", "ta", "b", "tb")
    return cut, stage(pairs, "embedding-tile-pairs")


def _compared(sides: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """(node, links, root) of every node with links in a pair of tiles."""
    width = axes.shape[0]
    steps = steps_of(width)

    def run(table: pa.Table) -> pa.Table:
        first = pc.equal(table.column("side"), 0)
        halves = [table.filter(first), table.filter(pc.invert(first))]
        same = len(halves[1]) == 0
        tiles = [Tile(_matrix(h.column("x").combine_chunks(), width), axes, steps) for h in halves[: 1 if same else 2]]
        left, right, shift = tiles[0], tiles[-1], 0 if same else len(tiles[0])
        used = halves[: len(tiles)]
        nodes, copies = (np.concatenate([h.column(c).to_numpy() for h in used]) for c in ("node", "copies"))
        order = np.argsort(nodes, kind="stable")
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        roots, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        for i, j in linked_pairs(left, right, threshold, steps, same):
            if len(i):
                np.add.at(links, i, copies[j + shift])
                np.add.at(links, j + shift, copies[i])
                roots = hang_together(roots, place[i], place[j + shift])
        some = links > 0
        return pa.table([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[order][roots[place[some]]])], ["node", "links", "root"])

    return sides.groupBy("label", "a", "ta", "b", "tb").applyInArrow(run, _FOUND)


def components(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = 8192, cell_axes: int = 1, label: str = "label",
               vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vectors`` with n_links, component_id and kept. ``threshold`` lies above 0; ``tile_rows`` bounds what a task holds and
    ``cell_axes`` says along how many axes large labels are cut; neither changes the result."""
    rows = stage(_nodes(vectors, label, vec_id, embedding), "embedding-nodes")
    given = [c for c in vectors.columns if c not in RESULTS]
    nodes = rows.where("_node = _row").select(F.col("_node").alias("node"), F.col("_label").alias("label"), F.col("_copies").alias("copies"), F.col("_x").alias("x"))
    width = nodes.agg(F.max(F.size("x")).alias("w")).first()["w"] or 1
    axes = principal_axes(nodes, width)
    celled = stage(_celled(nodes, axes, min(cell_axes, width), threshold, nodes.schema["label"].dataType.simpleString()), "embedding-celled")
    cut, pairs = _tile_pairs(celled, tile_rows)
    cut = cut.withColumnsRenamed({"label": "_l", "cell": "_c"})
    placed = join_checked(celled, cut, F.expr("label = _l AND cell = _c")).select("label", "area", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), "node", "copies", "x")
    sides = pairs.select("*", F.lit(0).alias("side"), F.col("a").alias("_area"), F.col("ta").alias("_tile")).unionByName(
        pairs.where("NOT (a = b AND ta = tb)").select("*", F.lit(1).alias("side"), F.col("b").alias("_area"), F.col("tb").alias("_tile"))
    ).withColumnRenamed("label", "_l")
    met = join_checked(placed, stage(sides, "embedding-sides"), F.expr("label = _l AND area = _area AND tile = _tile"))
    found = stage(_compared(met.select("label", "a", "ta", "b", "tb", "side", "node", "copies", "x"), axes, threshold), "embedding-links")
    links = found.groupBy("node").agg(F.sum("links").alias("_links"))
    groups = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = rows.where("_node = _row").select(F.col("_node").alias("node"), "_least").join(groups, "node")
    ids = stage(least.groupBy("root").agg(F.min("_least").alias("_component")), "embedding-components")
    known = stage(join_checked(groups, ids, "root").join(links, "node").select(F.col("node").alias("_n"), "_links", "_component"), "embedding-known")
    out = join_checked(rows, known, F.expr("_node = _n"), "left")
    component = F.when(F.col("_n").isNotNull(), F.col("_component")).otherwise(F.col("_least"))
    n_links = F.when(F.col("_node").isNotNull(), F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).otherwise(F.lit(0))
    return out.select(*[F.col(f"`{c}`") for c in given], n_links.cast("bigint").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
