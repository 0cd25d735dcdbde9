"""N-gram Jaccard join with count-vector R-trees.

A document's set is that of its distinct word shingles, as 64-bit hashes. Equal sets are one node from the start. Linked sets
must meet in a block before they are compared, and no link may be missed: two linked sets of the same size class differ in at
most D shingles, so if each is dealt by hash into more than D groups, at least one group is the same in both. A group's number,
count and hash sum are its block. (A set is also dealt by the class of the smallest set that it may be linked to. A set with so few
full groups that only empty ones may agree deals out those too.) Blocks hold near copies and hardly anything else.

Nearly all blocks have one member. Keys therefore travel packed: a task deals out up to ``CHUNK`` of them at a time where it reads the
texts, sorts them and sends 13 bytes a key to buckets of the key space, where those that two sets share are found. A set goes by the
start of its digest there, so copies are one member. A chunk sends no more than two members of a key to the bucket; its others need not be
met again, as the key is known to be shared, and leave beside the buckets. So a block that a third of all sets share adds two entries a
chunk to its bucket. Blocks are neither staged nor carried along with the sets, and texts are not moved for them.

A set is looked at only if it is in as many shared blocks as it must share with any set that it is linked to (each differing shingle
changes one group, and its empty groups may not have been dealt); others, as of texts that share a passage only, are linked with nothing.

In a first round every member of a block is compared with the block's smallest node: that is linear in the block, and most
blocks are connected by it. In the second, only blocks that still hold several components are looked at. A block of at most
``LEAF`` members gives the pairs between components, by an R-tree of its points if it would fill more than one box. A pair
is compared once however many blocks it shares, and only if it shares as many as linked sets of its sizes must (each differing
shingle changes one group; a pair left by the first round has all its blocks here). A larger block is cut into leaves of
``LEAF`` points, leaves whose boxes cannot meet the overlap bound are left alone, and the others are joined by an R-tree,
comparing only members of different components. Before any comparison the summed coordinate minima of the count vectors must
reach the overlap that the similarity asks for.

Defined cases: null and blank texts have no set, are linked with nothing and are their own component. A text of fewer words than
a shingle has its whole sequence as the one shingle. Ids may repeat: a component is named by its smallest id (null if all are).
Extra columns are not carried.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from snippetry.llm import count_tree
from snippetry.llm.common import Ids, blank_words, mixed, raw, same_key, text_key
from snippetry.llm.graph import connected
from snippetry.operators.bounded import join_checked
from snippetry.session import stage, stage_scope

LEAF = 256
# Keys that a task deals out at a time, and shingles of all sets to a bucket.
CHUNK = 1 << 19
BUCKET = 1 << 20
_KEY_BYTES = 6
_SHORT_BYTES = 7
_SETS = "doc_id bigint, text_hash bigint, n bigint, digest binary, fewest bigint, undealt bigint"


def word_hashes(texts: list[list[bytes]]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text; each distinct word is hashed once."""
    ids = Ids()
    numbers = [np.fromiter(map(ids.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), dtype=np.uint64, count=len(ids))
    return [hashes[n] for n in numbers]


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    n = len(words)
    if not n:
        return words
    size = min(n, shingle)
    out = mixed(words[: n - size + 1] + np.uint64(size if size < shingle else 0))
    for i in range(1, size):
        out = mixed(out + words[i : n - size + 1 + i])
    return np.unique(out)


class Blocks:
    """Deals sets into groups so that linked sets share one."""

    def __init__(self, percent: int):
        self.percent = percent
        # Below this size linked sets are equal.
        self.smallest = -(-percent // (100 - percent)) if percent < 100 else 1 << 40
        self.starts, start = [], self.smallest
        while start < 1 << 40:
            self.starts.append(start)
            start = max(start + 1, start * 3 // 2)

    def _class(self, size: int) -> int:
        return bisect.bisect_right(self.starts, size) - 1

    def differing(self, k: int) -> int:
        """Most shingles in which linked sets differ if the smaller one is of class k."""
        a = self.starts[k + 1] - 1
        b = 100 * a // self.percent
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def groups(self, k: int) -> int:
        d = self.differing(k)
        return d + d // 5 + 2

    def least_shared(self, a: np.ndarray, b: np.ndarray, undealt: np.ndarray) -> np.ndarray:
        """Fewest blocks that linked sets of a and b shingles share if one of them left out ``undealt`` empty groups."""
        k = np.searchsorted(self.starts, np.minimum(a, b), side="right") - 1
        groups = np.array([self.groups(i) for i in range(int(k.max(initial=0)) + 1)], dtype=np.int64)
        return groups[k] - (a + b - 2 * count_tree.needed(a, b, self.percent)) - undealt

    def _groups(self, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(class, number of groups, group of each shingle) for every class of the smaller of two linked sets, one of them this."""
        n = len(hashes)
        if n < self.smallest:
            return
        for k in range(self._class(max(-(-self.percent * n // 100), self.smallest)), self._class(n) + 1):
            m = self.groups(k)
            yield k, m, ((hashes >> np.uint64(16)) % np.uint64(m)).astype(np.int64)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, int]:
        """The blocks of a set, and how many empty groups it left out of the class where these are most."""
        out, undealt = [np.zeros(0, np.uint64)], 0
        sums = mixed(hashes + np.uint64(0x51ED270B))
        for k, m, group in self._groups(hashes):
            counts = np.bincount(group, minlength=m).astype(np.uint64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, group, sums)
            keys = mixed(mixed(total + counts) + np.arange(m, dtype=np.uint64) + np.uint64(k << 40))
            full = counts > 0
            out.append(keys if int(full.sum()) <= self.differing(k) else keys[full])
            undealt = max(undealt, m - len(out[-1]))
        return np.concatenate(out), undealt

    def bounds(self, hashes: np.ndarray) -> tuple[int, int]:
        """Fewest blocks that the set shares with any other that it is linked to, and the empty groups that it leaves out, as above.
        Of the groups that two sets agree in, no more are left out by either than are empty in this one."""
        n, fewest, undealt = len(hashes), [], 0
        for k, m, group in self._groups(hashes):
            empty = m - int(np.count_nonzero(np.bincount(group, minlength=m)))
            other = 100 * n // self.percent if k == self._class(n) else self.starts[k + 1] - 1
            fewest.append(m - (n + other) * (100 - self.percent) // (100 + self.percent) - empty)
            undealt = max(undealt, empty if m - empty > self.differing(k) else 0)
        return min(fewest, default=0), undealt


def sets(docs: DataFrame, shingle: int, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: key, set size, digest of the set and the bounds of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(percent)
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [shingle_set(w, shingle) for w in word_hashes([blank_words(t) for t in raw(piece, "text")])]
                sizes = pa.array([len(own) for own in found], pa.int64())
                digests = pa.array([xxhash.xxh3_128_digest(own.tobytes()) for own in found], pa.binary())
                bounds = [pa.array(c, pa.int64()) for c in np.array([blocks.bounds(own) for own in found], np.int64).reshape(-1, 2).T]
                columns = [piece.column("doc_id"), piece.column("text_hash"), sizes, digests, *bounds]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "digest", "fewest", "undealt"])

    source = docs.select(*text_key(doc_id, text), F.col(text).alias("text")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return source.mapInArrow(run, _SETS)


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, undealt) of ``nodes`` (node, doc_id, text_hash, undealt). A row of ``docs`` that is repeated whole gives its node again. Texts
    stay where they are while the nodes are few."""
    return join_checked(docs, nodes, same_key(docs, nodes)).select("node", "text", "undealt")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, n, hashes, point, undealt) of ``wanted`` (node, doc_id, text_hash, undealt), from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [shingle_set(w, shingle) for w in word_hashes([blank_words(t) for t in raw(piece, "text")])]
                yield pa.RecordBatch.from_arrays([
                    piece.column("node"), pa.array([len(own) for own in found], pa.int64()), pa.array([own.tobytes() for own in found], pa.binary()),
                    pa.array([count_tree.point(own).astype("<u4").tobytes() for own in found], pa.binary()), piece.column("undealt"),
                ], ["node", "n", "hashes", "point", "undealt"])

    return _texts_of(docs, wanted).mapInArrow(run, "node bigint, n bigint, hashes binary, point binary, undealt bigint")


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.int64)


def _ordered(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) by key, then node, and where each key begins."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    return keys, nodes, np.flatnonzero(np.concatenate([np.ones(len(keys[:1]), bool), keys[1:] != keys[:-1]]))


def shared_blocks(docs: DataFrame, shingles: int, shingle: int, percent: int, chunk: int | None = None, bucket: int | None = None) -> DataFrame:
    """(key, short) of every block that two different sets or more share, with rows that may repeat. ``shingles`` is about how many
    all sets hold. A key is 48 bits of a block: where two blocks happen to have the same, a pair more is looked at. short is the
    start of a set's digest."""
    most = chunk or CHUNK
    buckets = max(1, -(-shingles // (bucket or BUCKET)))

    def cells(keys: np.ndarray, nodes: np.ndarray, beside: int) -> Iterator[pa.RecordBatch]:
        keys, nodes, starts = _ordered(keys, nodes)
        if not len(keys):
            return
        place = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        home = np.where(place < 2, keys % buckets, beside)
        order = np.argsort(home, kind="stable")
        keys, nodes, home = keys[order], nodes[order], home[order]
        cuts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        ends = np.append(cuts[1:], len(home))
        rows = [(int(home[i]), _packed(keys[i:j], _KEY_BYTES), _packed(nodes[i:j], _SHORT_BYTES)) for i, j in zip(cuts.tolist(), ends.tolist())]
        types = [pa.int64(), pa.binary(), pa.binary()]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000]), types)], ["bucket", "keys", "shorts"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held, size, number = Blocks(percent), {}, 0, 0
        # Members that leave beside the buckets have a number below zero of their task and chunk.
        first = -1 - (TaskContext.get().partitionId() << 32)

        def full() -> Iterator[pa.RecordBatch]:
            of = np.repeat(np.fromiter(held, np.int64, len(held)), [len(x) for x in held.values()])
            keys = np.concatenate(list(held.values()))
            held.clear()
            return cells(keys, of, first - number)

        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                for words in word_hashes([blank_words(t) for t in raw(piece, "text")]):
                    own = shingle_set(words, shingle)
                    short = int.from_bytes(xxhash.xxh3_128_digest(own.tobytes())[:_SHORT_BYTES], "big")
                    if len(own) < blocks.smallest or short in held:
                        continue
                    held[short] = (blocks.of(own)[0] >> np.uint64(64 - 8 * _KEY_BYTES)).view(np.int64)
                    size += len(held[short])
                    if size >= most:
                        yield from full()
                        size, number = 0, number + 1
        if held:
            yield from full()

    def meet(table: pa.Table) -> pa.Table:
        keys = _unpacked(b"".join(table.column("keys").to_pylist()), _KEY_BYTES)
        nodes = _unpacked(b"".join(table.column("shorts").to_pylist()), _SHORT_BYTES)
        if table.column("bucket")[0].as_py() >= 0:
            keys, nodes, starts = _ordered(keys, nodes)
            members = np.diff(np.append(starts, len(keys)))
            kept = np.repeat(members > 1, members)
            keys, nodes = keys[kept], nodes[kept]
        return pa.table([pa.array(keys), pa.array(nodes)], names=["key", "short"])

    packed = docs.select("text").mapInArrow(deal, "bucket bigint, keys binary, shorts binary")
    return packed.groupBy("bucket").applyInArrow(meet, "key bigint, short bigint")


def short_digest(digest: str) -> Column:
    """The start of a digest as a number."""
    return F.conv(F.hex(F.substring(digest, 1, _SHORT_BYTES)), 16, 10).cast("bigint")


def _verified(pairs: DataFrame, hashes: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. Pairs that the points or (where the pairs have it) the number of shared blocks rule out
    never meet their sets."""
    counted = "shared" in pairs.columns

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(percent)
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1).astype(np.int64) for c in ("pa", "pb"))
            keep = np.minimum(p, q).sum(axis=1) >= count_tree.needed(p.sum(axis=1), q.sum(axis=1), percent)
            if counted:
                undealt = np.maximum(*(np.asarray(batch.column(c)) for c in ("ua", "ub")))
                keep &= np.asarray(batch.column("shared")) >= blocks.least_shared(p.sum(axis=1), q.sum(axis=1), undealt)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("ha", "hb")]
            keep = [count_tree.similar(x, y, percent) for x, y in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both(df: DataFrame, table: DataFrame, *values: str) -> DataFrame:
        for side in ("a", "b"):
            df = df.join(table.select(F.col("node").alias(side), *[F.col(v).alias(v[0] + side) for v in values]), side)
        return df

    kept = both(pairs, points, "point", "undealt").mapInArrow(possible, "a bigint, b bigint")
    return both(kept, hashes, "hashes").mapInArrow(linked, "a bigint, b bigint")


def _leaf_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(key, i, j) of the leaves of a block that may hold a link between different components."""

    def boxes(table: pa.Table) -> pa.Table:
        p = np.frombuffer(b"".join(table.column("point").to_pylist()), "<u4").reshape(table.num_rows, -1)
        root, n = np.asarray(table.column("root")), np.asarray(table.column("n"))
        row = [table.column("key")[0].as_py(), table.column("leaf")[0].as_py(), p.max(axis=0).tobytes(), n.min(), root.min(), root.max()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=["key", "leaf", "upper", "least", "low", "high"])

    box = stage(members.groupBy("key", "leaf").applyInArrow(boxes, "key bigint, leaf bigint, upper binary, least bigint, low bigint, high bigint"), "leaves")
    a, b = (box.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("leaf", "upper", "least", "low", "high")]) for s in "ab")
    met = a.join(b, "key").where("leaf_a <= leaf_b AND NOT (low_a = high_a AND low_b = high_b AND low_a = low_b)")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("upper_a", "upper_b"))
            least = [np.asarray(batch.column(f"least_{s}")) for s in "ab"]
            keep = count_tree.bound(p, q) >= count_tree.needed(*least, percent)
            yield batch.select(["key", "leaf_a", "leaf_b"]).filter(pa.array(keep)).rename_columns(["key", "i", "j"])

    return met.mapInArrow(meet, "key bigint, i bigint, j bigint")


def _tree_joined(members: DataFrame, hashes: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Links between components inside blocks. ``members`` are (key, node, root, n, point)."""
    placed = members.withColumn("leaf", F.floor((F.row_number().over(W.partitionBy("key").orderBy("root", "n", "node")) - 1) / leaf))
    placed = stage(placed, "leaf-members")
    pairs = stage(_leaf_pairs(placed, percent), "leaf-pairs")
    full = placed.join(hashes, "node")
    left = pairs.join(full, (pairs.key == full.key) & (pairs.i == full.leaf)).select(pairs.key, "i", "j", F.lit(0).alias("side"), "node", "root", "hashes", "point")
    right = pairs.where("i < j").join(full, (pairs.key == full.key) & (pairs.j == full.leaf)).select(pairs.key, "i", "j", F.lit(1).alias("side"), "node", "root", "hashes", "point")

    def run(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for side, node, root, own, p in zip(*[table.column(c).to_pylist() for c in ("side", "node", "root", "hashes", "point")]):
            sides[side].append((node, root, np.frombuffer(own, np.uint64), np.frombuffer(p, "<u4").astype(np.int64)))
        found = list(count_tree.links(sides[0], sides[1] or None, percent))
        return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return left.union(right).groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, like) pairs between components that an R-tree of a block's points cannot rule out. ``members`` are (key, like, node,
    root, n, point) of blocks of at most a leaf, so a member has no more partners than that."""

    def run(table: pa.Table) -> pa.Table:
        node, root, n = (np.asarray(table.column(c)) for c in ("node", "root", "n"))
        points = np.frombuffer(b"".join(table.column("point").to_pylist()), "<u4").reshape(table.num_rows, -1).astype(np.int64)
        tree = count_tree.CountTree(points, n)
        found = [np.zeros((2, 0), np.int64)]
        for k in range(table.num_rows):
            near = tree.near(points[k], n[k], percent)
            near = near[(near < k) & (root[near] != root[k])]
            found.append(np.stack([np.minimum(node[near], node[k]), np.maximum(node[near], node[k])]))
        a, b = np.concatenate(found, axis=1)
        like = np.full(len(a), table.column("like")[0].as_py(), np.int64)
        return pa.table([a, b, like], names=["a", "b", "like"])

    return members.groupBy("key").applyInArrow(run, "a bigint, b bigint, like bigint")


def _leaf_joined(members: DataFrame, hashes: DataFrame, points: DataFrame, percent: int, few: int) -> DataFrame:
    """The same for blocks of at most a leaf, which stand for ``like`` blocks of the same members each. Each pair is compared once
    if its blocks suffice. (Pairs that share a larger block too are compared there.)"""
    small = members.where(F.col("m") <= few)
    a = small.select("key", "like", F.col("node").alias("a"), F.col("root").alias("root_a"))
    b = small.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = a.join(b, "key").where("a < b AND root_a <> root_b").select("a", "b", "like")
    pairs = pairs.union(_tree_pairs(members.where(F.col("m") > few).select("key", "like", "node", "root", "n", "point"), percent))
    return _verified(stage(pairs.groupBy("a", "b").agg(F.sum("like").alias("shared")), "block-pairs"), hashes, points, percent)


def links(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, leaf: int = LEAF, few: int = count_tree.FAN_OUT) -> DataFrame:
    """(a, b) links between ``nodes`` (node, digest, doc_id, text_hash, n, fewest, undealt) that connect all whose sets are similar enough."""
    with stage_scope(docs.sparkSession) as scope:
        return scope.keep(_links(docs, nodes, shingle, percent, leaf, few))


def _links(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, leaf: int, few: int) -> DataFrame:
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    dealt = stage(shared_blocks(docs, shingles, shingle, percent).distinct(), "shared-blocks")
    # A set in fewer shared blocks than it shares with any that it is linked to is linked with none. Should two sets have the same
    # short digest, both become members.
    held = dealt.groupBy("short").agg(F.count("*").alias("held"))
    linkable = nodes.withColumn("short", short_digest("digest")).join(held, "short").where("held >= fewest")
    linkable = stage(linkable.select("short", "node", "doc_id", "text_hash", "undealt"), "candidates")
    dealt = stage(join_checked(dealt, linkable.select("short", "node"), "short").select("key", "node"), "block-nodes")
    shared = dealt.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    members = stage(dealt.join(shared, "key"), "block-members")
    others = members.where("node <> pivot")
    beside = stage(others.where("m > 2").groupBy("node").agg(F.count("*").alias("beside")), "other-blocks")
    pairs = others.groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"), F.count_if(F.col("m") > 2).alias("known"))
    for side in "ab":
        pairs = pairs.join(beside.select(F.col("node").alias(side), F.col("beside").alias(f"beside_{side}")), side, "left").fillna(0, [f"beside_{side}"])
    # Blocks that a smaller set is the pivot of may be shared too.
    shared = F.col("shared") + F.least("beside_a", F.col("beside_b") - F.col("known"))
    pairs = stage(pairs.select("a", "b", shared.alias("shared")), "pivot-pairs")
    found = stage(_sets_of(docs, linkable.drop("short"), shingle), "candidate-sets")
    rows, once = found.agg(F.count("*"), F.count_distinct("node")).first()
    if rows > once:
        # Rows repeated with the same id and text give the same set.
        found = stage(found.dropDuplicates(["node"]), "candidate-sets")
    hashes, wanted = found.select("node", "hashes"), found.select("node", "n", "point", "undealt")
    first = stage(_verified(pairs, hashes, wanted, percent), "pivot-links")
    roots = connected(first)
    # The pivot has been compared with all. Blocks whose other members are of several components yet are left; of blocks with the
    # same members one is enough.
    placed = members.where("node <> pivot").select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    state = placed.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")
    )
    open_ = state.where("low <> high").groupBy("m", "sum").agg(F.min("key").alias("key"), F.count("*").alias("like")).select("key", "m", "like")
    rest = stage(placed.join(open_, "key").join(wanted.select("node", "n", "point"), "node"), "open-blocks")
    if not rest.head(1):
        return first
    found = first.union(_leaf_joined(rest.where(F.col("m") <= leaf), hashes, wanted, percent, few))
    crowded = rest.where(F.col("m") > leaf).drop("m", "like")
    return stage(found.union(_tree_joined(crowded, hashes, percent, leaf)) if crowded.head(1) else found, "all-links")


def components(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, root, component_id), one row a document. component_id is the smallest id of the documents
    that links reach; root numbers the component (null without words)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    rows = stage(sets(source, shingle, percent), "shingle-sets")
    grouped = rows.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("key"), *[F.first(c).alias(c) for c in ("n", "fewest", "undealt")]
    )
    nodes = grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "key.doc_id", "key.text_hash", "n", "fewest", "undealt")
    nodes = stage(nodes, "set-nodes")
    roots = connected(links(source, nodes, shingle, percent))
    placed = nodes.select("node", "digest", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stage(placed, "placed-nodes")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(named, "root").select("digest", "root", "component_id")
    out = rows.select("doc_id", "text_hash", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root", component.alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one of smallest id (then text hash), untouched; rows without words stay."""
    found = stage(components(docs.select("doc_id", "text"), shingle, percent), "components")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(key).alias("k")).select("k.doc_id", "k.text_hash")
    blank = found.where("root IS NULL").select("doc_id", "text_hash").distinct()
    keep = stage(first.withColumn("worded", F.lit(True)).union(blank.withColumn("worded", F.lit(False))), "kept-documents")
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    kept = keyed.join(keep.withColumnRenamed("doc_id", "_doc_id"), keyed.doc_id.eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("text_hash")))
    repeated = found.where("root IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.head(1):
        # Rows repeated whole would stay together; one of them is enough.
        once = kept.where("worded").dropDuplicates(["doc_id", "_hash"])
        kept = once.union(kept.where("NOT worded"))
    return kept.select(*docs.columns)
