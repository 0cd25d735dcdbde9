"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into segments of whole documents; every segment has one row a term with the places where the
term occurs (gaps between them, compressed by Parquet), and one row a document with its first place. The index is written once.

A benchmark item is cut into windows of consecutive words. Terms are counted over the whole index; each window then looks up
its rarest term first, takes the term's offset off its places, and intersects with the next rarer term's, until no place
is left or all terms agree. With ``slop`` a term may stand that many words from its place: a proximity match; without any shift it
is a phrase. Segments are independent, so a match needs no shuffle but that of the postings of benchmark terms.

The benchmark is taken in blocks of at most ``block_words`` words, so what tasks are sent has a fixed bound.

Defined cases: a null or empty text has no words, an item without words has no window, an item with fewer than ``window`` words is one
window. Repeated documents are found each by itself; repeated items count once by their id (null: the text "null"). Documents
lie ``GAP`` places apart, so no match crosses from one into the next. Extra columns are not carried by the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snippetry.llm.common import Ids, alphanumeric_words, binary_array, raw, text_key
from snippetry.session import stage

GAP = 64
_INDEX = "segment bigint, term string, n bigint, gaps binary, doc_id bigint, text_hash bigint, first bigint"
_NAMES = ["segment", "term", "n", "gaps", "doc_id", "text_hash", "first"]
_MATCHES = "segment bigint, first bigint, item_id string, begin bigint, end bigint, phrase boolean"


class _Segment:
    """The words of some documents, in order."""

    def __init__(self):
        self.ids, self.parts, self.places, self.docs, self.next = Ids(), [], [], [], 0

    def add(self, doc_id: int | None, text_hash: int, words: list[bytes]) -> None:
        self.docs.append((doc_id, text_hash, self.next, len(words)))
        if words:
            self.parts.append(np.fromiter(map(self.ids.__getitem__, words), dtype=np.int32, count=len(words)))
            self.places.append(self.next)
        self.next += len(words) + GAP

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row a term, then a row a document."""
        if self.parts:
            terms = np.concatenate(self.parts)
            at = np.concatenate([np.arange(p, p + len(x), dtype=np.int64) for p, x in zip(self.places, self.parts)])
            order = np.argsort(terms, kind="stable")
            at, terms = at[order], terms[order]
            begins = np.flatnonzero(np.diff(terms, prepend=-1))
            gaps = np.diff(at, prepend=0)
            gaps[begins] = at[begins]
            ends = np.append(begins[1:], len(terms))
            yield self._batch(
                number, pa.array(list(self.ids), pa.binary()).cast(pa.string()), ends - begins,
                binary_array(gaps.astype("<u4"), np.append(begins, len(terms)) * 4), None,
            )
        yield self._batch(number, None, np.array([d[3] for d in self.docs]), None, self.docs)

    def _batch(self, number, terms, counts, gaps, docs) -> pa.RecordBatch:
        n = len(counts)
        columns = [
            pa.array(np.full(n, number)), terms if terms is not None else pa.nulls(n, pa.string()), pa.array(counts.astype(np.int64)),
            gaps if gaps is not None else pa.nulls(n, pa.binary()),
            *[pa.array([d[i] for d in docs], pa.int64()) if docs else pa.nulls(n, pa.int64()) for i in range(3)],
        ]
        return pa.RecordBatch.from_arrays(columns, _NAMES)


@dataclass
class PositionalIndex:
    rows: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.rows.where("term IS NOT NULL").select("segment", "term", "n", "gaps")

    @property
    def documents(self) -> DataFrame:
        """(segment, doc_id, text_hash, first, n_words)"""
        return self.rows.where("term IS NULL").select("segment", "doc_id", "text_hash", "first", F.col("n").alias("n_words"))


def build_index(docs: DataFrame, segment_words: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> PositionalIndex:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, segment = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist())
            for (doc, key), value in zip(keys, raw(batch, "text")):
                segment.add(doc, key, alphanumeric_words(value))
                if segment.next >= segment_words:
                    yield from segment.rows(number)
                    number, segment = number + 1, _Segment()
        if segment.docs:
            yield from segment.rows(number)

    source = docs.select(*text_key(doc_id, text), F.col(text).alias("text"))
    source = source.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return PositionalIndex(stage(source.mapInArrow(run, _INDEX), "positional-index"))


def _blocks(benchmark: DataFrame, block_words: int, item_id: str, text: str) -> Iterator[list[tuple[str, list[str]]]]:
    """Items with words, in blocks; read partition by partition."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(text).alias("text"))
    block, held = [], 0
    for row in rows.where("text IS NOT NULL").toLocalIterator():
        words = [w.decode() for w in alphanumeric_words(row["text"].encode())]
        if words:
            block.append((row["id"], words))
            held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _windows(items: list[tuple[str, list[str]]], window: int, counts: dict[str, int]) -> list[tuple[str, int, list[tuple[str, int]]]]:
    """(item, length, [(term, offset), rarest first]) of every window whose terms all occur."""
    out = []
    for item, words in items:
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            slots = sorted((counts.get(w, 0), o, w) for o, w in enumerate(words[i : i + size]))
            if slots[0][0]:
                out.append((item, size, [(w, o) for _, o, w in slots]))
    return out


def _starts(slots: list[tuple[str, int]], places: dict[str, np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window begins, and whether every term stands exactly at its offset there."""
    term, offset = slots[0]
    at = places[term] - offset
    exact = np.ones(len(at), dtype=bool)
    for term, offset in slots[1:]:
        own = places[term]
        i = np.searchsorted(own, at + (offset - slop))
        near = own[np.minimum(i, len(own) - 1)]
        hit = (i < len(own)) & (near <= at + (offset + slop))
        if slop:
            j = np.minimum(np.searchsorted(own, at + offset), len(own) - 1)
            exact &= own[j] == at + offset
        at, exact = at[hit], exact[hit]
        if not len(at):
            break
    return at, exact


def _joined(at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    order = np.argsort(at, kind="stable")
    begin = end = None
    for a, b in zip(at[order].tolist(), (at + size)[order].tolist()):
        if end is not None and a <= end:
            end = max(end, b)
        else:
            if end is not None:
                yield begin, end
            begin, end = a, b
    if end is not None:
        yield begin, end


def matches(index: PositionalIndex, benchmark: DataFrame, window: int = 10, slop: int = 0, block_words: int = 1_000_000,
            item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(segment, first, item_id, begin, end, phrase): spans [begin, end) of places covered by an item's windows in the document
    whose first place is ``first``; those with phrase hold only exact occurrences, the others all within ``slop``."""
    if slop < 0 or slop and slop + window > GAP:
        raise ValueError(f"slop and window must come to {GAP} places at most, as documents lie that far apart")
    spark = benchmark.sparkSession
    found = spark.createDataFrame([], _MATCHES)
    for block in _blocks(benchmark, block_words, item_id, text):
        terms = spark.createDataFrame([(t,) for t in sorted({w for _, words in block for w in words})], "term string")
        # Bounded by block_words, so it may be broadcast.
        postings = index.postings.join(F.broadcast(terms), "term")
        counts = {r["term"]: r["n"] for r in postings.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        asked = spark.sparkContext.broadcast(_windows(block, window, counts))
        firsts = index.documents.groupBy("segment").agg(F.sort_array(F.collect_list("first")).alias("firsts"))


        packed = postings.select("segment", "term", "gaps", F.lit(None).cast("array<bigint>").alias("firsts")).unionByName(
            firsts.select("segment", F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("gaps"), "firsts")
        )
        found = found.unionByName(packed.groupBy("segment").applyInArrow(_matcher(asked, slop), _MATCHES))
    return found


def _matcher(asked, slop: int):
    def run(table: pa.Table) -> pa.Table:
        return _matched(table, asked.value, slop)

    return run


def _matched(table: pa.Table, asked: list, slop: int) -> pa.Table:
    places, firsts = {}, None
    for term, gaps, starts in zip(*[table.column(c).to_pylist() for c in ("term", "gaps", "firsts")]):
        if term is None:
            firsts = np.array(starts, dtype=np.int64)
        else:
            places[term] = np.frombuffer(gaps, "<u4").cumsum(dtype=np.int64)
    hits: dict[tuple[str, bool], list[tuple[np.ndarray, int]]] = {}
    for item, size, slots in asked:
        if any(t not in places for t, _ in slots):
            continue
        at, exact = _starts(slots, places, slop)
        if len(at):
            hits.setdefault((item, False), []).append((at, size))
            if exact.any():
                hits.setdefault((item, True), []).append((at[exact], size))
    segment = table.column("segment")[0].as_py()
    rows = []
    for (item, phrase), own in hits.items():
        if phrase or slop:
            at = np.concatenate([a for a, _ in own])
            size = np.concatenate([np.full(len(a), s) for a, s in own])
            for begin, end in _joined(at, size):
                first = int(firsts[np.searchsorted(firsts, begin, side="right") - 1]) if begin >= 0 else 0
                rows.append((segment, first, item, begin, end, phrase))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
    return pa.table(columns, names=["segment", "first", "item_id", "begin", "end", "phrase"])


def contamination(index: PositionalIndex, found: DataFrame) -> DataFrame:
    """Every document with n_words, n_hit (words inside phrase matches), items (their ids, sorted) and n_near (items with a
    proximity match only)."""
    phrases = found.where("phrase")
    digest = phrases.groupBy("segment", "first").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans")
    )
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'reach', 0L), (a, s) -> named_struct("
        "'n', a.n + greatest(0L, s.end - greatest(s.begin, a.reach)), 'reach', greatest(a.reach, s.end)), a -> a.n)"
    )
    near = found.groupBy("segment", "first").agg(F.collect_set("item_id").alias("all_items"))
    out = index.documents.join(digest, ["segment", "first"], "left").join(near, ["segment", "first"], "left")
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    return out.select(
        "doc_id", "text_hash", "n_words", F.coalesce(F.when(F.col("spans").isNotNull(), covered), F.lit(0)).alias("n_hit"), items.alias("items"),
        (F.size(F.coalesce("all_items", none)) - F.size(items)).cast("bigint").alias("n_near"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.0) -> DataFrame:
    """The documents of whose words at most ``max_share`` lie in phrase matches, untouched."""
    index = build_index(docs)
    judged = contamination(index, matches(index, benchmark, window))
    dirty = judged.where(F.col("n_hit") > F.lit(max_share) * F.col("n_words")).select("doc_id", "text_hash").distinct()
    dirty = stage(dirty, "contaminated").withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("text_hash", "_text_hash")
    hashed = F.xxhash64(F.col("text"))
    return docs.join(dirty, docs.doc_id.eqNullSafe(dirty._doc_id) & (hashed == dirty._text_hash), "left_anti")
