"""Removal of repeated byte strings by distributed, sparse prefix doubling.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed. A suffix array of all positions
would be sorted anew for each doubling of the compared prefix. Here prefixes start at half the length and only chosen positions take
part, in a way that loses none:

1. Of the half-length strings inside a string of the full length, the one with the smallest hash (the first of equals) is its anchor.
   Equal strings have equal anchors at the same offset, so anchors, about one in ``length`` / 4 positions, are all that is ranked.
   Spark groups them by the hash of their half-length prefix; those that are alone there are unique and drop out.
2. Of the others the pair (prefix, everything within reach of the anchor on both sides) is ranked. Where pairs are equal, all strings of
   full length around the anchor are repeated, and the anchor is done.
3. What is left lies around ends of repeats. There every string around the anchor is ranked by the pair (offset, its hash at full
   length) among the anchors of the same prefix, which passes the threshold: equal ranks are repeats.

Prefixes with more than ``crowd`` different surroundings are ranked by a Spark aggregation over (prefix, offset, hash), the others by
sorting inside tasks that hold whole prefixes, so no task's memory grows with a group.

Hashes are 64-bit polynomials; the decision in 2 and 3 rests on two of them (prefix and whole). Long texts are read in blocks
of ``BLOCK`` positions that overlap by the reach, so memory does not grow with a text.

Defined cases: null texts are empty; a text shorter than ``length`` loses nothing. Matches never cross documents. Rows repeated with the
same id and text repeat each other and are removed alike. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from snippetry.llm.common import mixed, raw, same_key, text_key
from snippetry.session import stage

BLOCK = 1 << 20
_KEY = "doc_id bigint, text_hash bigint"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64."""

    def __init__(self, n: int):
        self.up = np.full(n + 1, _BASE)
        self.down = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        self.up[0] = self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)


class Hashed:
    """Hashes of any piece of ``data`` from sums over its prefixes."""

    def __init__(self, data: np.ndarray, powers: Powers):
        self.down = powers.down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers.up[: len(data)], out=self.sums[1:])

    def pieces(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def first_least(values: np.ndarray, window: int) -> np.ndarray:
    """For each full window of ``values``, where its smallest value stands; the first of equals."""
    n = len(values)
    # The place breaks ties, so one minimum gives value and place.
    packed = (values & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    size = -(-n // window) * window
    padded = np.full(size, np.uint64((1 << 64) - 1))
    padded[:n] = packed
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchors(text: bytes, length: int, powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, prefix hashes, hashes of the surroundings) of the anchors of a text, block by block. The surroundings are the
    bytes of all strings of full length around an anchor, as far as the text goes."""
    half = length // 2
    reach = length - half
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    for start in range(0, max(n - length + 1, 0) + reach, BLOCK):
        # Anchors in [start, start + BLOCK) belong to strings that begin up to ``reach`` bytes before them.
        low, high = max(start - 2 * reach, 0), min(start + BLOCK + length + reach, n)
        if high - low < length:
            continue
        own = Hashed(data[low:high], powers)
        begin = np.arange(high - low - half + 1)
        prefix = own.pieces(begin, begin + half)
        chosen = np.unique(first_least(prefix, reach + 1)) + low
        chosen = chosen[(chosen >= start) & (chosen < start + BLOCK)]
        if not len(chosen):
            continue
        left, right = np.maximum(chosen - reach, 0), np.minimum(chosen + length, n)
        whole = own.pieces(left - low, right - low)
        # Surroundings cut by the text's ends are equal only if they are cut alike.
        whole = mixed(whole + (chosen - left).astype(np.uint64) * np.uint64(1 << 32) + (right - chosen).astype(np.uint64))
        yield chosen, prefix[chosen - low], whole


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BLOCK + 4 * length)
        names = ["doc_id", "text_hash", "place", "prefix", "whole"]

        def packed(rows):
            arrays = [pa.array([r[0] for r in rows for _ in range(len(r[2]))], pa.int64()), pa.array(np.concatenate([np.full(len(r[2]), r[1]) for r in rows]))]
            arrays += [pa.array(np.concatenate([r[i].view(np.int64) for r in rows])) for i in (2, 3, 4)]
            return pa.RecordBatch.from_arrays(arrays, names)

        rows, held = [], 0
        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), raw(batch, "text")):
                for places, prefix, whole in anchors(text or b"", length, powers):
                    rows.append((doc, key, places, prefix, whole))
                    held += len(places)
                    if held > 50_000:
                        yield packed(rows)
                        rows, held = [], 0
        if rows:
            yield packed(rows)

    return docs.mapInArrow(run, f"{_KEY}, place bigint, prefix bigint, whole bigint")


def _texts(docs: DataFrame) -> DataFrame:
    """(key, packed): texts compressed for the way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([compress(t or b"") for t in raw(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), packed], ["doc_id", "text_hash", "packed"])

    return docs.mapInArrow(run, f"{_KEY}, packed binary")


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _surroundings(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(prefix, key, place, left, bytes): what lies within reach of each place, cut at the text's ends; ``left`` bytes before it."""
    reach = length - length // 2
    listed = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "prefix")).alias("spots"))
    texts = _texts(docs)
    joined = listed.join(texts, same_key(listed, texts)).select(listed.doc_id, listed.text_hash, "spots", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix", "doc_id", "text_hash", "place", "before", "around"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        rows: list[tuple] = []
        for batch in batches:
            for doc, key, spots, packed in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "spots", "packed")]):
                text = _unpack(packed)
                for spot in spots:
                    place = spot["place"]
                    before = min(place, reach)
                    rows.append((spot["prefix"], doc, key, place, before, text[place - before : place + length]))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return joined.mapInArrow(run, f"prefix bigint, {_KEY}, place bigint, before int, around binary")


def ranks(before: list[int], around: list[bytes], length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """For each place and each offset 0 .. reach: the hash of the string of full length that begins so far before the place, and
    whether the text holds all of it."""
    reach = length - length // 2
    offsets = np.arange(reach + 1)
    hashes = np.zeros((len(around), reach + 1), np.uint64)
    valid = np.zeros(hashes.shape, bool)
    for i, (left, piece) in enumerate(zip(before, around)):
        begin = left - offsets
        ok = (begin >= 0) & (begin + length <= len(piece))
        own = Hashed(np.frombuffer(piece, np.uint8), powers)
        hashes[i, ok] = own.pieces(begin[ok], begin[ok] + length)
        valid[i] = ok
    return hashes, valid


def _runs(place: int, repeated: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """[begin, end) covered by the repeated strings, which begin ``offset`` bytes before the place."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        yield place - (b - 1), place - a + length


_SPANS = f"{_KEY}, begin bigint, end bigint"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "begin", "end"])


def _sorted_ranks(around: DataFrame, length: int) -> DataFrame:
    """Spans repeated among the surroundings of one prefix. Partitions hold whole prefixes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(3 * length)
        held: list[tuple] = []

        def judged(rows):
            hashes, valid = ranks([r[4] for r in rows], [r[5] for r in rows], length, powers)
            keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
            offsets = np.arange(hashes.shape[1], dtype=np.uint64)
            ranked = mixed(hashes + mixed(keys)[:, None] + offsets * np.uint64(0x9E3779B97F4A7C15))
            ordered = np.sort(ranked[valid])
            often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            at = np.minimum(np.searchsorted(often, ranked), max(len(often) - 1, 0))
            repeated = (often[at] == ranked) & valid if len(often) else np.zeros(ranked.shape, bool)
            return [(r[1], r[2], *span) for r, row in zip(rows, repeated) for span in _runs(r[3], row, length)]

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("prefix", "doc_id", "text_hash", "place", "before", "around")]):
                if len(held) >= 4000 and row[0] != held[-1][0]:
                    yield _span_batch(judged(held))
                    held = []
                held.append(row)
        if held:
            yield _span_batch(judged(held))

    return around.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, _SPANS)


def _counted_ranks(around: DataFrame, length: int) -> DataFrame:
    """The same for prefixes with a crowd of surroundings, by counting (prefix, offset, hash)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(3 * length)
        for batch in batches:
            for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                hashes, valid = ranks(piece.column("before").to_pylist(), piece.column("around").to_pylist(), length, powers)
                row, offset = np.nonzero(valid)
                columns = [piece.column(c).take(pa.array(row)) for c in ("prefix", "doc_id", "text_hash", "place")]
                columns += [pa.array(offset.astype(np.int32)), pa.array(hashes[valid].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["prefix", "doc_id", "text_hash", "place", "offset", "hash"])

    rows = around.mapInArrow(spread, f"prefix bigint, {_KEY}, place bigint, offset int, hash bigint")
    often = rows.groupBy("prefix", "offset", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    begin = F.col("place") - F.col("offset")
    return rows.join(often, ["prefix", "offset", "hash"]).select("doc_id", "text_hash", begin.alias("begin"), (begin + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int, crowd: int = 20_000) -> DataFrame:
    """(doc_id, text_hash, begin, end) of bytes covered by repeated strings; spans may overlap. ``docs`` has doc_id, text_hash, text."""
    if length < 4:
        raise ValueError("length must be at least 4")
    reach = length - length // 2
    placed = stage(_anchored(docs, length), "anchors")
    pairs = placed.groupBy("prefix", "whole").agg(F.count("*").alias("n"))
    shared = pairs.groupBy("prefix").agg(F.sum("n").alias("anchors"), F.count("*").alias("kinds")).where("anchors > 1").select("prefix", "kinds")
    shared = stage(shared, "shared-prefixes")
    live = placed.join(shared, "prefix")
    # One aggregation tells how often each pair occurs and names one place of it.
    named = stage(live.groupBy("prefix", "whole", "kinds").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "place")).alias("one")), "rank-pairs")
    twice = named.where("n > 1").select("prefix", "whole")
    done = live.join(twice, ["prefix", "whole"]).select("doc_id", "text_hash", (F.col("place") - reach).alias("begin"), (F.col("place") + length).alias("end"))
    # Surroundings of their own are compared with one of each other kind.
    mixed_up = named.where("kinds > 1").select("one.doc_id", "one.text_hash", "one.place", "prefix", "kinds")
    open_ = stage(mixed_up, "open-places")
    around = stage(_surroundings(docs, open_.drop("kinds"), length).join(open_.select("prefix", "kinds").distinct(), "prefix"), "surroundings")
    spans = _sorted_ranks(around.where(F.col("kinds") <= crowd), length)
    if open_.where(F.col("kinds") > crowd).head(1):
        spans = spans.union(_counted_ranks(around.where(F.col("kinds") > crowd), length))
    return done.union(spans)


def remove_repeated(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", crowd: int = 20_000) -> DataFrame:
    """(doc_id, text_hash, n_bytes, n_removed, n_spans, kept, kept_sha256), one row a document; kept are the bytes that remain."""
    source = docs.select(*text_key(doc_id, text), F.col(text).alias("text")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    spans = stage(repeated_spans(source, length, crowd), "repeated-spans")
    listed = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    texts = _texts(source)
    joined = texts.join(listed, same_key(texts, listed), "left").select(texts.doc_id, texts.text_hash, "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.string()]
        for batch in batches:
            for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                rows = []
                for doc, key, packed, own in zip(*[piece.column(c).to_pylist() for c in ("doc_id", "text_hash", "packed", "spans")]):
                    data = _unpack(packed)
                    kept, removed, n = cut(data, [(s["begin"], s["end"]) for s in own or []])
                    rows.append((doc, key, len(data), removed, n, kept, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
                )

    return joined.mapInArrow(run, f"{_KEY}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the spans, the bytes removed, and the number of maximal removed runs."""
    kept, removed, runs, reached = [], 0, 0, 0
    end_of_run = None
    for begin, end in sorted(spans):
        begin, end = max(begin, 0), min(end, len(data))
        if begin > reached or end_of_run is None:
            kept.append(data[reached:begin])
        if end_of_run is None or begin > end_of_run:
            runs += 1
        removed += max(end - max(begin, reached if end_of_run is not None else 0), 0)
        reached = max(reached, end)
        end_of_run = reached
    kept.append(data[reached:])
    return b"".join(kept), removed, runs
