"""Character n-grams counted where their text lies, piece by piece, in Arrow batches.

A text is read in pieces that overlap by one character less than the longest n-gram, so that every start belongs to one piece
and every n-gram lies whole in it. Counts of the pieces of a text are added up before anything leaves the row. A task holds one
text and the n-grams of one piece, however long the text is.

Counting goes by sorting numbers: the characters that a task met are numbered, and an n-gram is the whole number that its characters'
numbers make. Texts with more different characters than fit are counted as strings.

With a vocabulary, an n-gram is looked up by its characters packed into whole numbers, three to a number, and a hash of those
that is different for every n-gram of the vocabulary. A hit is compared in full, so the counts are exact.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

PIECE = 1 << 16
# Entries that a counter holds before a task passes them on.
HELD = 300_000
# The same for n-grams held as numbers, and n-grams that are sorted at a time.
HELD_KEYS, SORTED = 1 << 21, 1 << 21
# Known n-grams after which the vectors of a batch are passed on: a batch has rows by number, whatever their texts hold.
HELD_HITS = 1 << 18
# Characters up to which a row's n-grams are counted without a shuffle.
LONG_TEXT = 1 << 20

_BITS, _PER_KEY = 21, 3
_SPARSE = pa.struct([
    pa.field("type", pa.int8(), nullable=False), pa.field("size", pa.int32()),
    pa.field("indices", pa.list_(pa.field("element", pa.int32(), nullable=False))),
    pa.field("values", pa.list_(pa.field("element", pa.float64(), nullable=False))),
])


def give_back() -> None:
    """Return freed memory to the system at the end of a task: its worker stays, beside those of other stages and the learner's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(text: str, longest: int) -> Iterator[tuple[str, int]]:
    """Parts of a text and how many starts belong to each."""
    for at in range(0, len(text), PIECE):
        yield text[at : at + PIECE + longest - 1], min(PIECE, len(text) - at)


class GramTable:
    """The numbers of a vocabulary's n-grams."""

    def __init__(self, grams: list[str], low: int, high: int):
        self.size, self.low, self.high = len(grams), low, high
        self.n_keys = -(-high // _PER_KEY)
        keys = np.zeros((self.n_keys, len(grams)), np.int64)
        for i, gram in enumerate(grams):
            for k, column in enumerate(self._keys(self._codes(gram), 1, len(gram))):
                keys[k, i] = column[0]
        self.seed = 0
        while True:
            hashes = self._hash(keys)
            if len(np.unique(hashes)) == len(hashes):
                break
            self.seed += 1
        order = np.argsort(hashes)
        self.hashes, self.keys, self.number = hashes[order], keys[:, order], order

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1

    def _keys(self, codes: np.ndarray, starts: int, n: int) -> list[np.ndarray]:
        """The packed characters of the n-grams at the first ``starts`` places, a list of columns."""
        out = []
        for k in range(self.n_keys):
            column = np.zeros(starts, np.int64)
            for j in range(min(_PER_KEY, n - k * _PER_KEY)):
                at = k * _PER_KEY + j
                column |= codes[at : at + starts] << (_BITS * j)
            out.append(column)
        return out

    def _hash(self, keys) -> np.ndarray:
        """Mixing by the finaliser of splitmix64; its constants are fixed values."""
        x = np.full(len(keys[0]), self.seed, np.uint64)
        for key in keys:
            x = x + key.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        return x

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of the known n-grams of a text, in order of their numbers."""
        total = np.zeros(self.size, np.int64)
        if self.size:
            for piece, own in pieces(text, self.high):
                codes = self._codes(piece)
                for n in range(self.low, self.high + 1):
                    starts = min(own, len(codes) - n + 1)
                    if starts <= 0:
                        continue
                    keys = self._keys(codes, starts, n)
                    hashes = self._hash(keys)
                    at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
                    known = self.hashes[at] == hashes
                    for mine, key in zip(self.keys, keys):
                        known &= mine[at] == key
                    total += np.bincount(self.number[at[known]], minlength=self.size)
        found = np.flatnonzero(total)
        return found, total[found]


def _sparse(found: list[tuple[np.ndarray, np.ndarray]], size: int) -> pa.Array:
    """Sparse vectors of (numbers, counts)."""
    ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in found])]).astype(np.int32))
    numbers, counts = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    lists = [
        pa.ListArray.from_arrays(ends, pa.array(numbers.astype(np.int32)), type=_SPARSE.field("indices").type),
        pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.float64)), type=_SPARSE.field("values").type),
    ]
    kind = pa.array(np.zeros(len(found), np.int8))
    return pa.StructArray.from_arrays([kind, pa.array([size] * len(found), pa.int32()), *lists], fields=list(_SPARSE))


def vectors(batches: Iterator[pa.Array], table: GramTable) -> Iterator[pa.Array]:
    """Sparse vectors of the texts, passed on as soon as they hold HELD_HITS numbers."""
    for texts in batches:
        found, held = [], 0
        for text in texts:
            found.append(table.counts(text.as_py() or ""))
            held += len(found[-1][0])
            if held >= HELD_HITS:
                yield _sparse(found, table.size)
                found, held = [], 0
        yield _sparse(found, table.size)
        del texts, found
    give_back()


class GramCounter(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: lower-cased text -> sparse counts over a vocabulary. A null text counts as empty."""

    vocabulary: Param[list] = Param(Params._dummy(), "vocabulary", "n-grams in the order of their numbers", typeConverter=TypeConverters.toListString)
    low: Param[int] = Param(Params._dummy(), "low", "shortest n-gram", typeConverter=TypeConverters.toInt)
    high: Param[int] = Param(Params._dummy(), "high", "longest n-gram", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "code_clean", outputCol: str = "_tf", vocabulary: list[str] | None = None, low: int = 3, high: int = 6):
        super().__init__()
        self._setDefault(inputCol="code_clean", outputCol="_tf", vocabulary=[], low=3, high=6)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        table = GramTable(*[self.getOrDefault(p) for p in (self.vocabulary, self.low, self.high)])
        shared = dataset.sparkSession.sparkContext.broadcast(table)

        @F.arrow_udf(VectorUDT())
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return vectors(batches, shared.value)

        return dataset.withColumn(self.getOutputCol(), counted(F.lower(F.col(self.getInputCol()))))


class Packer:
    """N-grams of up to ``longest`` characters as whole numbers. Characters get numbers from 1 on as they are met."""

    def __init__(self, longest: int):
        self.longest, self.bits = longest, 63 // longest
        self.of = np.zeros(0x110000, np.uint16)
        self.codes = np.zeros(1, np.uint32)

    def numbers(self, text: str, ordered: bool = False) -> np.ndarray | None:
        """The numbers of a text's characters; None if there are too many different ones, or a zero, which ends a NumPy string.
        ``ordered`` numbers the characters of this text alone, by code point."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if ordered:
            self.of[self.codes], self.codes = 0, self.codes[:1]
        own = self.of[codes]
        if not own.all():
            new = np.unique(codes[own == 0])
            if new[0] == 0 or len(self.codes) + len(new) > min(1 << self.bits, 1 << 16):
                return None
            self.of[new] = np.arange(len(self.codes), len(self.codes) + len(new))
            self.codes = np.append(self.codes, new)
            own = self.of[codes]
        return own.astype(np.int64)

    def keys(self, numbers: np.ndarray, starts: int, n: int) -> np.ndarray:
        """The n-grams at the first ``starts`` places, shorter ones where the text ends."""
        if len(numbers) < starts + n - 1:
            numbers = np.append(numbers, np.zeros(starts + n - 1 - len(numbers), np.int64))
        out = np.zeros(starts, np.int64)
        for j in range(n):
            out |= numbers[j : j + starts] << (self.bits * (self.longest - 1 - j))
        return out

    def strings(self, keys: np.ndarray) -> pa.Array:
        at = np.stack([(keys >> (self.bits * (self.longest - 1 - j))) & ((1 << self.bits) - 1) for j in range(self.longest)], axis=1)
        return pa.array(np.ascontiguousarray(self.codes[at]).view(f"<U{self.longest}").ravel(), pa.string())


class KeyCounter:
    """Counts of numbers, added up as they come."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.fresh, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.fresh.append(keys)
        self.waiting += len(keys)
        if self.waiting >= SORTED:
            self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        keys, counts = np.unique(np.concatenate(self.fresh), return_counts=True)
        self.fresh, self.waiting = [], 0
        if len(self.keys):
            keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[first], np.add.reduceat(counts[order], first)
        self.keys, self.counts = keys, counts


def _flushed(counts: Counter, name: str, ids: pa.Array) -> pa.RecordBatch:
    columns = [ids, pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
    out = pa.RecordBatch.from_arrays(columns, ["id", name, "n"])
    counts.clear()
    return out


def windows(text: str, low: int, high: int) -> Iterator[str]:
    """The n-gram of ``high`` characters at every place, or what is left of the text from ``low`` characters on."""
    for piece, own in pieces(text, high):
        for i in range(min(own, len(piece) - low + 1)):
            yield piece[i : i + high]


def window_counts(df: DataFrame, text: str, low: int, high: int, id_col: str | None = None) -> DataFrame:
    """(window, n) partial counts, one row for each window that a task met; with ``id_col`` (id, window, n), row by row."""
    key = F.lit(None).cast("int") if id_col is None else F.col(id_col)
    given = df.select(key.alias("id"), F.lower(F.col(text)).alias("text"))
    kind, by_row = given.schema["id"].dataType.simpleString(), id_col is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        of = None

        def flushed() -> pa.RecordBatch:
            return _flushed(counts, "window", pa.array([of] * len(counts), type_))

        type_ = pa.int32()
        packer, keyed = Packer(high), KeyCounter()

        def packed() -> pa.RecordBatch:
            out = [pa.nulls(len(keyed.keys), type_), packer.strings(keyed.keys), pa.array(keyed.counts)]
            keyed.clear()
            return pa.RecordBatch.from_arrays(out, ["id", "window", "n"])

        for batch in batches:
            type_ = batch.schema.field(0).type
            for i, value in enumerate(batch.column(1)):
                of = batch.column(0)[i].as_py() if by_row else None
                for piece, own in pieces(value.as_py() or "", high):
                    starts = min(own, len(piece) - low + 1)
                    numbers = packer.numbers(piece) if not by_row and starts > 0 else None
                    if numbers is not None:
                        keyed.add(packer.keys(numbers, starts, high))
                        if len(keyed.keys) > HELD_KEYS:
                            keyed.settle()
                            yield packed()
                        continue
                    counts.update([piece[i : i + high] for i in range(starts)])
                    if len(counts) > HELD:
                        yield flushed()
                if by_row and counts:
                    yield flushed()
        if counts:
            yield flushed()
        keyed.settle()
        if len(keyed.keys):
            yield packed()
        give_back()

    counted = given.mapInArrow(run, f"id {kind}, window string, n bigint")
    return counted if by_row else counted.drop("id")


def row_gram_counts(df: DataFrame, id_col: str, text: str, low: int, high: int) -> DataFrame:
    """(id, gram, n) of rows counted one by one, nothing shuffled; each row's n-grams are held at once."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(high)
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                numbers = packer.numbers(text)
                if numbers is None:
                    counts = Counter(w[:n] for w in windows(text, low, high) for n in range(low, len(w) + 1))
                    yield _flushed(counts, "gram", pa.array([batch.column(0)[i].as_py()] * len(counts), batch.schema.field(0).type))
                    continue
                found = [np.unique(packer.keys(numbers, len(text) - n + 1, n), return_counts=True) for n in range(low, min(high, len(text)) + 1)]
                if found:
                    keys, counted = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                    ids = batch.column(0).take(pa.array(np.full(len(keys), i)))
                    yield pa.RecordBatch.from_arrays([ids, packer.strings(keys), pa.array(counted)], ["id", "gram", "n"])

    return df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("text")).mapInArrow(run, f"id {kind}, gram string, n bigint")


def row_gram_summary(df: DataFrame, id_col: str, text: str, low: int, high: int) -> DataFrame:
    """(id, n, n_grams, n_distinct, first_gram, last_gram) of each row and length that its lower-cased text has n-grams of."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n", "n_grams", "n_distinct", "first_gram", "last_gram"]
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def summary(packer: Packer, text: str, numbers: np.ndarray | None, n: int) -> tuple[int, str, str]:
        if numbers is None:
            own = {text[i : i + n] for i in range(len(text) - n + 1)}
            return len(own), min(own), max(own)
        keys = np.sort(packer.keys(numbers, len(text) - n + 1, n))
        first, last = packer.strings(keys[[0, -1]]).to_pylist()
        return 1 + int(np.count_nonzero(keys[1:] != keys[:-1])), first, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(high)
        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                numbers = packer.numbers(text, ordered=True)
                rows += [(i, n, len(text) - n + 1, *summary(packer, text, numbers, n)) for n in range(low, min(high, len(text)) + 1)]
            at, *columns = zip(*rows) if rows else [[]] * len(names)
            columns = [pa.array(c, t) for c, t in zip(columns, types[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    given = df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("text"))
    out = given.mapInArrow(run, f"id {kind}, n int, n_grams bigint, n_distinct bigint, first_gram string, last_gram string")
    return out.withColumnRenamed("id", id_col)
