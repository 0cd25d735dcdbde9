"""Helpers shared by the operators: given tables, word splitting inside tasks, hashing, packed texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: a word is a run of characters other than these blanks.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = bytes(range(65, 91))
_LOWER = _UPPER.lower()
LOWERED = bytes.maketrans(_UPPER, _LOWER)
# Every ASCII byte that is neither a digit nor a letter becomes a blank; bytes of other characters stay.
ALPHANUMERIC = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that tell rows apart as far as results can differ: the id and a hash of the text."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """The null-safe join condition on text_key()."""
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_hash == right.text_hash)


def raw(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """UTF-8 bytes of a text column, one value at a time."""
    for value in batch.column(name):
        buffer = value.as_buffer()
        yield None if buffer is None else buffer.to_pybytes()


def blank_words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Runs of bytes other than the six ASCII blanks, A-Z lower-cased."""
    return [] if text is None else (text.translate(LOWERED) if lower else text).split()


def alphanumeric_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII digits and letters, lower-cased, and of all other characters beyond ASCII."""
    return [] if text is None else text.translate(ALPHANUMERIC).split()


class Ids(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit numbers (the finaliser of splitmix64; its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary_array(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow array of byte strings from one block of data and the n + 1 places where they begin and end."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)
