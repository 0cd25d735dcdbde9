"""Token-id files: independent zstandard frames with a trailing seek table and a checksum for each frame.

A shard is a file of frames that each hold whole documents, followed by the seek table of the public zstandard seekable format (a
skippable frame with each frame's compressed size, size and the low half of its XXH64). A reader goes from the end of the file
to the table and decompresses only the frames it wants, checking each. Frames carry the documents' ids and lengths, so files
describe themselves; a Parquet index with one row a document tells which file and frame holds it.

Shards are ranges of the id, sorted inside; ids are two bytes wide if the vocabulary allows, else four. A task writes its shard under
a name of its own attempt and the index names the attempts that count, so a lost executor leaves at most an unused file. A task
keeps one frame in memory.

Defined cases: a null text is an empty one and has the end id alone. Null ids come first; rows of one id go by the text. Repeated
rows are written repeatedly. An empty table gives an empty index. Extra columns are not carried.
"""

from __future__ import annotations

import array
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from snippetry.llm.common import raw
from snippetry.session import staging_path

# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_NO_ID = -(1 << 63)
_CACHED = 500_000


class Encoder:
    """Token ids of a text as little-endian bytes. With ``by_words`` a text is cut at ASCII blanks after A-Z are brought to lower
    case, each piece goes through the tokenizer's normaliser, splitter and model, and its ids are remembered. That equals encoding
    whole texts for tokenizers that lower-case, drop blanks and match nothing across them, and whose splitter keeps ASCII
    letters together and cuts a stop or comma off. Words are remembered in two generations, so common ones stay when memory
    is given back."""

    def __init__(self, path: str, width: int, by_words: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalise, self.split = self.tokenizer.model.tokenize, None, None
        self.kind, self.code = f"<u{width}", {2: "H", 4: "I"}[width]
        self.by_words = by_words
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        if by_words:
            self.normalise, self.split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.stops = {t: self._piece(t) for t in (b".", b",")}

    @classmethod
    def of_worker(cls, path: str, width: int, by_words: bool) -> Encoder:
        """The worker process's own encoder, which keeps its words from task to task."""
        shared = sys.modules.setdefault("snippetry_worker_state", types.ModuleType("snippetry_worker_state"))
        name = f"{path}:{width}:{by_words}"
        if not hasattr(shared, name):
            setattr(shared, name, cls(path, width, by_words))
        return getattr(shared, name)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a text without blanks. ASCII letters are one word to the model as they are."""
        parts = [piece.decode()] if piece.isalpha() else [p for p, _ in self.split(self.normalise(piece.decode()))]
        ids = array.array(self.code, [t.id for p in parts for t in self.model(p)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _learn(self, missing: set[bytes]) -> None:
        known, older = self.known, self.older
        for piece in missing:
            if piece in older:
                known[piece] = older[piece]
            elif piece[-1:] in self.stops and piece[-2:-1].isalpha():
                word = piece[:-1]
                known[piece] = (known.get(word) or older.get(word) or self._piece(word)) + self.stops[piece[-1:]]
            else:
                known[piece] = self._piece(piece)

    def many(self, texts: list[bytes]) -> list[bytes]:
        # The strings of special tokens are matched as they are written.
        if not self.by_words or any(b"<|" in t for t in texts):
            return [self.whole(t.decode()) if not self.by_words or b"<|" in t else self.many([t])[0] for t in texts]
        pieces = [t.lower().split() for t in texts]
        missing = set().union(*pieces).difference(self.known)
        if missing:
            self._learn(missing)
        out = [b"".join(map(self.known.__getitem__, p)) for p in pieces]
        if len(self.known) > _CACHED:
            self.known, self.older = {}, self.known
        return out


class FrameWriter:
    """Appends frames to a file and ends it with the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.sizes, self.at = out, [], 0
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress

    def add(self, data: bytes) -> tuple[int, int]:
        frame = self.compress(data)
        self.out.write(frame)
        self.sizes.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        place = (self.at, len(frame))
        self.at += len(frame)
        return place

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *x) for x in self.sizes)
        table += struct.pack("<IBI", len(self.sizes), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """Random access to the frames of a file."""

    def __init__(self, file):
        self.file = file
        n, flags, magic = struct.unpack("<IBI", self._read(file.size() - 9, 9))
        entry = 12 if flags & HAS_CHECKSUMS else 8
        if magic != SEEKABLE:
            raise ValueError("the file has no seek table")
        rows = self._read(file.size() - 9 - n * entry, n * entry)
        self.frames, at = [], 0
        for i in range(n):
            packed, size = struct.unpack_from("<II", rows, i * entry)
            check = struct.unpack_from("<I", rows, i * entry + 8)[0] if entry == 12 else None
            self.frames.append((at, packed, size, check))
            at += packed

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, number: int) -> bytes:
        at, packed, size, check = self.frames[number]
        data = zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=size)
        if check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} does not match its checksum")
        return data


def packed_frame(ids: list[int | None], tokens: list[bytes], width: int) -> bytes:
    """Number of documents and width, their ids, byte lengths and token ids."""
    head = struct.pack("<II", len(ids), width)
    numbers = np.array([_NO_ID if x is None else x for x in ids], dtype="<i8").tobytes()
    return head + numbers + np.array(list(map(len, tokens)), dtype="<i8").tobytes() + b"".join(tokens)


def unpacked_frame(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    n, width = struct.unpack_from("<II", data)
    ids = np.frombuffer(data, "<i8", n, 8).tolist()
    ends = np.cumsum(np.frombuffer(data, "<i8", n, 8 + 8 * n)).tolist()
    body = memoryview(data)[8 + 16 * n :]
    for doc, begin, end in zip(ids, [0, *ends], ends):
        yield (None if doc == _NO_ID else doc), np.frombuffer(body[begin:end], f"<u{width}")


@dataclass
class TokenFiles:
    """Where the shards lie, and their index: (doc_id, file, shard, slot, frame, place, n_tokens)."""

    path: str
    index: DataFrame


_INDEX = "doc_id bigint, file string, shard int, slot bigint, frame int, place int, n_tokens bigint"


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1, width: int = 2, by_words: bool = False,
          shard_bytes: int = 16 << 20, frame_bytes: int = 256 << 10, doc_id: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode ``docs`` with the tokenizer file and write shards of about ``shard_bytes`` of text into ``path`` (a folder that all
    executors reach, default: a staged one), the index beside them. Ask for ``by_words`` only where it suits the file (see Encoder)."""
    spark = docs.sparkSession
    path = path or staging_path(spark, "token-files")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, name = task.partitionId(), f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        encoder, end = Encoder.of_worker(tokenizer, width, by_words), end_id.to_bytes(width, "little")
        writer, slot = None, 0
        ids, tokens, held = [], [], 0

        def close_frame():
            nonlocal ids, tokens, held, slot
            frame = len(writer.sizes)
            writer.add(packed_frame(ids, tokens, width))
            n = len(ids)
            columns = [
                pa.array(ids, pa.int64()), pa.array([name] * n, pa.string()), pa.array([shard] * n, pa.int32()),
                pa.array(range(slot, slot + n), pa.int64()), pa.array([frame] * n, pa.int32()), pa.array(range(n), pa.int32()),
                pa.array([len(t) // width for t in tokens], pa.int64()),
            ]
            ids, tokens, held, slot = [], [], 0, slot + n
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "shard", "slot", "frame", "place", "n_tokens"])

        for batch in batches:
            for few in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                if writer is None:
                    store, folder = fs.FileSystem.from_uri(path)
                    store.create_dir(folder, recursive=True)
                    writer = FrameWriter(store.open_output_stream(f"{folder}/{name}", compression=None))
                for doc, encoded in zip(few.column("doc_id").to_pylist(), encoder.many(list(raw(few, "text")))):
                    ids.append(doc)
                    tokens.append(encoded + end)
                    held += len(tokens[-1])
                    if held >= frame_bytes:
                        yield close_frame()
        if ids:
            yield close_frame()
        if writer is not None:
            writer.close()

    ranged = rows.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInArrow(run, _INDEX).write.parquet(f"{path}/index")
    return open_files(spark, path)


def open_files(spark: SparkSession, path: str) -> TokenFiles:
    return TokenFiles(path, spark.read.schema(_INDEX).parquet(f"{path}/index"))


def read_all(files: TokenFiles) -> DataFrame:
    """(doc_id, shard, slot, first, n_tokens, ids_crc32) of every document, from the shards themselves: ``first`` is its first
    token's number in the shard; the checksum is over the ids as 32-bit little-endian numbers."""
    path = files.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, shard in zip(batch.column("file").to_pylist(), batch.column("shard").to_pylist()):
                with store.open_input_file(f"{folder}/{name}") as file:
                    reader, slot, first = FrameReader(file), 0, 0
                    for number in range(len(reader.frames)):
                        out = []
                        for doc, tokens in unpacked_frame(reader.frame(number)):
                            out.append((doc, shard, slot, first, len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())))
                            slot, first = slot + 1, first + len(tokens)
                        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "slot", "first", "n_tokens", "ids_crc32"])

    shards = files.index.groupBy("file", "shard").agg(F.count("*").alias("n"))
    many = max(1, files.index.agg(F.max("shard")).first()[0] or 0)
    schema = "doc_id bigint, shard int, slot bigint, first bigint, n_tokens bigint, ids_crc32 bigint"
    return shards.repartitionByRange(many, "shard").select("file", "shard").mapInArrow(run, schema)


def read_documents(files: TokenFiles, wanted: DataFrame) -> DataFrame:
    """(doc_id, token_ids) of the documents whose ids ``wanted`` holds; each frame that has one is decompressed once."""
    path = files.path
    asked = files.index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    frames = asked.groupBy("file", "frame").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, frame, places in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                with store.open_input_file(f"{folder}/{name}") as file:
                    found = list(unpacked_frame(FrameReader(file).frame(frame)))
                ids = pa.array([found[p][0] for p in places], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([found[p][1].tolist() for p in places], pa.list_(pa.int64()))], ["doc_id", "token_ids"])

    return frames.mapInArrow(run, "doc_id bigint, token_ids array<bigint>")


def starts(documents: DataFrame) -> DataFrame:
    """Adds start: the tokens of all documents before. Only the shards' totals, one row each, are summed up in order."""
    totals = documents.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(
        F.col("shard"), (F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )
    return documents.join(before, "shard").withColumn("start", F.col("before") + F.col("first")).drop("before")
