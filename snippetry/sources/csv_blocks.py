"""CSV files with multi-line cells, read by many tasks a file.

Spark's line reader cuts a file into blocks and gives each block the lines that begin in it. A line break ends a record where the
number of quotes before it is even, so a first pass counts the quotes of the blocks, a running sum over a file's blocks tells
which begin inside a cell, and a second pass puts the lines of each block together. Only the pieces of records that cross a
block's edge are moved; no other text is shuffled.

Quotes must stand around cells or be doubled inside quoted ones, as write_csv() writes them and as RFC 4180 says. A file begins
with a header record. A quote left open makes what follows it one record. Blank records are skipped. Compressed files are one
block each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from snippetry.operators.bounded import BROADCAST_ROWS
from snippetry.schemas import CORPUS
from snippetry.session import stage
from snippetry.sources.corpus import NA_VALUES

_FACTS = "file string, begin bigint, odd boolean, begins boolean"
_PIECES = "file string, owner bigint, place bigint, header boolean, text string"
_PIECES_ARROW = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("place", pa.int64()), ("header", pa.bool_()), ("text", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, begin, quotes, value): the lines of each block, in order. A carriage return stays with its line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"), "value",
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, begin, from, to) of the stretches of a batch that lie in one block."""
    begin, file = batch["begin"].to_numpy(), batch["file"]
    if not batch.num_rows:
        return
    changes = (begin[1:] != begin[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield file[a].as_py(), int(begin[a]), a, b


def _block_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: is its number of quotes odd, and would a record begin in it if it began inside a cell."""
    facts: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        quotes = batch["quotes"].to_numpy()
        for file, begin, a, b in _runs(batch):
            odd, begins = facts.get((file, begin), (False, None))
            before = (odd + np.cumsum(quotes[a:b]) - quotes[a:b]) % 2 == 1
            # The first line of a block continues the cell.
            facts[file, begin] = [bool((odd + quotes[a:b].sum()) % 2), bool(before.any()) if begins is None else begins or bool(before.any())]
    keys = list(facts)
    yield pa.record_batch(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
         pa.array([facts[k][0] for k in keys], pa.bool_()), pa.array([facts[k][1] for k in keys], pa.bool_())],
        names=["file", "begin", "odd", "begins"],
    )


class _Block:
    """The record that is open while the lines of a block go by."""

    def __init__(self, file: str, begin: int, inside: bool, owner: int | None):
        self.file, self.begin, self.odd = file, begin, inside
        self.owner, self.header, self.text = (owner if inside else begin), False, None
        self.fresh = begin == 0 and not inside

    def close(self, out: list[tuple], last: bool) -> None:
        """The open record ends here, or the block does."""
        if self.text is None:
            return
        whole = self.owner == self.begin and not (last and self.odd)
        out.append((self.file, None if whole else self.owner, self.begin, self.header, self.text))
        self.text = None

    def add(self, lines: pa.Array, quotes: np.ndarray, out: list[tuple]) -> None:
        before = self.odd + np.cumsum(quotes) - quotes
        starts = np.flatnonzero(before % 2 == 0)
        head = len(lines) if not len(starts) else int(starts[0])
        if head:
            text = "\n".join(lines[:head].to_pylist())
            self.text = text if self.text is None else f"{self.text}\n{text}"
        if len(starts):
            self.close(out, False)
            offsets = pa.array(np.append(starts, len(lines)), pa.int32())
            records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n").to_pylist()
            self.owner = self.begin
            for text in records[:-1]:
                out.append((self.file, None, self.begin, self.fresh, text))
                self.fresh = False
            self.text, self.header, self.fresh = records[-1], self.fresh, False
        self.odd = bool((self.odd + quotes.sum()) % 2)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (no owner), and pieces of those that cross an edge, named by the block in which the record begins."""
    block = None
    for batch in batches:
        out: list[tuple] = []
        quotes = batch["quotes"].to_numpy()
        for file, begin, a, b in _runs(batch):
            if block is None or (block.file, block.begin) != (file, begin):
                if block is not None:
                    block.close(out, True)
                block = _Block(file, begin, batch["inside"][a].as_py(), batch["owner"][a].as_py())
            block.add(batch["value"].slice(a, b - a), quotes[a:b], out)
        yield _as_batch(out)
    if block is not None:
        out = []
        block.close(out, True)
        yield _as_batch(out)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PIECES_ARROW)], schema=_PIECES_ARROW)


def read_csv_blocks(spark: SparkSession, path: str, schema: T.StructType = CORPUS, na_values: list[str] | None = None) -> DataFrame:
    """What read_csv() reads, from blocks of files. ``spark.sql.files.maxPartitionBytes`` sets the size of a block; it must not be
    changed before the result is computed, which is an error."""
    na_values = NA_VALUES if na_values is None else na_values
    lines = _lines(spark, path)
    facts = stage(lines.select("file", "begin", "quotes").mapInArrow(_block_facts, _FACTS), "csv-blocks")
    # One row a block, so a file of a terabyte has some eight thousand.
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    inside = facts.select("*", (F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1).alias("inside"))
    begun = F.last(F.when(~F.col("inside") | F.col("begins"), F.col("begin")), ignorenulls=True)
    known = inside.select("file", "begin", "inside", begun.over(before).alias("owner"))
    if facts.count() <= BROADCAST_ROWS:
        joined = lines.join(F.broadcast(known), ["file", "begin"], "left")
    else:  # lines are dealt by block, and put back into their order there
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(known, ["file", "begin"], "left")
        joined = placed.repartition("file", "begin").sortWithinPartitions("file", "begin", "place")
    met = F.when(F.col("inside").isNull(), F.raise_error(F.lit("the blocks of the files changed while they were read")).cast("boolean"))
    pieces = joined.select("file", "begin", "quotes", "value", met.otherwise(F.col("inside")).alias("inside"), "owner").mapInArrow(_pieces, _PIECES)
    pieces = stage(pieces, "csv-records")
    crossing = pieces.where("owner IS NOT NULL").groupBy("file", "owner").agg(
        F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts")
    )
    records = pieces.where("owner IS NULL").select("header", "text").unionByName(
        crossing.select("header", F.array_join("parts.text", "\n").alias("text"))
    )
    # A closed record may end in the carriage return of a CRLF.
    records = records.select("header", F.regexp_replace("text", r"\r\z", "").alias("text")).where("trim(text) <> ''")
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    names = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(schema))), options)
    expected = F.struct(*[F.lit(f.name.lower()).alias(f"c{i}") for i, f in enumerate(schema)])
    found = F.struct(*[F.lower(names[f"c{i}"]).alias(f"c{i}") for i in range(len(schema))])
    message = F.concat(F.lit("the header names other columns: "), "text")
    body = records.where(F.when(~F.col("header"), True).when(found == expected, False).otherwise(F.raise_error(message).cast("boolean")))
    cells = body.select(F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    text = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    return cells.select(*[F.when(~F.col(c).isin(na_values), F.col(c)).alias(c) if c in text else F.col(c) for c in cells.columns])
