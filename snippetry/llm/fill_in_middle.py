"""Fill-in-the-middle: a text is cut into units, two places split it into prefix, middle and suffix, and the middle goes last.

Each Arrow batch goes through one pipeline of pyarrow.compute calls: the texts' units become list arrays (offsets into the text
itself, no copies), lists are flattened beside the index of their parent, ordinals say where in the text a unit stands, units are
filtered by role, lists are rebuilt from them and joined, and the pieces are joined with the sentinels in the order of the form.
Long texts pass through in parts of at most ``PART`` bytes with their ordinals carried on, so a task holds one text and the
units of a few parts, whatever the length. Rows never move between tasks.

The places come from sha256 of ``seed:doc_id``: h1 to h4 are its first four 8-digit groups; the prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) units and the middle after the larger. h3 keeps a text plain, h4 chooses between the two orders:

    psm  <P> prefix <S> suffix <M> middle        spm  <S> suffix <P> prefix <M> middle

Defined cases: a null text is empty; empty texts and texts that contain a sentinel stay plain, so every output can be read back.
A null id hashes as the empty string. Repeated rows, ties of both places (an empty middle) and very long texts are ordinary.
Extra columns pass through, except ones named like a result, which are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

RESULTS = "n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
PART = 1 << 18
_SLICE = 1 << 21
_BLANKS = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        """All begin with one character that none holds elsewhere, and none begins another: so no sentinel can arise where a
        piece of text meets a sentinel."""
        marks = list(self)
        first = marks[0][:1]
        fits = all(m and m[0] == first and first not in m[1:] for m in marks)
        if not fits or any(i != j and b.startswith(a) for i, a in enumerate(marks) for j, b in enumerate(marks)):
            raise ValueError(f"sentinels {marks} could not be told from text when read back")

    def __iter__(self):
        return iter((self.prefix, self.suffix, self.middle))


def _begins(data: np.ndarray, unit: str) -> np.ndarray:
    """True at each byte with which a unit begins, if the text before it does not matter."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    begins = np.zeros(len(data), bool)
    if unit == "line":
        begins[1:] = data[:-1] == 10
    else:
        blank = _BLANKS[data]
        begins[1:] = blank[:-1] & ~blank[1:]
    return begins


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of a string array and the bytes they point into."""
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def unit_lists(texts: pa.Array, unit: str, opens: np.ndarray) -> pa.ListArray:
    """One list of units a text. ``opens`` tells which texts begin a unit; the others go on with one begun before them, so
    their first element completes it."""
    offsets, data = _bytes(texts)
    begins = _begins(data[: offsets[-1]], unit)
    begins[: offsets[0]] = False
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.append(np.flatnonzero(begins), offsets[-1]).astype(np.int32)
    units = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, offsets).astype(np.int32)), units)


def _parts(offsets: np.ndarray, data: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the parts of the texts begin, the text of each, the units that begin in earlier parts of its text, and whether a
    unit begins with it; all with one count of units a text last."""
    starts, owner, before, opens, sizes = [], [], [], [], []
    for i in range(len(offsets) - 1):
        at, end, n = int(offsets[i]), int(offsets[i + 1]), 0
        first = True
        while first or at < end:
            stop = min(at + PART, end)
            while stop < end and (data[stop] & 0xC0) == 0x80:
                stop += 1
            # One byte more in front shows whether the part begins with a unit of its own.
            lead = 0 if first else 1
            begins = _begins(data[at - lead : stop], unit)[lead:]
            own = at < stop and (first or bool(begins[0]))
            starts.append(at), owner.append(i), before.append(n), opens.append(own)
            n += int(begins[1:].sum()) + own
            at, first = stop, False
        sizes.append(n)
    starts.append(int(offsets[-1]))
    return np.array(starts, np.int32), np.array(owner, np.int64), np.array(before, np.int64), np.array(opens, bool), np.array(sizes, np.int64)


def _role(flat: pa.Array, parents: pa.Array, wanted: pa.Array, n: int) -> pa.Array:
    """The units of one role, put together again for each of n parents."""
    counts = np.bincount(pc.filter(parents, wanted).to_numpy(), minlength=n)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(ends, pc.filter(flat, wanted)), "")


def split_texts(texts: pa.Array, low: np.ndarray, high: np.ndarray, parts: tuple, unit: str) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: the units before ``low``, from there to ``high``, and from there on."""
    starts, owner, before, opens, _ = parts
    offsets, data = _bytes(texts)
    whole: list[list[pa.Array]] = [[], [], []]
    step = max(1, _SLICE // PART)
    cuts = [0]
    for i in range(1, len(owner)):
        if starts[i] - starts[cuts[-1]] >= _SLICE or (i - cuts[-1] >= step and starts[i] - starts[cuts[-1]] >= PART):
            cuts.append(i)
    for a, b in zip(cuts, [*cuts[1:], len(owner)]):
        some = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(starts[a : b + 1].copy()), pa.py_buffer(data)])
        lists = unit_lists(some, unit, opens[a:b])
        flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
        # A part that begins inside a unit counts that unit once more; its first element is the unit begun before.
        base = pa.array(before[a:b] - ~opens[a:b] - lists.offsets.to_numpy()[:-1].astype(np.int64))
        ordinals = pc.add(pa.array(np.arange(len(flat))), pc.take(base, parents))
        first = pc.less(ordinals, pc.take(pa.array(low[owner[a:b]]), parents))
        last = pc.greater_equal(ordinals, pc.take(pa.array(high[owner[a:b]]), parents))
        for out, wanted in zip(whole, (first, pc.invert(pc.or_(first, last)), last)):
            out.append(_role(flat, parents, wanted, b - a))
    of_text = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
    return [pc.binary_join(pa.ListArray.from_arrays(of_text, pa.concat_arrays(x) if x else pa.array([], pa.string())), "") for x in whole]


def _hashes(seed: str, ids: list) -> np.ndarray:
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def arrange(texts: pa.Array, ids: list, seed: str, plain_percent: int, spm_percent: int, unit: str, marks: Sentinels) -> list[pa.Array]:
    """The columns of RESULTS for one batch."""
    texts = pc.fill_null(texts, "")
    h = _hashes(seed, ids)
    parts = _parts(*_bytes(texts), unit)
    n = parts[-1]
    places = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    prefix, middle, suffix = split_texts(texts, places[:, 0], places[:, 1], parts, unit)
    held = pc.equal(pc.binary_length(texts), 0)
    for mark in marks:
        held = pc.or_(held, pc.match_substring(texts, mark))
    plain = pc.or_(held, pa.array(h[:, 2] % 100 >= 100 - plain_percent))
    spm = pa.array(h[:, 3] % 100 < spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    psm_text = pc.binary_join_element_wise(marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle, "")
    spm_text = pc.binary_join_element_wise(marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    sizes = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return [pa.array(n), form, *sizes, output]


def slices(batch: pa.RecordBatch, text: str, size: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(lengths)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def transform(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, unit: str = "char",
              marks: Sentinels = Sentinels(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_units, form, prefix_chars, middle_chars (both null where plain) and output. ``unit`` is "char" (a code
    point), "word" (with the blanks after it) or "line" (with its line end)."""
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unit {unit!r} is none of char, word, line")
    names = [f.split()[0] for f in RESULTS.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(doc_id).alias("_fim_id"), F.col(text).alias("_fim_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_fim_text"):
                ids = some.column("_fim_id").to_pylist()
                made = arrange(some.column("_fim_text"), ids, seed, plain_percent, spm_percent, unit, marks)
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(len(kept))], *made], [*kept, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(kept)]], RESULTS])
    return given.mapInArrow(run, schema)


def restore(output: str | None, form: str, marks: Sentinels = Sentinels()) -> str | None:
    """The text that ``output`` was made of."""
    if output is None or form == "plain":
        return output
    head, middle = output.split(marks.middle, 1)
    if form == "psm":
        prefix, suffix = head[len(marks.prefix) :].split(marks.suffix, 1)
    else:
        suffix, prefix = head[len(marks.suffix) :].split(marks.prefix, 1)
    return prefix + middle + suffix


def restored(rows: DataFrame, marks: Sentinels = Sentinels()) -> DataFrame:
    """``rows`` with the column restored, read from output and form alone."""
    kept = [c for c in rows.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "output"):
                texts = [restore(o, f, marks) for o, f in zip(some.column("output").to_pylist(), some.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, "restored"])

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept], "restored string"])
    return rows.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
