"""Chat formatting with typed content parts.

A message's parts (text, image, audio, document) are visited in order by ``Flattener``, which has one method a kind: text is
escaped, every attachment becomes a placeholder numbered through the message, and its reference and expanded token count are
recorded. A turn is written as ``<turn>role`` line feed ``text</turn>`` line feed. Inside roles and texts a backslash becomes
``\\\\``, ``<`` becomes ``\\l`` and, in roles, a line feed ``\\n``; so control strings and placeholders, which all begin with
``<``, never occur inside them, and reading them back is exact.

The formatted corpus has one row a turn: a conversation's text is its rows' texts in turn order, nothing between. So one
conversation may hold any number of turns without being gathered into one row. The loss mask is the span of the escaped text
in an assistant's turn.

Defined cases: null text or parts are empty, a null role is an empty one, a null conversation is one conversation, null turns
come first; rows of equal turn go by role, then text; repeated rows are repeated turns. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:int,kind:string,uri:string,tokens:bigint>"


def text_parts(text: str = "text") -> Column:
    """A message of one text part."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), *none))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column, line_feeds: bool = False) -> Column:
    """Pairs of backslashes, read from the left, are taken apart first; then each other escape stands alone."""

    def single(piece: Column) -> Column:
        piece = F.replace(piece, F.lit("\\l"), F.lit("<"))
        return F.replace(piece, F.lit("\\n"), F.lit("\n")) if line_feeds else piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), single), "\\")


class Flattener:
    """Visits the parts of a message; ``text_of`` and ``tokens_of`` are chosen by kind. Subclass it to change the placeholder
    or the token counts, which are: an image's patches of ``patch`` pixels, ``audio_rate`` tokens a second, ``page_tokens`` a
    page. Unknown kinds are attachments without tokens; a null part or kind is empty text."""

    patch, audio_rate, page_tokens = 14, 25.0, 256

    def text(self, part: Column) -> Column:
        return escaped(F.coalesce(part["text"], F.lit("")))

    def image(self, part: Column) -> Column:
        side = [F.ceil(F.coalesce(part[x], F.lit(0)) / self.patch) for x in ("width", "height")]
        return side[0] * side[1]

    def audio(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate)

    def document(self, part: Column) -> Column:
        return F.coalesce(part["pages"], F.lit(0)).cast("bigint") * self.page_tokens

    def is_text(self, part: Column) -> Column:
        return F.coalesce(part["kind"] == "text", F.lit(True))

    def tokens_of(self, part: Column) -> Column:
        kind = part["kind"]
        return (
            F.when(kind == "image", self.image(part)).when(kind == "audio", self.audio(part))
            .when(kind == "document", self.document(part)).otherwise(F.lit(0)).cast("bigint")
        )

    def placeholder(self, kind: Column, number: Column) -> Column:
        return F.concat(F.lit("<"), escaped(kind), F.lit(" "), number.cast("string"), F.lit(">"))

    def attachments(self, parts: Column) -> Column:
        found = F.filter(parts, lambda p: ~self.is_text(p))
        return F.transform(found, lambda p, i: F.struct((i + 1).alias("number"), p["kind"].alias("kind"), p["uri"].alias("uri"), self.tokens_of(p).alias("tokens")))

    def flat(self, parts: Column) -> Column:
        """Texts and placeholders joined in order; the number of an attachment counts the attachments before it."""
        number = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), lambda p: ~self.is_text(p)))
        piece = lambda p, i: F.when(self.is_text(p), self.text(p)).otherwise(self.placeholder(p["kind"], number(i)))
        return F.array_join(F.transform(parts, piece), "")


def format_turns(messages: DataFrame, parts: Column | None = None, flattener: Flattener | None = None, conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end, attachments, attachment_tokens), one row a message. Spans count
    characters from 0 and are null outside the loss."""
    flattener = flattener or Flattener()
    parts = F.coalesce(text_parts(text) if parts is None else parts, F.array().cast(f"array<{PART}>"))
    flat = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.replace(escaped(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"), F.lit("\\n")).alias("role"), parts.alias("parts"),
    )
    flat = flat.withColumn("body", flattener.flat(F.col("parts"))).withColumn("attachments", flattener.attachments(F.col("parts")))
    head = F.concat(F.lit("<turn>"), F.col("role"), F.lit("\n"))
    masked = F.col("role") == "assistant"
    return flat.select(
        "conv_id", "turn", F.concat(head, F.col("body"), F.lit("</turn>\n")).alias("formatted"),
        F.when(masked, F.length(head)).alias("loss_start"), F.when(masked, F.length(head) + F.length("body")).alias("loss_end"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, n_chars) parsed from the formatted text and its spans alone. Placeholders of
    attachments stay in the text."""
    body = F.regexp_extract("formatted", r"(?s)\A<turn>([^\n]*)\n(.*)</turn>\n\z", 2)
    role = F.regexp_extract("formatted", r"(?s)\A<turn>([^\n]*)\n(.*)</turn>\n\z", 1)
    loss = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return formatted.select(
        "conv_id", "turn", unescaped(role, line_feeds=True).alias("role"), unescaped(body).alias("text"),
        F.coalesce(unescaped(loss), F.lit("")).alias("loss_text"), F.length("formatted").alias("n_chars"),
    )


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row a conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns arrive in order and
    are hashed as they stream by, so a conversation of any length needs no more memory than a batch."""
    keyed = turns.withColumn("_no_id", F.col("conv_id").isNull())
    # Partitions by the conversation; sorted, so each conversation is one run of rows.
    ready = keyed.repartition("conv_id").sortWithinPartitions("_no_id", "conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("_no_id")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ready.select(F.col("conv_id").cast("bigint"), "role", "text", "loss_text", "n_chars").mapInArrow(_digests, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done: list[tuple] = []
    now = None

    def close():
        if now is not None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    def flush():
        columns = list(zip(*done)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        done.clear()
        return out

    for batch in batches:
        for conv, role, text, loss, chars in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if now is None or now[0] != conv:
                close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            now[3] += len(loss)
            now[4].update(loss.encode())
            now[5] += chars
        yield flush()
    close()
    yield flush()
