"""Language identification, word first with back-off to shorter character n-grams.

A word of the lexicon scores its log frequency in each language. An unseen word falls back to its longest character n-grams
(with marks at both ends) of which any is known, and scores their mean log frequency; if no single character is known the
word says nothing. A document's score adds up its words.

Training counts all words of all labelled rows: tasks count what they read, Spark adds up by (language, word). N-grams are
counted from those totals. Every counted word and n-gram is kept, in staged tables. Tasks hold the ``lexicon`` most frequent
words, which only saves work: all other words of the documents are joined to the tables, word rows first, n-gram rows for words
without one, and their scores added up by text. Results do not depend on ``lexicon``.

Frequencies are relative to what was counted in a language, and every item gets the same small one on top in all languages
(``smooth`` occurrences in the whole corpus). So languages in which a word does not occur score it alike, however much text they
have, and none of them beats one in which it occurs.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned. Null
labels are not learned. Equal scores go to the language first in code point order. Rows are judged by themselves, so repeated
rows agree; extra columns pass through, except ones named lang_pred or score, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snippetry.llm.common import raw
from snippetry.operators.bounded import join_checked
from snippetry.operators.tfidf import top_grams
from snippetry.session import drop_path, stage, stage_scope

UNDETERMINED = "und"
LONGEST = 4
_LETTERS = re.compile(r"[^\W\d_]+")
_FLUSH = 300_000
# Texts that a task judges before it passes their words on.
JUDGED_ROWS = 500


def words(text: bytes | None) -> list[str]:
    return [] if text is None else _LETTERS.findall(text.decode().lower())


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between its marks; a single character is never a mark."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    """log_words[i] holds one number a language for a frequent word; the tables hold (item, scores) of all words and n-grams."""

    languages: list[str]
    words: dict[str, int]
    log_words: np.ndarray
    word_table: DataFrame
    gram_table: DataFrame
    paths: list[str]

    def drop(self) -> None:
        """Remove the tables when all texts are judged."""
        for path in self.paths:
            drop_path(self.word_table.sparkSession, path)

    def backed_off(self, word: str) -> np.ndarray:
        """Scores of a word as if it were unseen; zeros if no n-gram is known."""
        found = self.unseen(self.word_table.sparkSession.createDataFrame([(word,)], "item string")).first()
        return np.array(found["scores"])

    def unseen(self, items: DataFrame) -> DataFrame:
        """(item, scores) of distinct unseen words by their longest known n-grams."""
        marked = F.concat(F.lit("^"), F.col("item"), F.lit("$"))
        sizes = [F.struct(F.lit(n).alias("k"), _pieces(marked if n > 1 else F.col("item"), n).alias("pieces")) for n in range(1, LONGEST + 1)]
        sized = items.select("item", F.inline(F.array(*sizes))).select("item", "k", F.explode("pieces").alias("gram"))
        # Distinct n-grams of up to four letters are few beside the words; if they are, no piece of a word moves to look one up.
        known = join_checked(sized, self.gram_table.withColumnRenamed("item", "gram"), "gram")
        mean = F.array(*[F.avg(F.col("scores")[i]) for i in range(len(self.languages))])
        longest = known.groupBy("item", "k").agg(mean.alias("scores")).groupBy("item").agg(F.max_by("scores", "k").alias("scores"))
        zeros = F.array(*[F.lit(0.0)] * len(self.languages))
        return items.join(longest, "item", "left").select("item", F.coalesce("scores", zeros).alias("scores"))


def _pieces(text: Column, n: int) -> Column:
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, item, n) word counts of (text, lang) rows."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(raw(batch, "text"), batch.column("lang").to_pylist()):
            counts.setdefault(lang, Counter()).update(words(text))
            if len(counts[lang]) > _FLUSH:
                yield from _flushed(counts)
    yield from _flushed(counts)


def _grams_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, item, n) n-gram counts of (lang, item, n) word counts."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, word, n in zip(*[batch.column(c).to_pylist() for c in ("lang", "item", "n")]):
            own = counts.setdefault(lang, Counter())
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    own[g] += n
            if len(own) > _FLUSH:
                yield from _flushed(counts)
    yield from _flushed(counts)


def _flushed(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        columns = [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "item", "n"])
    counts.clear()


_COUNTS = "lang string, item string, n bigint"


def _by_item(counts: DataFrame, languages: list[str], name: str) -> DataFrame:
    """(item, total, counts): the counts of every item in the order of the languages."""
    per_language = F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in languages])
    return stage(counts.groupBy("item").agg(F.sum("n").alias("total"), per_language.cast("array<bigint>").alias("counts")), name)


def _scores(smooth: float, totals: list[Column], items: Column) -> Column:
    """Log frequency in each language; ``totals`` are what was counted in each, ``items`` how many different ones there are."""
    every = sum(totals[1:], totals[0]).cast("double")
    cells = [F.coalesce(F.try_divide(F.col("counts")[i], total), F.lit(0.0)) + F.lit(smooth) / every for i, total in enumerate(totals)]
    return F.array(*[F.log(c / (1 + smooth * items / every)) for c in cells]).cast("array<double>").alias("scores")


def train(labelled: DataFrame, lexicon: int = 100_000, smooth: float = 0.1, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from every row with a text and a language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    order = F.length("item")
    with stage_scope(labelled.sparkSession) as scope:
        counted = stage(rows.mapInArrow(_counted, _COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n")), "language-words")
        totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        languages = sorted(totals)
        all_words = scope.keep(_by_item(counted, languages, "language-lexicon"))
        parts = stage(counted.mapInArrow(_grams_counted, _COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n")), "language-grams")
        sized = {(r["lang"], r["k"]): r["n"] for r in parts.groupBy("lang", order.alias("k")).agg(F.sum("n").alias("n")).collect()}
        all_grams = scope.keep(_by_item(parts, languages, "language-gram-lexicon"))
    if not languages:
        return LanguageModel([], {}, np.zeros((0, 0)), all_words, all_grams, [all_words.staged_path, all_grams.staged_path])
    n_grams = {r["k"]: r["count"] for r in all_grams.groupBy(order.alias("k")).count().collect()}
    word_table = all_words.select("item", "total", _scores(smooth, [F.lit(totals[x]) for x in languages], F.lit(all_words.count())))
    # Each order of n-grams is a distribution of its own.
    by_order = range(1, LONGEST + 1)
    of_order = [F.array(*[F.lit(sized.get((x, k), 0)) for k in by_order])[order - 1] for x in languages]
    gram_table = all_grams.select("item", _scores(smooth, of_order, F.array(*[F.lit(n_grams.get(k, 0)) for k in by_order])[order - 1]))
    # As Arrow columns, and from one merge: rows of the driver's own, or as many words from each task, would take most of its memory.
    top = top_grams(word_table.withColumnsRenamed({"item": "gram", "total": "cf"}), lexicon).select("gram", "scores").toArrow()
    log_words = top["scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(top.num_rows, len(languages))
    paths = [all_words.staged_path, all_grams.staged_path]
    return LanguageModel(languages, {w: i for i, w in enumerate(top["gram"].to_pylist())}, log_words, word_table.drop("total"), gram_table, paths)


_PARTIAL = "digest binary, letters boolean, n bigint, sums array<double>, rest array<struct<item: string, times: bigint>>"
_PAIR = pa.struct([("item", pa.string()), ("times", pa.int64())])
_PARTIAL_ARROW = pa.schema([("digest", pa.binary()), ("letters", pa.bool_()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("rest", pa.list_(_PAIR))])


def _summed(batches: Iterator[pa.RecordBatch], known: dict[str, int], log_words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Scores of the known words of each text, and its other words with their numbers. A batch has rows by number, whatever their
    texts hold, so it is passed on in pieces."""
    for batch in batches:
        for piece in (batch.slice(i, JUDGED_ROWS) for i in range(0, batch.num_rows, JUDGED_ROWS)):
            letters, sizes, sums, ends, items, times = [], [], [], [0], [], []
            for value in raw(piece, "text"):
                found = words(value)
                at = [known.get(w, -1) for w in found]
                letters.append(any(w.isalpha() for w in found) or any(c.isalpha() for w in found for c in w))
                sizes.append(len(found))
                sums.append(log_words[[i for i in at if i >= 0]].sum(axis=0).tolist())
                others = Counter(w for w, i in zip(found, at) if i < 0)
                items += others.keys()
                times += others.values()
                ends.append(len(items))
            pairs = pa.StructArray.from_arrays([pa.array(items, pa.string()), pa.array(times, pa.int64())], fields=list(_PAIR))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            columns = [piece.column("digest"), *(pa.array(c, f.type) for c, f in zip((letters, sizes, sums), list(_PARTIAL_ARROW)[1:4])), rest]
            yield pa.RecordBatch.from_arrays(columns, schema=_PARTIAL_ARROW)


def _judged_texts(texts: DataFrame, model: LanguageModel, certain_words: int) -> DataFrame:
    """(digest, lang_pred, score) of the distinct texts among (digest, text) rows, without language if there is no letter. Only
    words that tasks do not hold, and sums, move between tasks."""
    shared = texts.sparkSession.sparkContext.broadcast((model.words, model.log_words))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(batches, *shared.value)

    with stage_scope(texts.sparkSession) as scope:
        partial = stage(texts.mapInArrow(summed, _PARTIAL).withColumn("row", F.monotonically_increasing_id()), "language-sums")
        pairs = partial.select("row", F.inline("rest"))
        asked = stage(pairs.select("item").distinct().join(model.word_table, "item", "left"), "language-asked")
        unseen = model.unseen(asked.where("scores IS NULL").select("item"))
        scores = stage(asked.where("scores IS NOT NULL").unionByName(unseen), "language-scores")
        scope.drop(asked)
        n = len(model.languages)
        added = pairs.join(scores, "item").groupBy("row").agg(F.array(*[F.sum(F.col("times") * F.col("scores")[i]) for i in range(n)]).alias("added"))
        mean = F.array(*[(F.col("sums")[i] + F.coalesce(F.col("added")[i], F.lit(0.0))) / F.col("n") for i in range(n)])
        sure = F.when(F.col("letters"), F.transform(mean, lambda x: x * F.least(F.col("n"), F.lit(certain_words))))
        judged = partial.select("row", "digest", "letters", "n", "sums").join(added, "row", "left").select("digest", sure.alias("v"))
        total = F.aggregate(F.transform("v", lambda x: F.exp(x - F.array_max("v"))), F.lit(0.0), lambda a, x: a + x)
        names = F.array(*[F.lit(x) for x in model.languages])
        best = F.when(F.col("v").isNotNull(), F.element_at(names, F.array_position("v", F.array_max("v")).cast("int")))
        one = judged.groupBy("digest").agg(F.min(F.struct(best.alias("lang_pred"), (1 / total).alias("score"))).alias("r"))
        return scope.keep(stage(one.select("digest", "r.*"), "language-judged"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))


def _judged(docs: DataFrame, model: LanguageModel, text: str, certain_words: int) -> DataFrame:
    texts = docs.select(_digest(text).alias("digest"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    return _judged_texts(texts, model, certain_words).withColumnsRenamed({"digest": "_key", "lang_pred": "_lang", "score": "_score"})


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", certain_words: int = 10) -> DataFrame:
    """``docs`` with lang_pred and score: the softmax over languages of the mean word score times the number of words, at most
    ``certain_words`` (all words count for the mean; longer texts are not held to be surer than that)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    if not model.languages:
        return docs.select(*kept, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    judged = _judged(docs, model, text, certain_words)
    name, score = F.coalesce("_lang", F.lit(UNDETERMINED)), F.coalesce("_score", F.lit(0.0))
    # The digest is a column of its own, so the text takes no part in the join unless the caller reads it.
    joined = join_checked(docs.select(*kept, _digest(text).alias("_digest")), judged, F.expr("_digest = _key"), "left")
    return joined.select(*kept, name.alias("lang_pred"), score.alias("score"))


def confident(docs: DataFrame, model: LanguageModel, min_score: float, text: str = "text", certain_words: int = 10,
              max_rejected: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that predict() gives a language with at least ``min_score``. Rejected texts are few, so up to
    ``max_rejected`` digests of 16 bytes go to the rows; only beyond that do rows go to the digests."""
    if not model.languages:
        return docs.where("false")
    rejected = _judged(docs, model, text, certain_words).where(F.col("_lang").isNull() | (F.col("_score") < min_score)).select("_key")
    given = docs.where(F.col(f"`{text}`").isNotNull()).withColumn("_digest", _digest(text))
    return join_checked(given, rejected, F.expr("_digest = _key"), "left_anti", max_rejected).drop("_digest")


def held_out(doc_id: Column, fold: int = 5, rest: int = 0) -> Column:
    """True for rows that nothing may be learned from; unknown ids are among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(fold)) == rest, F.lit(True))
