"""Quality rules as a short-circuit cascade of SQL expressions.

A rule is a Boolean column that is true where a document fails. On a sample each rule is timed and its failing share is
counted; the rules are then tried in the order of rejections per second, and the chain of WHENs leaves a document at the
first rule that it fails. The order is a matter of speed alone: a document is kept if it fails no rule.

Defined cases: a null text has no words and no lines, so all counts are 0; the same for an empty text. Ratios of a
document without words are null and a rule that is null does not fail. Every row is judged by itself, so repeated rows and
clashing extra columns (they pass through untouched; computed columns replace ones of the same name) change nothing.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from snippetry.llm.common import WORD
from snippetry.session import stage

# Fixed value: the characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"


# Columns that with_base_counts() adds.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where a document fails; it sees the document's columns and the base counts."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _repeated_words(words: str, order: str, bits: str) -> Column:
    """Words covered by three-word windows that occur at least twice. ``order`` holds, sorted, each window's hash with its
    place in the low ``bits``; windows of one hash are neighbours there, so a window is repeated if it equals the one
    before or after. Hashes only bring windows together; the words decide."""
    place = f"CAST({order}[i] & (shiftleft(1L, {bits}) - 1) AS INT)"
    near = f"CAST({order}[i + 1] & (shiftleft(1L, {bits}) - 1) AS INT)"
    equal = (
        f"shiftrightunsigned({order}[i], {bits}) = shiftrightunsigned({order}[i + 1], {bits})"
        f" AND {words}[{place}] = {words}[{near}] AND {words}[{place} + 1] = {words}[{near} + 1]"
        f" AND {words}[{place} + 2] = {words}[{near} + 2]"
    )
    return F.expr(
        f"flatten(transform(filter(sequence(0, size({order}) - 2), i -> {equal}), i -> array({place}, {near})))"
    )


def with_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint)."""
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(WORD))
    counted = docs.withColumn("_words", words(text)).withColumn("_lines", lines)
    # Places take the low bits of a long, the window's hash the rest.
    bits = "CAST(ceil(log2(size(_words) + 1)) AS INT)"
    hashes = (
        "transform(sequence(0, size(_words) - 3), i -> "
        f"shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), {bits}) | CAST(i AS BIGINT))"
    )
    counted = counted.withColumn(
        "_order", F.when(F.size("_words") >= 4, F.sort_array(F.expr(hashes))).otherwise(F.array().cast("array<bigint>"))
    ).withColumn("_bits", F.expr(bits))
    repeated = F.when(F.size("_order") >= 2, _repeated_words("_words", "_order", "_bits")).otherwise(F.array().cast("array<int>"))
    counted = counted.withColumn("_places", F.sort_array(F.array_distinct(repeated)))
    covered = F.expr(
        "aggregate(_places, named_struct('n', 0L, 'end', 0), (a, p) -> named_struct("
        "'n', a.n + (p + 3 - greatest(p, a.end)), 'end', p + 3), a -> a.n)"
    )
    return counted.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in BASE],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOLS)), F.lit(0)).cast("bigint").alias("n_symbols"),
        F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Heuristics against markup and table debris, shouting, repeated lines, odd word lengths and exclamation noise.
    Ratios are compared as products of whole numbers."""

    def count(pattern: str) -> Column:
        return F.regexp_count(F.col(text), F.lit(pattern))

    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("line copies", 2 * F.col("n_dup_lines") > F.size(F.split(F.col(text), "\n", -1))),
        Rule("shouting", 2 * count(r"\p{Lu}") > count(r"\p{L}")),
        Rule("exclamation", 5 * count("!") > F.col("n_words")),
    ]


def measure(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 2000) -> list[Measured]:
    """Time and failing share of each rule on a sample of about ``sample_rows`` documents, drawn by a hash of the row and
    written once. The time of an empty pass is taken off."""
    sample = stage(with_base_counts(_sampled(docs, sample_rows), text), "quality-sample")

    def run(condition: Column) -> tuple[float, float]:
        began = time.perf_counter()
        failed = sample.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double"))).first()[0]
        return time.perf_counter() - began, failed or 0.0

    run(F.lit(False))
    empty = min(run(F.lit(False))[0] for _ in range(2))
    out = []
    for rule in rules:
        seconds, rejected = run(rule.fails)
        out.append(Measured(rule, max(seconds - empty, 0.0), rejected))
    return out


def ordered(measured: list[Measured]) -> list[Rule]:
    """Most rejections per second first; ties by name."""
    return [m.rule for m in sorted(measured, key=lambda m: (-m.worth, m.rule.name))]


def first_failed(rules: list[Rule]) -> Column:
    """Name of the first rule that a document fails, null if none. Later rules are not computed for it."""
    chain = F.when(F.coalesce(rules[0].fails, F.lit(False)), F.lit(rules[0].name)) if rules else F.lit(None).cast("string")
    for rule in rules[1:]:
        chain = chain.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name))
    return chain


def judge(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the base counts, base_failed, failed_rule (null if none; which one depends on the measured order) and
    kept. Documents that fail the base rules skip the cascade."""
    rules = default_rules(text) if rules is None else rules
    counted = with_base_counts(docs, text)
    chain = first_failed(ordered(measure(docs, rules, text, sample_rows)))
    judged = counted.withColumn("base_failed", base_failed())
    judged = judged.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(chain))
    return judged.withColumn("kept", F.col("failed_rule").isNull())


def _sampled(docs: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` rows by a hash of the row, before anything is computed on them."""
    share = sample_rows / max(docs.count(), 1)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.where(F.pmod(row, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
