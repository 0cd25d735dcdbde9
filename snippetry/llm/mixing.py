"""Mixing sources to target weights by Pareto order sampling.

A source's share of the budget is poured out by weight, up to a multiple of its size. Every document of a source is taken
floor(target / size) times for certain. The remaining words come from a sample with unequal inclusion probabilities: a
document with probability p and a hashed uniform number u is ranked by the odds of u divided by the odds of p, and the
documents of lowest rank are taken until their words meet the remaining target to within half a document.

The cut is found with bounded groups: ranks are counted in 4096 buckets a source, then in 4096 parts of the bucket that
holds the cut, and only the documents of that part are put in order. A source with a third of all rows is combined before
it is shuffled.

Defined cases: a null text has size 0, as has an empty one; such documents are never taken in part. A null source is a
source of its own, after all others. u depends on the seed, the id and the text alone, so reruns agree; rows repeated with
the same id and text share one rank and are taken or left together. Extra columns pass through; the operator's own column
names (``PLANNED``) replace clashing ones. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from snippetry.llm.common import WORD
from snippetry.session import stage

# Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
PARTS = 4096
PLANNED = ("size", "source_size", "target", "copies", "taken")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) rows. All sums are whole numbers; each target is one division.

    A source is at its cap if the level cap * size / weight is reached before the others use up the budget. Sources are
    few, so the windows over all of them are small whatever the corpus."""
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1))
    # Levels are compared as whole numbers by bringing all weights to their product.
    common = 1
    for w in set(weights):
        common *= w
    level = F.col("source_size") * (F.lit(common) / F.col("_w")).cast("bigint")
    by_level = W.orderBy("_level", F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    poured = (
        ranked.withColumn("_level", level)
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        # What is left for this and all higher levels, in hundredths: percent * all - 100 * cap * (sizes at their cap).
        .withColumn("_rest", F.col("_all") * percent - F.col("_capped") * (100 * cap))
        .withColumn("_over", F.col("_rest") * F.col("_w") >= F.col("source_size") * (100 * cap) * F.col("_left"))
        # Once one source is below its cap, all of higher level are.
        .withColumn("_over", F.min(F.col("_over").cast("int")).over(by_level.rowsBetween(W.unboundedPreceding, 0)) == 1)
    )
    first = F.min(F.when(~F.col("_over"), F.struct("_level", F.col("source").isNull(), F.col("source"), "_rest", "_left"))).over(every)
    poured = poured.withColumn("_first", first)
    share = (F.col("_w") * F.col("_first._rest")).cast("double") / (F.col("_first._left") * 100).cast("double")
    target = F.when(F.col("_over"), (F.col("source_size") * cap).cast("double")).otherwise(share)
    return poured.select("source", "source_size", target.alias("target"))


def _with_source(docs: DataFrame, small: DataFrame) -> DataFrame:
    """Join on the null-safe source. One row a source; a hot source is split by adaptive execution."""
    other = small.withColumnRenamed("source", "_source")
    return docs.join(other, docs.source.eqNullSafe(other._source), "left").drop("_source")


def _cut(ranked: DataFrame) -> DataFrame:
    """(source, cut_rank, cut_key): the last document taken of each source that samples at all."""
    need = F.col("target") - F.col("certain") * F.col("source_size")
    pool = ranked.where("rank IS NOT NULL").select("source", "size", "rank", "key", need.alias("need"))
    pool = pool.withColumn("done", F.lit(0).cast("bigint"))
    for level in (1, 2):
        scaled = F.col("rank") * float(PARTS ** (level - 1))
        pool = pool.withColumn("part", F.floor((scaled - F.floor(scaled)) * PARTS))
        sums = pool.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("done").alias("done"))
        upto = W.partitionBy("source").orderBy("part")
        sums = sums.withColumn("upto", F.col("done") + F.sum("words").over(upto))
        # The first part that reaches the need holds the cut; without one, the last part does.
        last = F.max("part").over(W.partitionBy("source"))
        sums = sums.withColumn("last", last)
        holds = sums.where("upto - words < need AND (upto >= need OR part = last)")
        holds = stage(holds.select(F.col("source").alias("_source"), F.col("part").alias("_part"), (F.col("upto") - F.col("words")).alias("_done")), "mix-cut")
        pool = pool.join(holds, pool.source.eqNullSafe(holds._source) & (F.col("part") == F.col("_part")))
        pool = pool.withColumn("done", F.col("_done")).drop("_source", "_part", "_done")
    order = W.partitionBy("source").orderBy("rank", "key")
    placed = pool.withColumn("upto", F.col("done") + F.sum("size").over(order))
    fits = F.col("upto") - F.col("size") / 2 <= F.col("need")
    # Below every fitting document of the part lie whole parts, so a source without one cuts just before the part.
    return placed.groupBy("source").agg(
        F.max(F.when(fits, F.struct("rank", "key"))).alias("cut"), F.min("rank").alias("floor")
    ).select("source", F.coalesce(F.col("cut.rank"), F.col("floor")).alias("cut_rank"), F.coalesce(F.col("cut.key"), F.lit(-(1 << 63))).alias("cut_key"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, cap: int = 2,
        weight: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every document with size, source_size, target, copies and taken (size * copies). ``weight`` (of the column size and
    the document's own columns) makes some documents of a source likelier than others; the default, the square root of the
    size, is the classic probability that grows with size. A null weight counts as 0: such a document is never drawn."""
    weight = F.sqrt("size") if weight is None else weight
    key = F.xxhash64(F.lit(seed + 1), F.col(doc_id), F.col(text))
    kept = [c for c in docs.columns if c not in PLANNED]
    sized = docs.select(*[F.col(f"`{c}`") for c in kept], words(text).alias("size")).withColumn("key", key)
    if source != "source":
        sized = sized.withColumn("source", F.col(source))
    sized = sized.withColumn("_chance", F.coalesce(weight.cast("double"), F.lit(0.0)))
    small = stage(sized.select("source", "size", "key", "_chance", F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("draw")), "mix-sizes")
    goal = stage(targets(small, weights, percent, cap), "mix-targets")
    means = stage(small.groupBy("source").agg(F.try_divide(F.sum(F.col("size") * F.col("_chance")), F.sum("size")).alias("_mean")), "mix-means")
    plan = goal.join(means.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    cut = stage(_cut(_with_rank(_with_source(small, plan))), "mix-last")
    plan = stage(_with_source(plan, cut), "mix-plan")
    drawn = sized.withColumn("draw", F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)))
    ranked = _with_rank(_with_source(drawn, plan))
    chosen = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("key") <= F.col("cut_key")))
    copies = F.col("certain") + F.coalesce(chosen.cast("bigint"), F.lit(0))
    out = ranked.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.floor(F.col("certain"))))
    return out.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _with_rank(joined: DataFrame) -> DataFrame:
    """Adds certain copies and the Pareto rank as a number in [0, 1), null for documents that can't be sampled."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    p = F.least(F.try_divide((ratio - F.floor(ratio)) * F.col("_chance"), F.col("_mean")), F.lit(1 - 1e-9))
    odds = (u / (1 - u)) / (p / (1 - p))
    joined = joined.withColumn("certain", F.floor(ratio))
    return joined.withColumn("rank", F.when((ratio > F.floor(ratio)) & (F.col("size") > 0) & (p > 0), odds / (1 + odds)))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's columns, one row for each copy taken."""
    columns = docs.columns
    mixed = mix(docs, **options)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])
