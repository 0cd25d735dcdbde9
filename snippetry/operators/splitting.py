"""Exact stratified splits and folds under a seed, without moving the rows.

Rows are ordered inside each stratum by md5(id:seed). A part is a range of ranks, so it is enough to
know the (hash, id) key at the last rank of each part. Those keys are found from counts per hash
bucket plus a ranking of the few buckets that contain a boundary; then every row is placed by
comparing its own key, with no shuffle of the wide rows. Ids are counted first: NULL ids, and ids that
a stratum holds more than once, are refused, as no key could place them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snippetry.operators.bounded import join_checked
from snippetry.session import stage

BUCKET_HEX = 4


def hash_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def part_boundaries(df: DataFrame, id_col: str, stratum: str, uppers: list[Column], seed: int = 42) -> DataFrame:
    """(stratum, cut, h, id): the key of the row at each upper rank; ``uppers`` are expressions over
    the stratum size ``n``. Ranks of 0 give no row."""
    keyed = df.select(
        F.col(stratum).alias("_s"), F.col(id_col).alias("_id"), hash_key(id_col, seed).alias("_h")
    ).withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
    ids = keyed.groupBy("_s", "_b", "_id").agg(F.count("*").alias("_n"))
    counts = ids.groupBy("_s", "_b").agg(
        F.sum("_n").alias("_c"), F.coalesce(F.max("_n"), F.lit(0)).alias("_most"), F.count_if(F.col("_id").isNull()).alias("_nulls")
    )
    counts = stage(counts, "bucket-counts")
    if counts.where("_most > 1 OR _nulls > 0").head(1):
        raise ValueError(f"{id_col} must be given and unique; with_content_id makes such a key")
    counts = counts.drop("_most", "_nulls")
    running = counts.withColumn(
        "_upto", F.sum("_c").over(Window.partitionBy("_s").orderBy("_b"))
    )
    totals = counts.groupBy("_s").agg(F.sum("_c").alias("n"))
    wanted = totals.select("_s", F.posexplode(F.array(*[u.cast("bigint") for u in uppers])).alias("cut", "_q"))
    hit = (
        running.join(wanted.withColumnRenamed("_s", "_ws"), F.expr("_s <=> _ws"))
        .where("_q > _upto - _c AND _q <= _upto")
        .select("_ws", F.col("_b").alias("_wb"), "cut", (F.col("_q") - F.col("_upto") + F.col("_c")).alias("_rank"))
    )
    hit = stage(hit, "boundary-buckets")
    hot = hit.select("_ws", "_wb").distinct()
    inside = join_checked(keyed, hot, F.expr("_s <=> _ws AND _b = _wb"), "left_semi")
    ranked = inside.withColumn("_rn", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_id")))
    return join_checked(ranked, hit, F.expr("_s <=> _ws AND _b = _wb AND _rn = _rank")).select(
        F.col("_ws").alias("stratum"), "cut", F.col("_h").alias("h"), F.col("_id").alias("id")
    )


def assign_parts(df: DataFrame, id_col: str, stratum: str, uppers: list[Column], names: list, out: str,
                 seed: int = 42) -> DataFrame:
    """Append ``out``: names[i] for ranks up to uppers[i], names[-1] beyond the last one."""
    cuts = stage(part_boundaries(df, id_col, stratum, uppers, seed), "part-boundaries")
    wide = cuts.groupBy(F.col("stratum").alias("_s")).agg(
        *[F.max(F.when(F.col("cut") == i, F.struct("h", "id"))).alias(f"_cut{i}") for i in range(len(uppers))]
    )
    key = F.struct(hash_key(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    part = F.lit(names[-1])
    for i in reversed(range(len(uppers))):
        part = F.when(key <= F.col(f"_cut{i}"), F.lit(names[i])).otherwise(part)
    joined = join_checked(df, wide, F.expr(f"`{stratum}` <=> _s"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], part.alias(out))


def split_corpus(df: DataFrame, id_col: str = "snippet_id", label: str = "label", seed: int = 42,
                 holdout: str = "0.2", test_share: str = "0.5", out: str = "split") -> DataFrame:
    """train / validation / test: ceil(holdout * n) rows of each label held out, ceil(test_share) of
    those for test. Shares are decimal strings, so quotas are exact."""
    held = f"ceil(n * CAST('{holdout}' AS DECIMAL(9,8)))"
    test = f"ceil({held} * CAST('{test_share}' AS DECIMAL(9,8)))"
    return assign_parts(df, id_col, label, [F.expr(test), F.expr(held)], ["test", "validation", "train"], out, seed)


def assign_folds(df: DataFrame, id_col: str = "snippet_id", label: str = "label", folds: int = 5, seed: int = 42,
                 out: str = "fold") -> DataFrame:
    """Stratified folds 0..folds-1, sizes within one row of each other per label."""
    uppers = [F.expr(f"(n * {i}) div {folds}") for i in range(1, folds)]
    return assign_parts(df, id_col, label, uppers, list(range(folds)), out, seed)
