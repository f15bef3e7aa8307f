"""Profiles, correlations and pairwise comparisons (I8-I11, A9-A11, A20-A22, W10). Vectors stay long: a row a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ProfilePolicy
from ..functions import scalars as S

BLOCK = ("fecha", "lab")


def guarded_corr(x: str, y: str) -> Column:
    """Pearson over pairs; null under two pairs or without variance."""
    x, y = (F.when(F.col(b).isNotNull(), F.col(a)) for a, b in ((x, y), (y, x)))
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 2) & ~flat, F.try_divide(F.covar_pop(x, y), sd))


def distance(x: str, y: str) -> Column:
    return F.sqrt(F.sum((F.col(x) - F.col(y)) * (F.col(x) - F.col(y))))


def canonical_base(metrics: DataFrame, expected: int) -> DataFrame:
    """One row a (fecha, lab, mid, laser) with metric v, measurements with all expected lasers only."""
    one = F.row_number().over(Window.partitionBy(*BLOCK, "mid", "laser").orderBy("v"))
    rows = metrics.where("v is not null").withColumn("r", one).where("r = 1").drop("r")
    n = F.size(F.collect_set("laser").over(Window.partitionBy(*BLOCK, "mid")))
    return rows.withColumn("n_lasers", n).where(F.col("n_lasers") == expected).drop("n_lasers")


def block_means(base: DataFrame, mode: str = "mean") -> DataFrame:
    """A9."""
    agg = F.avg("v") if mode == "mean" else F.percentile("v", F.lit(0.5))
    return base.groupBy(*BLOCK, "laser").agg(agg.alias("block_v"), F.count("*").alias("n"))


def profile_stats() -> list[Column]:
    return [F.avg("v").alias("profile_mean"), F.stddev_samp("v").alias("profile_std"), F.min("v").alias("profile_min"), F.max("v").alias("profile_max"), S.ratio_max_min(F.max("v"), F.min("v")).alias("anisotropy")]


def measurement_profiles(base: DataFrame) -> DataFrame:
    """A10: profile of each measurement against its block's mean profile."""
    rows = base.withColumn("block_v", F.avg("v").over(Window.partitionBy(*BLOCK, "laser")))
    return rows.groupBy(*BLOCK, "mid").agg(*profile_stats(), guarded_corr("v", "block_v").alias("coherence"), distance("v", "block_v").alias("distance"))


def block_summary(base: DataFrame, least: int = 3) -> DataFrame:
    """Counts, profile stats of the block's mean profile, mean over lasers of the deviation across measurements."""
    by = base.groupBy(*BLOCK, "laser").agg(F.avg("v").alias("v"), F.stddev_samp("v").alias("spread"), F.count("*").alias("n"))
    ids = base.groupBy(*BLOCK).agg(F.countDistinct("mid").alias("n_measurements"))
    own = by.groupBy(*BLOCK).agg(*profile_stats(), F.sum("n").alias("n_rows"), F.count("*").alias("n_lasers"), F.avg("spread").alias("between_std"))
    return own.join(ids, list(BLOCK)).withColumn("valid", F.col("n_measurements") >= least)


def intra_block_corr(base: DataFrame, method: str = "pearson") -> DataFrame:
    """I8: correlation of each laser pair i < j across a block's measurements; Spearman by average ranks."""
    rows = base
    if method == "spearman":
        own = Window.partitionBy(*BLOCK, "laser")
        rows = rows.withColumn("v", F.rank().over(own.orderBy("v")) + (F.count("*").over(Window.partitionBy(*BLOCK, "laser", "v")) - 1) / 2.0)
    a = rows.select(*BLOCK, "mid", F.col("laser").alias("laser_i"), F.col("v").alias("x"))
    b = rows.select(*BLOCK, "mid", F.col("laser").alias("laser_j"), F.col("v").alias("y"))
    pairs = a.join(b, [*BLOCK, "mid"]).where("laser_i < laser_j")
    return pairs.groupBy(*BLOCK, "laser_i", "laser_j").agg(guarded_corr("x", "y").alias("r"), F.count("*").alias("n_pairs"))


def corr_matrix(pairs: DataFrame) -> DataFrame:
    """Both triangles and the diagonal, long."""
    keep = [*BLOCK, "laser_i", "laser_j", "r"]
    turned = pairs.select(*BLOCK, F.col("laser_j").alias("laser_i"), F.col("laser_i").alias("laser_j"), "r")
    own = pairs.select(*BLOCK, "laser_i").union(pairs.select(*BLOCK, "laser_j")).distinct()
    return pairs.select(keep).unionByName(turned).unionByName(own.select(*BLOCK, "laser_i", F.col("laser_i").alias("laser_j"), F.lit(1.0).alias("r")))


def pairwise(base: DataFrame, vary: str = "fecha", least: int = 3) -> DataFrame:
    """I9 over J10 (vary fecha within lab) or J11 (vary lab within fecha): mean profiles of block pairs a < b."""
    fixed = "lab" if vary == "fecha" else "fecha"
    means = base.groupBy(*BLOCK, "laser").agg(F.avg("v").alias("v"))
    fine = base.groupBy(*BLOCK).agg(F.countDistinct("mid").alias("k")).where(F.col("k") >= least).drop("k")
    means = means.join(fine, list(BLOCK), "left_semi")
    a = means.select(fixed, "laser", F.col(vary).alias("a"), F.col("v").alias("x"))
    b = means.select(fixed, "laser", F.col(vary).alias("b"), F.col("v").alias("y"))
    both = a.join(b, [fixed, "laser"]).where("a < b")
    aniso = lambda c: S.ratio_max_min(F.max(c), F.min(c))
    return both.groupBy(fixed, "a", "b").agg(guarded_corr("x", "y").alias("corr"), distance("x", "y").alias("distance"), (aniso("y") - aniso("x")).alias("anisotropy_delta"))


def channel_global(base: DataFrame) -> DataFrame:
    """Mean and deviation over blocks of each laser's block mean."""
    return block_means(base).groupBy("laser").agg(F.avg("block_v").alias("mean"), F.stddev_samp("block_v").alias("std"), F.count("*").alias("n_blocks"))


def global_summary(pairs: DataFrame) -> DataFrame:
    """Mean pair correlation of each block."""
    return pairs.groupBy(*BLOCK).agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_pairs"))


def _wide(long: DataFrame, keys: list[str], metrics: list[str], values: list[str]) -> DataFrame:
    """A row for each of keys with <metric>__<value> of every metric."""
    cells = [F.max(F.when(F.col("metric") == m, F.col(v))).alias(f"{m}__{v}") for m in metrics for v in values]
    return long.groupBy(*keys).agg(*cells, *[F.avg(v).alias(f"mean_{v}") for v in values])


def metric_profiles(base: DataFrame) -> DataFrame:
    """Profile of each block and metric: mean by laser. base: fecha, lab, mid, laser, metric, v."""
    return base.groupBy("metric", *BLOCK, "laser").agg(F.avg("v").alias("v"))


def metrics_summary(base: DataFrame, metrics: list[str]) -> DataFrame:
    """A20 over several metrics: for each block and metric mean, deviation and anisotropy of its mean profile and its mean pair correlation, a row a
    block, with their means over the metrics that have them. Metrics that are not named play no part."""
    rows = base.where(F.col("metric").isin(metrics))
    own = metric_profiles(rows).groupBy("metric", *BLOCK).agg(*profile_stats())
    a = rows.select("metric", *BLOCK, "mid", F.col("laser").alias("i"), F.col("v").alias("x"))
    b = rows.select("metric", *BLOCK, "mid", F.col("laser").alias("j"), F.col("v").alias("y"))
    pairs = a.join(b, ["metric", *BLOCK, "mid"]).where("i < j").groupBy("metric", *BLOCK, "i", "j").agg(guarded_corr("x", "y").alias("r"))
    own = own.join(pairs.groupBy("metric", *BLOCK).agg(F.avg("r").alias("pair_corr")), ["metric", *BLOCK], "left")
    ids = rows.groupBy(*BLOCK).agg(F.countDistinct("mid").alias("n_measurements"))
    return _wide(own, list(BLOCK), metrics, ["profile_mean", "profile_std", "anisotropy", "pair_corr"]).join(ids, list(BLOCK))


def pairwise_metrics(base: DataFrame, metrics: list[str], vary: str = "fecha", least: int = 3) -> DataFrame:
    """I9 over several metrics: block pairs a < b that share the other key and both have ``least`` measurements, with the counts of both, for each
    metric correlation, distance and both anisotropies with their difference, and the means over metrics."""
    fixed = "lab" if vary == "fecha" else "fecha"
    rows = base.where(F.col("metric").isin(metrics))
    fine = rows.groupBy(*BLOCK).agg(F.countDistinct("mid").alias("k")).where(F.col("k") >= least)
    means = metric_profiles(rows).join(fine, list(BLOCK))
    side = lambda c, x: means.select("metric", fixed, "laser", F.col(vary).alias(c), F.col("v").alias(x), F.col("k").alias(f"n_{c}"))
    both = side("a", "x").join(side("b", "y"), ["metric", fixed, "laser"]).where("a < b")
    aniso = lambda c: S.ratio_max_min(F.max(c), F.min(c))
    keys = [fixed, "a", "b", "n_a", "n_b"]
    own = both.groupBy("metric", *keys).agg(guarded_corr("x", "y").alias("corr"), distance("x", "y").alias("distance"), aniso("x").alias("anisotropy_a"), aniso("y").alias("anisotropy_b"))
    own = own.withColumn("anisotropy_delta", F.col("anisotropy_b") - F.col("anisotropy_a"))
    return _wide(own, keys, metrics, ["corr", "distance", "anisotropy_a", "anisotropy_b", "anisotropy_delta"])


def profile_run(metrics: DataFrame, p: ProfilePolicy = ProfilePolicy()) -> dict[str, DataFrame]:
    """The tables of a profile run under a policy, all lazy: base, means, profiles, summary, corr, matrix, dates, labs and overall.

    metrics: fecha, lab, mid, laser, v. Each table is a plan of its own over the base; persist or write the base where several are read.
    """
    p = p.validate()
    base = canonical_base(metrics, p.expected_lasers)
    corr = intra_block_corr(base, p.corr_method)
    return {
        "base": base, "means": block_means(base, p.aggregate_mode), "profiles": measurement_profiles(base), "summary": block_summary(base, p.min_measurements),
        "corr": corr, "matrix": corr_matrix(corr), "dates": pairwise(base, "fecha", p.min_measurements), "labs": pairwise(base, "lab", p.min_measurements), "overall": global_summary(corr),
    }
