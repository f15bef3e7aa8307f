"""Channel metrics, validation, scores, gate and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QualityPolicy
from ..functions import scalars as S

KEYS = ("lab", "mid", "channel")


def channel_metrics(signal: DataFrame, policy: QualityPolicy = QualityPolicy(), keys: Sequence[str] = KEYS) -> DataFrame:
    """A2 with H6: metrics of each channel over its finite samples, in order of idx; fewer than min_samples give status only.

    One window and one aggregate on the same keys, hence one shuffle.
    """
    clean = signal.withColumn("value", S.finite(S.without_sentinel(F.col("value").cast("double")))).where("value is not null")
    step = F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) - 1
    x = F.col("value")
    own = clean.withColumn("x", step.cast("double")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.percentile(x, F.lit(0.5)).alias("median"), F.covar_pop(x, F.col("x")).alias("cov"), F.var_pop("x").alias("var"),
        F.count_if((x < policy.v_min) | (x > policy.v_max)).alias("n_out"))
    slope = F.coalesce(F.try_divide("cov", "var"), F.lit(0.0))
    trend = F.coalesce(F.try_divide("cov", F.sqrt("var") * F.col("std")), F.lit(0.0))
    own = own.withColumns({"snr_db": S.snr_db(F.col("mean"), F.col("std")), "cv_pct": S.cv_pct(F.col("mean"), F.col("std")), "slope": slope, "trend_corr": trend, "pct_out": F.col("n_out") * 100.0 / F.col("n")})
    score = S.quality_score(F.col("std"), F.col("snr_db"), F.col("slope"), policy)
    status = F.when(F.col("n") < policy.min_samples, "insufficient_samples").otherwise("ok")
    return own.withColumns({"range": F.col("high") - F.col("low"), "score": F.when(F.col("n") >= policy.min_samples, score), "status": status}).drop("cov", "var")


def validation(signal: DataFrame, policy: QualityPolicy = QualityPolicy(), keys: Sequence[str] = KEYS) -> DataFrame:
    """A3: any missing or infinite sample, too few samples or too many out of range make a channel invalid."""
    x = F.col("value")
    bad = F.count_if(S.finite(x).isNull())
    own = signal.groupBy(*keys).agg(bad.alias("n_bad"), F.count("*").alias("n"), F.count_if((x < policy.v_min) | (x > policy.v_max)).alias("n_out"))
    pct = F.col("n_out") * 100.0 / F.col("n")
    reason = F.when(F.col("n_bad") > 0, "not_finite").when(F.col("n") < policy.min_samples, "few_samples").when(pct > policy.max_pct_out, "out_of_range").when(pct > 0, "some_out_of_range").otherwise("in_range")
    return own.withColumns({"pct_out": pct, "reason": reason}).withColumn("valid", F.col("reason").isin("some_out_of_range", "in_range"))


def file_scores(metrics: DataFrame, valid: Column, policy: QualityPolicy = QualityPolicy(), keys: Sequence[str] = ("lab", "mid")) -> DataFrame:
    """A4: mean score of valid channels, 0 if there is none."""
    score = F.coalesce(F.avg(F.when(valid, F.col("score"))), F.lit(0.0))
    return metrics.groupBy(*keys).agg(F.count("*").alias("n_channels"), F.count_if(valid).alias("n_used"), score.alias("score"), F.lit(policy.min_channels).alias("n_required"))


def gate(scores: DataFrame, threshold: float) -> DataFrame:
    """P5: passes with score at the threshold or above and enough channels; missing values fail, a missing requirement is 1."""
    ok = (F.col("score") >= threshold) & (F.coalesce("n_used", F.lit(0)) >= F.coalesce("n_required", F.lit(1)))
    return scores.withColumn("passed", F.coalesce(ok & ~F.isnan("score"), F.lit(False)))


def gate_by_lab(gated: DataFrame) -> DataFrame:
    """A6."""
    n = F.count("*")
    return gated.groupBy("lab").agg(n.alias("n"), F.count_if("passed").alias("n_pass"), (n - F.count_if("passed")).alias("n_fail"))


def summaries(metrics: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """A5: all groupings at once by grouping sets; `level` tells them apart by the grouping's bit mask."""
    names = list(dict.fromkeys(k for s in sets for k in s))
    columns = [[F.col(k) for k in s] for s in sets]
    aggs = [F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.countDistinct("mid").alias("n_mids"), F.countDistinct("channel").alias("n_channels"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"), F.avg("std").alias("mean_noise")]
    return metrics.where("status = 'ok'").groupingSets(columns, *[F.col(k) for k in names]).agg(*aggs)


def worst(scores: DataFrame, n: int = 10) -> DataFrame:
    """O2."""
    return scores.orderBy("score", "lab", "mid").limit(n)


def status_breakdown(metrics: DataFrame, keys: Sequence[str] = ("status",)) -> DataFrame:
    """A8."""
    return metrics.groupBy(*keys).agg(F.count("*").alias("n"))
