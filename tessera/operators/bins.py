"""Data-driven supports, bin counts, edges and their health (N1-N7, N19). Quantiles are those of ``ranks``: exact, and no channel meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BinsPolicy
from . import ranks

PCT = "channel"


def robust_support(signal: DataFrame, p: BinsPolicy = BinsPolicy()) -> DataFrame:
    """N1."""
    return ranks.quantiles(ranks.counted(signal, [PCT]), [], (PCT,), trim=p.support_q).select(PCT, "lo", "hi", "n")


def mad_sigma(signal: DataFrame) -> DataFrame:
    """1.4826 times the median absolute deviation."""
    with ranks.kept(ranks.counted(signal, [PCT])) as counts:
        return ranks.mad_sigma(counts, ranks.quantiles(counts, [0.5]).select(PCT, F.col("q")[0].alias("med")), [PCT])


def fd_count(n: Column, low: Column, high: Column, q25: Column, q75: Column, p: BinsPolicy) -> Column:
    """Freedman-Diaconis bin count over low to high, the rounded root of n where there are few values or no spread, clamped."""
    h = 2 * (q75 - q25) * F.pow(n.cast("double"), F.lit(-1 / 3))
    root = F.greatest(F.lit(2), F.bround(F.sqrt(n)))
    count = F.when((n < 16) | (q75 <= q25) | (high <= low), root).otherwise(F.ceil(F.try_divide(high - low, h)))
    return F.least(F.lit(p.max_bins), F.greatest(F.lit(p.min_bins), count)).cast("int")


def fd_bins(signal: DataFrame, p: BinsPolicy = BinsPolicy()) -> DataFrame:
    """N3 over the robust support."""
    own = ranks.quantiles(ranks.counted(signal, [PCT]), [0.25, 0.75], (PCT,), trim=p.support_q)
    return own.select(PCT, fd_count(F.col("n"), F.col("lo"), F.col("hi"), F.col("q")[0], F.col("q")[1], p).alias("n_bins"))


def increasing(edges: Column, eps: float) -> Column:
    """Ties moved up by eps from left to right."""
    step = lambda acc, e: F.array_append(acc, F.when(e <= F.element_at(acc, -1), F.element_at(acc, -1) + eps).otherwise(e))
    return F.aggregate(F.slice(edges, F.lit(2), F.size(edges)), F.slice(edges, 1, 1), step)


def quantile_edges(signal: DataFrame, n_bins: int, p: BinsPolicy = BinsPolicy(), digits: int | None = None) -> DataFrame:
    """Equiprobable edges between the ends of the robust support, ties broken."""
    own = ranks.quantiles(ranks.counted(signal, [PCT]), [i / n_bins for i in range(n_bins + 1)], (PCT,), trim=p.support_q)
    edges = F.col("q") if digits is None else F.transform("q", lambda x: F.round(x, digits))
    return own.select(PCT, increasing(edges, p.epsilon).alias("edges"))


def merge_narrow(edges: Column, width: Column) -> Column:
    """Greedy merge of inner edges closer than width to the last kept one; ends stay."""
    inner = F.slice(edges, F.lit(2), F.size(edges) - 2)
    kept = F.aggregate(inner, F.slice(edges, 1, 1), lambda acc, e: F.when(e - F.element_at(acc, -1) >= width, F.array_append(acc, e)).otherwise(acc))
    return F.array_append(kept, F.element_at(edges, -1))


def increments(signal: DataFrame, keys=("mid", "channel"), order="idx") -> DataFrame:
    """First differences; the first sample of a series has none."""
    w = Window.partitionBy(*keys).orderBy(order)
    return signal.withColumn("value", F.col("value") - F.lag("value").over(w)).where("value is not null")


def steps(wide: DataFrame, channels: Sequence[str], keys=("mid",), order="idx") -> DataFrame:
    """W1 of a frame with a column a channel: keys, channel and value. One window over the samples serves all channels; a first sample's value is null."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = wide.select(*keys, *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in channels])
    return own.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias(PCT), F.col(c).alias("value")) for c in channels])))


def increment_support(signal: DataFrame | None, p: BinsPolicy = BinsPolicy(), steps: DataFrame | None = None) -> DataFrame:
    """Quantile of absolute increments; where that is 0, six robust deviations, or else the largest one. steps: the increments, where they are at hand."""
    with ranks.kept(ranks.counted(increments(signal) if steps is None else steps, [PCT])) as counts:
        tail = ranks.quantiles(ranks.absolute(counts, [PCT]), [p.increment_q, 1.0]).select(PCT, "n", F.col("q")[0].alias("tail"), F.col("q")[1].alias("most"))
        sigma = ranks.mad_sigma(counts, ranks.quantiles(counts, [0.5]).select(PCT, F.col("q")[0].alias("med")), [PCT])
    return tail.join(sigma, PCT).select(PCT, tail_support(F.col("tail"), F.col("sigma"), F.col("most")).alias("support"), "n")


def tail_support(tail: Column, sigma: Column, most: Column) -> Column:
    """N6's fallbacks."""
    return F.when(tail > 0, tail).when(sigma > 0, 6 * sigma).otherwise(most)


def coupling_q(signal: DataFrame, p: BinsPolicy = BinsPolicy()) -> DataFrame:
    """Categories for coupling from the smallest channel's count."""
    low, high, per = p.coupling
    n = signal.groupBy(PCT).agg(F.count("value").alias("n")).agg(F.min("n").alias("n"))
    return n.select(F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.sqrt(F.col("n") / per)))).cast("int").alias("q"))


def health(signal: DataFrame, edges: DataFrame, clip=(0.005, 0.02), nan=(0.001, 0.01), micro: float = 1e-6) -> DataFrame:
    """N19 with A19 and H9: clip and missing rates, widths, and OK, WARN or FAIL."""
    rows = signal.join(edges, PCT, "left")
    first, last = F.element_at("edges", 1), F.element_at("edges", -1)
    x = F.col("value")
    own = rows.groupBy(PCT).agg(F.count("*").alias("n"), F.count_if(x.isNull() | F.isnan(x)).alias("n_nan"), F.count_if((x < first) | (x > last)).alias("n_clip"), F.max("edges").alias("edges"))
    own = own.withColumns({"clip_rate": F.col("n_clip") / F.greatest(F.col("n"), F.lit(1)), "nan_rate": F.col("n_nan") / F.greatest(F.col("n"), F.lit(1)), "n_bins": F.size("edges") - 1, "span": last - first})
    widths = F.zip_with(F.slice("edges", F.lit(2), F.size("edges") - 1), F.slice("edges", F.lit(1), F.size("edges") - 1), lambda b, a: b - a)
    own = own.withColumn("micro_fraction", F.size(F.filter(widths, lambda w: w / F.col("span") <= micro)) / F.col("n_bins"))
    status = F.when((F.col("clip_rate") >= clip[1]) | (F.col("nan_rate") >= nan[1]), "FAIL").when((F.col("clip_rate") >= clip[0]) | (F.col("nan_rate") >= nan[0]), "WARN").otherwise("OK")
    return own.withColumn("status", status).drop("edges")
