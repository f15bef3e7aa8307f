"""Spectral edges, energy and modal states and the states table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import bins, states
from .states import block_starts as block_starts


class ContractError(ValueError):
    pass


def sampling_rate(fs: float | None) -> tuple[float, str]:
    """Rate and unit of frequencies; none means cycles a sample, a rate that is not positive raises."""
    if fs is not None and fs <= 0:
        raise ContractError("the sampling rate must be positive")
    return (1.0, "cycles_per_sample") if fs is None else (fs, "Hz")


def estimated_rate(rows: DataFrame, keys: Sequence[str], time: str, order: str) -> DataFrame:
    """Keys and fs, the inverse of the median step; null under three samples or without a positive median."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    own = rows.withColumn("__dt", step).groupBy(*keys).agg(F.count(time).alias("n"), F.median("__dt").alias("dt"))
    return own.select(*keys, F.when((F.col("n") >= 3) & (F.col("dt") > 0), 1 / F.col("dt")).alias("fs"))


def safe_normalized(rows: DataFrame, keys: Sequence[str], order: str, value: str, eps: float = 1e-12) -> DataFrame:
    """value over its group's sum as prob; a sum up to eps or not finite gives all to the first."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    fine = F.coalesce(S.finite(total) > eps, F.lit(False))
    return rows.withColumn("prob", F.when(fine, F.col(value) / total).otherwise(first.cast("double")))


def cumulative(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Share of the group's total up to each row, in order."""
    own = Window.partitionBy(*keys)
    upto = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cdf", F.try_divide(F.sum(value).over(upto), F.sum(value).over(own)))


def mean_spectrum(spectra: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """keys, f, e and n: the mean of a channel's spectra by frequency."""
    rows = spectra.select(*keys, F.posexplode("power").alias("f", "e"))
    return rows.groupBy(*keys, "f").agg(F.avg("e").alias("e"), F.count("e").alias("n"))


def spectral_edges(spectra: DataFrame, n_fft: int, keys: Sequence[str] = ("channel",), fs: float | None = None, bands: int | None = None) -> DataFrame:
    """Keys and K + 1 edges of frequency at equal steps of the mean spectrum's cumulative energy; under two spectra they are even.

    K is the rounded root of the number of frequencies, between 6 and 48. Edges are made strictly increasing.
    """
    rate, _ = sampling_rate(fs)
    k = bands or int(min(48, max(6, round((n_fft / 2 + 1) ** 0.5))))
    unit, top = rate / n_fft, rate / 2
    cdf = cumulative(mean_spectrum(spectra, keys), keys, "f", "e")
    at = [F.min(F.when(F.col("cdf") >= i / k, F.col("f"))) * unit for i in range(1, k)]
    own = cdf.groupBy(*keys).agg(F.array(F.lit(0.0), *at, F.lit(top)).alias("edges"), F.max("n").alias("n"))
    even = F.array(*[F.lit(top * i / k) for i in range(k + 1)])
    some = (F.col("n") >= 2) & F.forall("edges", lambda e: e.isNotNull())
    return own.select(*keys, bins.increasing(F.when(some, F.col("edges")).otherwise(even), 1e-12).alias("edges"))


def edge_problem(edges: Column) -> Column:
    """What is wrong with edges: too_few, not_finite or not_increasing; null if nothing is."""
    fine = F.forall(edges, lambda e: S.finite(e).isNotNull())
    rising = F.forall(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.get(edges, i) > F.get(edges, i - 1))
    return F.when(edges.isNull() | (F.size(edges) < 2), "too_few").when(~fine, "not_finite").when(~rising, "not_increasing")


def band_energy(spectra: DataFrame, edges: DataFrame, n_fft: int, keys: Sequence[str] = ("mid", "channel"), fs: float | None = None, last_inclusive: bool = True, pseudocount: float = 0.0) -> DataFrame:
    """N21 (last edge in the last band) and N13/N14 (left out): dense keys, band, e and prob; a spectrum that is missing or NaN gives all to band 0."""
    unit = sampling_rate(fs)[0] / n_fft
    rows = spectra.join(edges, "channel").withColumn("k", F.size("edges") - 1)
    modes = rows.select(*keys, "edges", "k", F.posexplode("power").alias("i", "e")).withColumn("f", F.col("i") * unit)
    at = F.size(F.filter("edges", lambda x: x <= F.col("f"))) - 1
    band = F.when(F.lit(last_inclusive) & (F.col("f") == F.element_at("edges", -1)), F.col("k") - 1).otherwise(at)
    own = modes.withColumn("band", band).where((F.col("band") >= 0) & (F.col("band") < F.col("k"))).groupBy(*keys, "band").agg(F.sum("e").alias("e"))
    grid = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("band"))
    dense = grid.join(own, [*keys, "band"], "left").withColumn("e", F.coalesce("e", F.lit(0.0)) + pseudocount)
    return safe_normalized(dense, keys, "band", "e")


def padded_spectrum(vectors: DataFrame, n_fft: int, keys: Sequence[str] = ("mid", "channel")) -> DataFrame:
    """Power of the first n_fft finite samples, demeaned and filled up with zeros, without a window."""

    def power(x: np.ndarray, _: str) -> np.ndarray | None:
        x = x[np.isfinite(x)][:n_fft]
        return np.abs(np.fft.rfft(x - x.mean(), n_fft)) ** 2 / n_fft if len(x) else None

    return states._spectra(vectors, keys, power)


def same_grid(spectra: DataFrame, key: str = "channel") -> DataFrame:
    """Spectra, after a check that each channel has one grid of frequencies."""
    bad = spectra.where("power is not null").groupBy(key).agg(F.countDistinct(F.size("power")).alias("n")).where("n > 1").first()
    if bad:
        raise ContractError(f"channel {bad[key]} has {bad['n']} grids of frequencies")
    return spectra


def energy_summary(bands: DataFrame, spectra: DataFrame, base: float = 2.0) -> DataFrame:
    """Mid, valid channels, mean, deviation and norm of the channels' entropies, and status OK, PARTIAL or FAIL."""
    good = spectra.where(F.col("power").isNotNull()).select("mid", "channel")
    h = states.entropy(bands.join(good, ["mid", "channel"], "left_semi"), base=base)
    own = spectra.groupBy("mid").agg(F.countDistinct("channel").alias("n_channels")).join(states.across_channels(h), "mid", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    status = F.when(F.col("n_valid") == 0, "FAIL").when(F.col("n_valid") < F.col("n_channels"), "PARTIAL").otherwise("OK")
    return own.withColumn("status", status)


def modal_summary(spectra: DataFrame, n_fft: int, fs: float | None = None, low: float = 0.0, high: float | None = None, alpha: float = 0.0, base: float = 2.0) -> DataFrame:
    """Entropy and number of modes between low and high, the constant one left out."""
    unit = sampling_rate(fs)[0] / n_fft
    rows = same_grid(spectra).select("mid", "channel", F.posexplode("power").alias("i", "e")).withColumn("f", F.col("i") * unit)
    rows = rows.where((F.col("i") > 0) & (F.col("f") >= low) & (F.lit(True) if high is None else F.col("f") <= high))
    p = F.try_divide(F.greatest("e", F.lit(0.0)) + alpha, F.sum(F.greatest("e", F.lit(0.0)) + alpha).over(Window.partitionBy("mid", "channel")))
    return rows.withColumn("p", p).groupBy("mid", "channel").agg(F.sum(S.entropy_term(F.col("p"), base)).alias("h"), F.count("*").alias("n_modes"))


def states_table(queue: DataFrame, signal: DataFrame, edges: DataFrame) -> DataFrame:
    """Mid, channel, h and status for every measurement of the queue and every channel of the contract: ok, missing_mid, missing_signal or missing_channel."""
    h = states.entropy(states.pmf(signal.join(queue.select("mid").distinct(), "mid", "left_semi"), edges))
    have = h.select("mid").distinct().withColumn("__have", F.lit(True))
    channels = sorted(r["channel"] for r in edges.select("channel").distinct().collect())  # a name a channel
    grid = queue.select("mid", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    rows = grid.join(h.select("mid", "channel", "h"), ["mid", "channel"], "left").join(have, "mid", "left")
    status = F.when(F.col("mid").isNull(), "missing_mid").when(F.col("__have").isNull(), "missing_signal").when(F.col("h").isNull(), "missing_channel").otherwise("ok")
    return rows.withColumn("status", status).drop("__have")

