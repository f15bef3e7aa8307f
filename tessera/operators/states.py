"""PMFs, entropies, mutual information, divergences and spectra (N9, N11-N17, N20 uniform, N21, N23, N27, W7, O4)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def pmf(signal: DataFrame, edges: DataFrame, keys=("mid", "channel"), missing: bool = True) -> DataFrame:
    """N11/N12 with N17: dense (key, bin, bin_left, bin_right, prob). Edges have a row a channel.

    missing: whether rows without a value count, in the first bin. A group without a row that counts has its whole mass in the first bin.
    """
    cell = signal.join(edges, "channel").withColumn("bin", S.bin_index(F.col("edges"), F.col("value")))
    counts = cell.groupBy(*keys, "bin").agg(F.count("*" if missing else "value").alias("k"))
    own = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("ks"), F.sum("k").alias("n"))  # no more than there are bins
    dense = own.join(edges, "channel").select(*keys, "ks", "n", "edges", F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("bin", "bin_left"))
    share = F.when(F.col("n") == 0, (F.col("bin") == 0).cast("double")).otherwise(F.coalesce(F.element_at("ks", F.col("bin")), F.lit(0)) / F.col("n"))
    return dense.select(*keys, "bin", "bin_left", F.element_at("edges", F.col("bin") + 2).alias("bin_right"), share.alias("prob"))


def movement_pmf(signal: DataFrame, edges: DataFrame) -> DataFrame:
    """Dense PMF of first differences over the contract's increment edges (channel, edges); under two samples all mass is in the first bin."""
    last = F.lag("value").over(Window.partitionBy("mid", "channel").orderBy("idx"))
    return pmf(signal.withColumn("value", F.col("value") - last), edges, missing=False)


def entropy(pmf: DataFrame, keys=("mid", "channel"), base: float = 2.0) -> DataFrame:
    """F23 over a PMF."""
    return pmf.groupBy(*keys).agg(F.sum(S.entropy_term(F.col("prob"), base)).alias("h"), F.count("*").alias("n_bins"))


def across_channels(h: DataFrame, keys=("mid",)) -> DataFrame:
    """N27 with A13: mean, population deviation and norm of the channels' entropies."""
    many = F.count("h") > 1
    return h.groupBy(*keys).agg(F.count("h").alias("n_valid"), F.avg("h").alias("mu"), F.when(many, F.stddev_pop("h")).alias("sigma"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("norm2"))


def joint_counts(wide: DataFrame, edges: DataFrame, channels: Sequence[str], keys=("mid",)) -> DataFrame:
    """Counts of (channel_i, channel_j, bi, bj) at equal samples, i < j.

    wide has a column a channel, so a row is a sample: its bins are paired in place and counted before anything is shuffled. The
    edges of all channels (a row each) reach the tasks as one map.
    """
    names = sorted(channels)
    known = edges.agg(F.map_from_entries(F.collect_list(F.struct("channel", "edges"))).alias("m")).scalar()
    rows = wide.withColumn("__m", known)
    rows = rows.select(*keys, *[S.bin_index(F.element_at("__m", F.lit(c)), F.col(c)).alias(f"__{i}") for i, c in enumerate(names)])
    both = [(i, j) for j in range(len(names)) for i in range(j)]
    # channels and bins as one number: groups are held in memory, and four columns would be twice as large
    bits = lambda x, by: F.shiftleft(x.cast("long"), by)
    codes = [bits(F.lit(n), 40) + bits(F.col(f"__{i}"), 20) + F.col(f"__{j}") for n, (i, j) in enumerate(both)]
    own = rows.select(*keys, F.explode(F.array(*codes)).alias("__c")).groupBy(*keys, "__c").agg(F.count("*").alias("k"))
    part = lambda by: F.shiftright("__c", by).bitwiseAND((1 << 20) - 1).cast("int")
    name = lambda side: F.element_at(F.array(*[F.lit(names[p[side]]) for p in both]), part(40) + 1)
    return own.select(*keys, name(0).alias("channel_i"), name(1).alias("channel_j"), part(20).alias("bi"), part(0).alias("bj"), "k")


def mutual_information(joint: DataFrame, base: float = 2.0, keys=("mid",)) -> DataFrame:
    """Mutual information, entropies of both channels, conditional entropy of the first and both uncertainty coefficients.

    A coefficient is the information over the entropy of the channel it explains, 0 where that has none (definitions inferred).
    """
    pair = [*keys, "channel_i", "channel_j"]
    n = F.sum("k").over(Window.partitionBy(*pair))
    ki, kj = (F.sum("k").over(Window.partitionBy(*pair, b)) for b in ("bi", "bj"))
    rows = joint.withColumn("kj", kj).withColumn("n", n).withColumn("ki", ki)  # in this order n needs no sort of its own
    rows = rows.withColumns({"p": F.col("k") / F.col("n"), "pi": F.col("ki") / F.col("n"), "pj": F.col("kj") / F.col("n")})
    log = lambda x: F.log(base, x)
    sums = {"mi": F.col("p") * log(F.col("p") / (F.col("pi") * F.col("pj"))), "h_i": -F.col("p") * log(F.col("pi")), "h_j": -F.col("p") * log(F.col("pj")), "h_cond": -F.col("p") * log(F.col("p") / F.col("pj"))}
    own = rows.groupBy(*pair).agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    share = lambda h: F.when(F.abs(F.col(h)) > 1e-12, F.col("mi") / F.col(h)).otherwise(0.0)
    return own.withColumns({"u_i": share("h_i"), "u_j": share("h_j")})


def consecutive_kl(pmf: DataFrame, keys=("lab", "laser"), step: str = "day", eps: float = 1e-12, base: float = 2.0) -> DataFrame:
    """KL of consecutive PMFs both ways with an additive eps (definition inferred); steps without a successor are absent."""
    w = Window.partitionBy(*keys, "bin").orderBy(step)
    rows = pmf.withColumns({"to": F.lead(step).over(w), "q": F.lead("prob").over(w)}).where(F.col("to") == F.col(step) + 1)
    p, q = F.col("prob") + eps, F.col("q") + eps
    return rows.groupBy(*keys, step).agg(F.sum(p * F.log(base, p / q)).alias("fwd"), F.sum(q * F.log(base, q / p)).alias("bwd"))


WINDOWS = {"boxcar": np.ones, "hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman}


def block_starts(n: int, n_fft: int, blocks: int, how: str = "uniform", seed: str = "") -> list[int]:
    """Starts of blocks: the middle for one, rounded even steps (equal ones count again), or a seeded choice in order; all if there are few."""
    last = n - n_fft
    if last <= 0:
        return [0] if last == 0 else []
    blocks = max(1, blocks)
    if how == "uniform":
        return [last // 2] if blocks == 1 else [int(x) for x in np.linspace(0, last, blocks).round()]
    if last + 1 <= blocks:
        return list(range(last + 1))
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "little"))
    return sorted(int(x) for x in rng.choice(last + 1, size=blocks, replace=False))


def _spectra(vectors: DataFrame, keys, power) -> DataFrame:
    """keys and power(samples, name) of each signal, in Arrow batches; its name is its keys with a bar between."""

    def work(batches):
        for pdf in batches:
            names = pdf[list(keys)].astype(str).agg("|".join, axis=1)
            found = [power(np.zeros(0) if v is None else np.asarray(v, float), name) for v, name in zip(pdf["samples"], names, strict=True)]
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame({"power": pd.Series(found, dtype=object)})], axis=1)

    kinds = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)
    return vectors.select(*keys, "samples").mapInPandas(work, f"{kinds}, power array<double>")


def full_spectrum(vectors: DataFrame, keys=("mid", "channel")) -> DataFrame:
    """N13's spectrum: power of the demeaned signal over its full length; a missing sample makes it NaN, an empty signal has null power."""
    return _spectra(vectors, keys, lambda x, _: np.abs(np.fft.rfft(x - x.mean())) ** 2 if len(x) else None)


def psd(vectors: DataFrame, n_fft: int, keys=("mid", "channel"), blocks: int | None = None, window: str = "boxcar", max_bad: float = 0.05, selection: str = "uniform", detrend: bool = True, min_blocks: int = 1) -> DataFrame:
    """N21's spectrum: mean power of the demeaned, windowed blocks of n_fft samples, at N20's starts.

    blocks: how many; as many as cover the whole signal if None. selection: uniform, or random with a seed of the signal's keys, so that
    reruns and other partitions choose alike. A block with a larger share of non-finite samples than max_bad is left out, else these count
    as 0. A signal with fewer usable blocks than min_blocks, as one shorter than n_fft, has null power. An unknown window or selection raises.
    """
    if window not in WINDOWS or selection not in ("uniform", "random"):
        raise ValueError(f"unknown window or selection: {window}, {selection}")
    w = WINDOWS[window](n_fft)

    def power(x, name):
        total, used = np.zeros(n_fft // 2 + 1), 0
        for s in block_starts(len(x), n_fft, -(-len(x) // n_fft) if blocks is None else blocks, selection, name):
            block = x[s : s + n_fft]
            bad = ~np.isfinite(block)
            if bad.mean() > max_bad:
                continue
            block = np.where(bad, 0.0, block)
            total += np.abs(np.fft.rfft((block - block.mean() * detrend) * w)) ** 2 / n_fft
            used += 1
        return total / used if used >= max(1, min_blocks) else None

    return _spectra(vectors, keys, power)


def bands(spectra: DataFrame, n_bands: int, keys=("mid", "channel")) -> DataFrame:
    """Energy share of equal bands of frequencies; the last band holds the last edge."""
    rows = spectra.select(*keys, F.size("power").alias("n"), F.posexplode("power").alias("f", "e"))
    band = F.least(F.floor(F.col("f") * n_bands / (F.col("n") - 1)), F.lit(n_bands - 1)).cast("int")
    rows = rows.groupBy(*keys, band.alias("band")).agg(F.sum("e").alias("e"))
    return rows.withColumn("prob", F.try_divide("e", F.sum("e").over(Window.partitionBy(*keys))))


def modal_entropy(spectra: DataFrame, keys=("mid", "channel"), alpha: float = 0.0, base: float = 2.0) -> DataFrame:
    """Entropy over modes without the constant one, with additive smoothing."""
    modes = spectra.select(*keys, F.posexplode("power").alias("f", "e")).where("f > 0").withColumn("e", F.greatest(F.col("e"), F.lit(0.0)) + alpha)
    p = F.try_divide("e", F.sum("e").over(Window.partitionBy(*keys)))
    return modes.withColumn("p", p).groupBy(*keys).agg(F.sum(S.entropy_term(F.col("p"), base)).alias("h"), F.count("*").alias("n_modes"))


def top_modes(spectra: DataFrame, k: int, keys=("mid", "channel")) -> DataFrame:
    """Modes of most energy, ties by frequency."""
    modes = spectra.select(*keys, F.posexplode("power").alias("f", "e")).where("f > 0")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("e", 9).desc(), "f"))
    return modes.withColumn("r", rank).where(F.col("r") <= k)
