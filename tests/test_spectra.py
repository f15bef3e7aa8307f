"""Spectra of signals longer and shorter than a block."""

import numpy as np
import pytest

from tessera.operators import states

SCHEMA = "mid int, channel string, samples array<double>"


def test_full_length(spark):
    xs = [np.random.default_rng(n).normal(size=n) for n in (200, 37, 1)]
    v = spark.createDataFrame([(i, "c", x.tolist()) for i, x in enumerate(xs)] + [(9, "c", []), (10, "c", None)], SCHEMA)
    got = {r.mid: r.power for r in states.full_spectrum(v).collect()}
    assert got[9] is None and got[10] is None
    assert all(np.allclose(got[i], np.abs(np.fft.rfft(x - x.mean())) ** 2) for i, x in enumerate(xs))


@pytest.mark.parametrize("window", ["boxcar", "hann", "hamming", "blackman"])
def test_blocks(spark, window):
    x = np.random.default_rng(1).normal(size=300)
    few, many = x.copy(), x.copy()
    few[70] = np.nan
    many[236:300:4] = np.inf
    v = spark.createDataFrame([(1, "c", x.tolist()), (2, "c", few.tolist()), (3, "c", many.tolist()), (4, "c", x[:40].tolist()), (5, "c", x[:64].tolist()), (6, "c", [None] * 64)], SCHEMA)
    got = {r.mid: r.power for r in states.psd(v, 64, window=window).collect()}
    w = {"boxcar": np.ones, "hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman}[window](64)

    def want(y, starts):
        cut = [np.where(np.isfinite(y[s : s + 64]), y[s : s + 64], 0) for s in starts]
        return np.mean([np.abs(np.fft.rfft((b - b.mean()) * w)) ** 2 / 64 for b in cut], axis=0)

    starts = [0, 59, 118, 177, 236]
    assert np.allclose(got[1], want(x, starts)) and np.allclose(got[2], want(few, starts)) and np.allclose(got[3], want(many, starts[:4]))
    assert got[4] is None and got[6] is None and np.allclose(got[5], want(x, [0]))
