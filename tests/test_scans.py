"""Ranked tests, samples and filters that must not pass through one task."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import inference, relational


def bh(p):
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.empty(len(p))
    q[order] = np.clip(np.minimum.accumulate(raw[::-1])[::-1], 0, 1)
    return q


def test_bh_fdr(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(300), rng.integers(1, 40, 300) / 5001, 10.0 ** -rng.integers(3, 300, 50), [0.0, 0.0, 1.0, 1.0]])
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(9999, None)], "n int, p double").repartition(5)
    got = {r.n: r.q for r in inference.bh_fdr(rows).collect()}
    assert got.pop(9999) is None
    assert np.allclose([got[i] for i in range(len(p))], bh(p))
    assert inference.bh_fdr(rows.limit(0)).count() == 0


def test_samples(spark):
    rows = spark.createDataFrame([(f, "c" if f < 4 else "d", i) for f in range(6) for i in range(f * 20)], "mid int, channel string, idx int").repartition(4)
    digest = lambda m, i: hashlib.md5(f"{m}:{i}:3".encode()).hexdigest()
    every = [(r.mid, r.channel, r.idx) for r in rows.collect()]
    files = {}
    for r in every:
        files.setdefault((r[0], r[1]), []).append(r)
    capped = [r for own in files.values() for r in sorted(own, key=lambda r: digest(r[0], r[2]))[:15]]
    want = [r for c in "cd" for r in sorted((r for r in capped if r[1] == c), key=lambda r: digest(r[0], r[2]))[:25]]
    got = relational.capped_sample(rows, 15, 25, ["mid", "channel"], ["channel"], ["mid", "idx"], seed=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert relational.sampled(rows, 10**6, ["channel"], ["mid", "idx"]).count() == len(every)


def test_light_channels(spark):
    roles = [("m1", "Ch1", "Luz roja"), ("m2", "Ch1", "x"), ("m2", "Ch2", "y"), ("m3", "Ch7", "my LASER"), ("m3", "Ch3", "accel")]
    frame = spark.createDataFrame(roles, "mid string, canonical_name string, raw_name string")
    assert sorted((r.mid, r.canonical_name) for r in relational.light_channels(frame).collect()) == [("m1", "Ch1"), ("m2", "Ch1"), ("m3", "Ch7")]
    none = frame.where(~F.lower("raw_name").rlike("luz|laser"))
    assert sorted((r.mid, r.canonical_name) for r in relational.light_channels(none).collect()) == [("m2", "Ch1"), ("m2", "Ch2"), ("m3", "Ch3")]


def test_attached_with_and_without_fill(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20)], "mid int, path int")
    other = spark.createDataFrame([(1, 99, "a", 0), (7, 20, "b", 1)], "mid int, path int, label string, row_no int")
    pick = lambda fill: [r.label for r in relational.attached(rows, other, ["mid", "path"], "row_no", fill).orderBy("mid").collect()]
    assert pick(True) == ["a", "b"] and pick(False) == ["a", None]
