"""Operator 6: approximate nearest neighbours on shifted Hilbert curves.

Each of several orderings projects the vectors to a few dimensions with an own random rotation, maps each coordinate to (0, 1),
adds an own shift and takes the position on a Hilbert curve. Keys are cut into ranges of like size by quantiles over all rows;
a query goes to its own range and the ones next to it on either side, meets their vectors there, and the best of all orderings
are merged and ranked by the exact inner product in double precision. Largest inner product becomes nearest neighbour by one
added coordinate, sqrt(M^2 - |x|^2) with M the largest norm.

Equal vectors are indexed once: a class keeps its k + 1 smallest ids, which are all that can appear in an answer, so a very
common vector costs one row and its answers are exact. The projection's mean and deviation are fitted on at most ``fit_rows``
vectors (a documented bound); every vector is indexed. ``window`` is the share of the ranges to either side. Vectors without
structure (the test table's are spread evenly over 64 dimensions) need a wide one for recall 0.9; for clustered vectors a
window of a few ranges does, and the work is then linear in the rows.

Defined cases: vectors null, empty, zero or with null or non-finite components take no part; vectors of another length have no inner product
with a query and are searched apart, one search a length, each with its own curves; below 64 vectors of a length there is one range, so that search is exact;
ids are whole numbers (others raise);
repeated rows (id and vector equal) count once; ties go to smaller ids, those at the end of a list included; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, stash

ORDERINGS, DIMS, BITS = 8, 10, 4
RANGE_ROWS = 8192
#: There are as many ranges at least, while each has as many rows.
LEAST_RANGES, LEAST_ROWS = 32, 32
WINDOW = 0.1
FIT_ROWS = 10_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer cells (n x dims, each below 2**bits)."""
    x = [c.astype(np.uint64) for c in cells.T]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(x)):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip = np.where((x[-1] & bit) != 0, flip ^ (bit - one), flip)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ flip) >> np.uint64(level)) & one)
    return key.astype(np.int64)


class Curves:
    """The orderings' rotations, shifts and scales, and the largest norm."""

    def __init__(self, sample: np.ndarray, norm: float, orderings: int = ORDERINGS, dims: int = DIMS, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = sample.shape[1] + 1
        dims = min(dims, wide)
        self.norm = norm
        self.maps = [np.linalg.qr(rng.normal(size=(wide, dims)))[0] for _ in range(orderings)]
        self.shifts = [rng.random(dims) for _ in range(orderings)]
        full = self.lift(sample)
        self.scales = [((p := full @ m).mean(0), p.std(0) + 1e-12) for m in self.maps]

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        size = np.sqrt((x * x).sum(1, keepdims=True))
        if query:
            return np.hstack([x * (self.norm / size), np.zeros_like(size)])
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.norm**2 - size**2))])

    def keys(self, x: np.ndarray, ids: np.ndarray, query: bool = False) -> list[np.ndarray]:
        full, out = self.lift(x, query), []
        tail = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)
        for m, shift, (mean, dev) in zip(self.maps, self.shifts, self.scales, strict=True):
            even = 1 / (1 + np.exp(-1.702 * (full @ m - mean) / dev))
            cells = np.minimum((even + shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            out.append(hilbert_keys(cells, BITS) << 20 | tail.astype(np.int64))
        return out


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, window: float = WINDOW, fit_rows: int = FIT_ROWS, orderings: int = ORDERINGS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row where is_query holds. vectors: vec_id, embedding."""
    if dict(vectors.dtypes)["vec_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("vec_id must be a whole number")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.distinct()
    lengths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).agg(F.count("*")).orderBy("n").collect()]  # a number each
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_nearest(rows.where(F.size("v") == n) if len(lengths) > 1 else rows, is_query, k, window, fit_rows, orderings) for n in lengths]
    for i, part in enumerate(parts):
        found = part if i == 0 else found.unionByName(part)
    return found


def _nearest(rows: DataFrame, is_query: Column, k: int, window: float, fit_rows: int, orderings: int) -> DataFrame:
    """nearest, for usable rows of one length."""
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    few = stash(rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1), "members")
    heads = few.where("r = 1").select(F.col("vec_id").alias("cid"), "v")
    members = few.join(heads, "v").select("cid", "vec_id")
    queries = stash(rows.where(is_query).join(heads, "v").select(F.col("vec_id").alias("query_id"), "cid"), "queries")
    asked = heads.join(queries.select("cid").distinct(), "cid")
    norm = heads.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count("*")).first()
    sample = heads.orderBy(F.xxhash64("cid"), "cid").limit(fit_rows).toPandas()  # bounded by fit_rows
    curves = Curves(_matrix(sample["v"]), float(norm[0]), orderings)

    def keyed(query: bool):
        def work(batches):
            for pdf in batches:
                if len(pdf):
                    keys = curves.keys(_matrix(pdf["v"]), pdf["cid"].to_numpy(), query)
                    yield pd.concat([pd.DataFrame({"o": o, "key": key, "cid": pdf["cid"], "v": pdf["v"]}) for o, key in enumerate(keys)])

        return work

    shape = "o int, key long, cid long, v array<double>"
    points, probes = heads.mapInPandas(keyed(False), shape), asked.mapInPandas(keyed(True), shape)
    ranges = parts_for(norm[1], RANGE_ROWS, min(LEAST_RANGES, max(1, norm[1] // LEAST_ROWS)))
    cuts = np.zeros((orderings, ranges - 1), np.int64)
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        for r in points.groupBy("o").agg(F.percentile_approx("key", at, 20 * ranges).alias("c")).collect():  # ranges - 1 numbers an ordering
            cuts[r["o"]] = r["c"]
    side = max(1, round(window * ranges))

    @F.pandas_udf("int")
    def range_of(o: pd.Series, key: pd.Series) -> pd.Series:
        out, o, key = np.zeros(len(o), np.int32), o.to_numpy(), key.to_numpy()
        for i in range(orderings):
            out[o == i] = np.searchsorted(cuts[i], key[o == i], "right")
        return pd.Series(out)

    points = points.withColumn("range", range_of("o", "key")).drop("key")
    probes = probes.withColumn("at", range_of("o", "key")).drop("key")
    # at the ends of a curve the window keeps its width
    low = F.greatest(F.lit(0), F.least(F.col("at") - side, F.lit(ranges - 1 - 2 * side)))
    high = F.least(F.lit(ranges - 1), F.greatest(F.col("at") + side, F.lit(2 * side)))
    probes = probes.withColumn("range", F.explode(F.sequence(low, high))).drop("at")

    def meet(points: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(probes):
            x, ids = _matrix(points["v"]), points["cid"].to_numpy()
            for at in range(0, len(probes), 256):
                q, own = _matrix(probes["v"].iloc[at : at + 256]), probes["cid"].to_numpy()[at : at + 256]
                scores = q @ x.T
                keep = min(k + 2, len(ids))
                least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                slack = 1e-9 * (1 + np.abs(least))  # the product of matrices may round apart from the exact score
                for i in range(len(q)):
                    best = np.flatnonzero(scores[i] >= least[i] - slack[i])  # ties at the end are all in
                    exact = (x[best] * q[i]).sum(1)
                    order = np.lexsort((ids[best], -exact))[: k + 2]
                    out.append(pd.DataFrame({"query": own[i], "cid": ids[best][order], "score": exact[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "cid": [], "score": []})

    found = points.groupBy("o", "range").cogroup(probes.groupBy("o", "range")).applyInPandas(meet, "query long, cid long, score double").distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 2).drop("r")
    pairs = queries.join(found.select(F.col("cid").alias("near"), F.col("query").alias("cid"), "score"), "cid").select("query_id", "near", "score")
    pairs = pairs.join(members.withColumnRenamed("cid", "near"), "near").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
