"""Exact order statistics and quantiles of groups, by counts; no group meets in one task.

Values are counted by group (partial sums before the shuffle), and the counts are kept while ranks are looked for. A group's range is
cut into ``CELLS`` even cells; running totals over the cells tell which of them hold the wanted ranks. Each of these few is cut again between
its own least and largest value, so that outliers, heavy tails and dense spots only cost another pass over the counts, until a cell holds one
value: that is the order statistic. Windows run over the totals of at most ``CELLS`` cells. What returns from a pass are the cells of
wanted ranks, two for each quantile of a group; so the groups must be few (channels, not measurements), and the functions that
look for ranks run their jobs when called.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

CELLS = 4096


def counted(rows: DataFrame, keys: Sequence[str], value: str | Column = "value") -> DataFrame:
    """keys, value and k: how often each finite value stands in each group."""
    x = F.col(value) if isinstance(value, str) else value
    own = rows.select(*keys, S.finite(x.cast("double")).alias("value")).where("value is not null")
    return own.groupBy(*keys, "value").agg(F.count("*").alias("k"))


def absolute(counts: DataFrame, keys: Sequence[str], about: str | None = None) -> DataFrame:
    """Counts of absolute values, or of distances from the column about."""
    x = F.abs(F.col("value") - F.col(about)) if about else F.abs("value")
    return counts.select(*keys, x.alias("value"), "k").groupBy(*keys, "value").agg(F.sum("k").alias("k"))


def values(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A few rows as a literal: unlike a frame made of Python objects, it needs no Python worker and is folded by the optimizer."""
    data = json.dumps([dict(zip(schema.names, r, strict=True)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(data), T.ArrayType(schema))))


@contextmanager
def kept(counts: DataFrame) -> Iterator[DataFrame]:
    """counts, kept by Spark while several passes read them."""
    if counts.is_cached:
        yield counts
        return
    counts = counts.persist()
    try:
        yield counts
    finally:
        counts.unpersist()


def fixed(rows: DataFrame) -> DataFrame:
    """rows as values, computed now: for tables with a row a channel."""
    return values(rows.sparkSession, rows.collect(), rows.schema)


def _cell() -> Column:
    """The cell of value between low and high. Rounding keeps the order of values, so no value passes another one; both ends are in different cells."""
    place = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS)
    return F.when(F.col("high") > F.col("low"), F.least(F.lit(CELLS - 1), place)).otherwise(0).cast("int")


def order_statistics(counts: DataFrame, wanted: dict[tuple, list[int]], keys: Sequence[str], spans: dict[tuple, tuple]) -> dict[tuple, dict[int, float]]:
    """The values at the wanted ranks (from 0) of each group. spans: least and largest value by group."""
    spark, kinds = counts.sparkSession, [counts.schema[k] for k in keys]
    found: dict[tuple, dict[int, float]] = {g: {} for g in wanted}
    # cells by path from the group's range downwards: (low, high, ranks as counted from the cell's begin, ranks)
    level = {g: (*spans[g], r, r) for g, r in ((g, sorted(set(r))) for g, r in wanted.items()) if r}
    rows, path = counts, list(keys)
    while True:
        done = [p for p, (low, high, _, _) in level.items() if low == high]
        for p in done:
            low, _, _, ranks = level.pop(p)
            found[p[: len(keys)]].update(dict.fromkeys(ranks, low))
        if not level:
            return found
        schema = T.StructType([*kinds, *[T.StructField(c, T.IntegerType()) for c in path[len(keys) :]], *T.StructType.fromDDL("low double, high double, asks array<long>").fields])
        cells = values(spark, [(*p, low, high, rests) for p, (low, high, rests, _) in level.items()], schema)
        cell = f"cell{len(path)}"
        rows = rows.join(F.broadcast(cells.drop("asks")), path).withColumn(cell, _cell()).drop("low", "high")
        own = rows.groupBy(*path, cell).agg(F.sum("k").alias("k"), F.min("value").alias("low"), F.max("value").alias("high"))
        own = own.withColumn("upto", F.sum("k").over(Window.partitionBy(*path).orderBy(cell))).withColumn("start", F.col("upto") - F.col("k"))
        hit = F.filter("asks", lambda a: (a >= F.col("start")) & (a < F.col("upto")))
        own = own.join(F.broadcast(cells.drop("low", "high")), path).withColumn("asks", hit).where(F.size("asks") > 0)
        below = {}
        for r in own.select(*path, cell, "low", "high", "start", "asks").collect():  # two for each quantile of a group, at most
            p = tuple(r[c] for c in path)
            _, _, rests, ranks = level[p]
            known = dict(zip(rests, ranks, strict=True))
            below[(*p, r[cell])] = (r["low"], r["high"], [a - r["start"] for a in r["asks"]], [known[a] for a in r["asks"]])
        level, path = below, [*path, cell]


def quantiles(counts: DataFrame, at: Sequence[float] | DataFrame, keys: Sequence[str] = ("channel",), trim: float | None = None, clip: tuple[str, str] | None = None) -> DataFrame:
    """keys, n (values counted) and q: quantiles in the order of at, linear between neighbours.

    at: shares for all groups, or a frame of keys and the array ``at`` for each. trim: adds lo and hi, the quantiles at trim and 1 - trim,
    and clips the values between them before the other quantiles are taken. clip: clips them between two columns of the frame at instead.
    """
    keys = list(keys)
    with kept(counts) as counts:
        own = {}
        for r in counts.groupBy(*keys).agg(F.sum("k").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect():
            own[tuple(r[k] for k in keys)] = (r["n"], r["low"], r["high"])
        asked = {tuple(r[k] for k in keys): r for r in at.collect()} if isinstance(at, DataFrame) else {}
        shares = {g: asked[g]["at"] for g in own if g in asked} if isinstance(at, DataFrame) else dict.fromkeys(own, list(at))
        ends = [] if trim is None else [trim, 1 - trim]
        places = {g: [p * (own[g][0] - 1) for p in [*s, *ends]] for g, s in shares.items()}
        wanted = {g: [min(math.floor(x) + i, own[g][0] - 1) for x in xs for i in (0, 1)] for g, xs in places.items()}
        known = order_statistics(counts, wanted, keys, {g: s[1:] for g, s in own.items()})

    def value(g: tuple, x: float, low: float, high: float) -> float:
        a, b = (min(high, max(low, known[g][min(math.floor(x) + i, own[g][0] - 1)])) for i in (0, 1))
        return a + (b - a) * (x - math.floor(x))

    out = []
    for g, xs in places.items():
        lo, hi = -math.inf, math.inf
        if trim is not None:
            lo, hi = (value(g, x, lo, hi) for x in xs[-2:])
        elif clip is not None:
            lo, hi = (asked[g][c] for c in clip)
        q = [value(g, x, lo, hi) for x in xs[: len(xs) - len(ends)]]
        out.append((*g, own[g][0], *([lo, hi] if trim is not None else []), q))
    more = "n long, lo double, hi double, q array<double>" if trim is not None else "n long, q array<double>"
    schema = T.StructType([*[counts.schema[k] for k in keys], *T.StructType.fromDDL(more).fields])
    return values(counts.sparkSession, out, schema)


def mad_sigma(counts: DataFrame, medians: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and sigma, 1.4826 times the median distance from the median; medians has keys and med, a row a group."""
    away = absolute(counts.join(F.broadcast(medians.select(*keys, "med")), list(keys)), keys, "med")
    return quantiles(away, [0.5], keys).select(*keys, (1.4826 * F.col("q")[0]).alias("sigma"))
