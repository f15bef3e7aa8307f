"""The bins contract (N10): edges of amplitudes, increments and coupling categories of every channel, and what they rest on.

Amplitude and increment edges are equiprobable over a support (N1, N6) in as many bins as N3 finds for the channel, and lose inner edges
closer than ``width_sigma`` robust deviations (N5); coupling edges have N7's number of categories and the same rule with a floor of 1e-9. All
quantiles come from ``ranks``, each channel with its own number of ranks. All values count; nothing is sampled.

A contract has a row a channel and is read by many queries, so ``contract`` computes it when called: the counts of values and increments are
kept for its steps, and each step's few rows go on as values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BinsPolicy
from . import bins, ranks

PCT = bins.PCT
KEYS = (PCT,)
LEAST_WIDTH = 1e-9


class ContractError(ValueError):
    pass


def _even(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n), lambda i: i / n)


def _edges(counts: DataFrame, stats: DataFrame, count: str, low: str, high: str, width: Column, p: BinsPolicy) -> DataFrame:
    """channel and edges: as many equiprobable bins as the column count says, ties broken, narrow ones merged."""
    at = stats.select(PCT, _even(F.col(count)).alias("at"), F.col(low).alias("lo"), F.col(high).alias("hi"), width.alias("width"))
    own = ranks.quantiles(counts, at.select(PCT, "at", "lo", "hi"), KEYS, clip=("lo", "hi")).join(at.drop("at"), PCT)
    edges = bins.increasing(F.col("q"), p.epsilon)
    merged = bins.increasing(bins.merge_narrow(F.col("edges"), F.col("width")), p.epsilon)
    return own.withColumn("edges", edges).select(PCT, merged.alias("edges"))


def statistics(amp: DataFrame, dx: DataFrame, p: BinsPolicy = BinsPolicy()) -> DataFrame:
    """A row a channel of what edges rest on, from the counts of values and of increments.

    n, lo, hi, sigma and b_amp of the values; n_dx, sigma_dx, support and b_dx of the increments; q, the wanted number of coupling categories.
    """
    names = lambda *c: [F.col("q")[i].alias(x) for i, x in enumerate(c)]
    own = ranks.quantiles(amp, [0.25, 0.5, 0.75], KEYS, trim=p.support_q).select(PCT, "n", "lo", "hi", *names("q25", "med", "q75"))
    own = own.join(ranks.mad_sigma(amp, own, KEYS), PCT)
    own = own.withColumn("b_amp", bins.fd_count(F.col("n"), F.col("lo"), F.col("hi"), F.col("q25"), F.col("q75"), p))
    steps = ranks.quantiles(dx, [0.25, 0.5, 0.75]).select(PCT, F.col("n").alias("n_dx"), *names("d25", "med", "d75"))
    tail = ranks.quantiles(ranks.absolute(dx, KEYS), [p.increment_q, 1.0]).select(PCT, *names("tail", "most"))
    steps = steps.join(ranks.mad_sigma(dx, steps, KEYS).withColumnRenamed("sigma", "sigma_dx"), PCT).drop("med").join(tail, PCT)
    steps = steps.withColumn("support", bins.tail_support(F.col("tail"), F.col("sigma_dx"), F.col("most"))).withColumn("below", -F.col("support"))
    steps = steps.withColumn("b_dx", bins.fd_count(F.col("n_dx"), F.col("below"), F.col("support"), F.col("d25"), F.col("d75"), p))
    low, high, per = p.coupling
    q = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.sqrt(F.col("least") / per)))).cast("int")
    least = own.agg(F.min("n").alias("least")).scalar()
    own = own.withColumn("least", least).withColumn("q", q).drop("least")
    return ranks.fixed(own.join(steps, PCT, "left"))


def contract(signal: DataFrame, p: BinsPolicy = BinsPolicy(), least: tuple[int, int] = (4096, 1024), strict: bool = True, steps: DataFrame | None = None) -> DataFrame:
    """Channel, n, n_dx, sigma, sigma_dx, amplitude, increment and coupling edges and problem, a row a channel.

    problem: few_samples, no_support, amplitude_collapsed, few_increments, no_increment_support, increment_collapsed, or null; where strict, a
    problem raises. least: fewest samples and increments. steps: the increments, where they are at hand (``bins.steps``).
    """
    with ranks.kept(ranks.counted(signal, [PCT])) as amp, ranks.kept(ranks.counted(bins.increments(signal) if steps is None else steps, [PCT])) as dx:
        stats = statistics(amp, dx, p)
        wide = lambda sigma, floor: F.greatest(F.lit(floor), F.coalesce(p.width_sigma * F.col(sigma), F.lit(0.0)))
        amplitude = _edges(amp, stats, "b_amp", "lo", "hi", wide("sigma", p.epsilon), p).withColumnRenamed("edges", "amplitude")
        coupling = _edges(amp, stats, "q", "lo", "hi", wide("sigma", LEAST_WIDTH), p).withColumnRenamed("edges", "coupling")
        increment = _edges(dx, stats.where("b_dx is not null"), "b_dx", "below", "support", wide("sigma_dx", p.epsilon), p).withColumnRenamed("edges", "increment")
        rows = stats.join(amplitude, PCT, "left").join(coupling, PCT, "left").join(increment, PCT, "left")
        fewest = max(256, least[1])
        problem = F.when(F.col("n") < least[0], "few_samples").when(~(F.col("hi") > F.col("lo")), "no_support").when(F.size("amplitude") < 3, "amplitude_collapsed")
        problem = problem.when(F.coalesce("n_dx", F.lit(0)) < fewest, "few_increments").when(~(F.col("support") > 0), "no_increment_support").when(F.size("increment") < 3, "increment_collapsed")
        rows = ranks.fixed(rows.select(PCT, "n", "n_dx", "sigma", "sigma_dx", "amplitude", "increment", "coupling", problem.alias("problem")))
    if strict and (wrong := rows.where("problem is not null").first()):
        raise ContractError(f"channel {wrong[PCT]}: {wrong['problem']}, {wrong['n']} samples, {wrong['n_dx']} increments")
    return rows


def edges_of(spec: DataFrame, kind: str) -> DataFrame:
    """channel and edges of one kind: amplitude, increment or coupling."""
    return spec.select(PCT, F.col(kind).alias("edges"))


def long_edges(spec: DataFrame) -> DataFrame:
    """channel, kind, i and edge: the contract as a table."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("edges")) for k in ("amplitude", "increment", "coupling")]
    rows = spec.select(PCT, F.explode(F.array(*kinds)).alias("c"))
    return rows.select(PCT, "c.kind", F.posexplode("c.edges").alias("i", "edge"))
