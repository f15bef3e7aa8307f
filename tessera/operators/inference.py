"""Sequential-change inference from directional KL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recompute(kl: DataFrame, features: list[str], sheet=("lab", "laser")) -> DataFrame:
    """s_k = forward + backward; percent of the sheet's total by feature; g_norm in percent of the sheet's sum. Totals of 0 give 0."""
    w = Window.partitionBy(*sheet)
    rows = kl.withColumns({f"s_{k}": F.col(f"{k}_fwd") + F.col(f"{k}_bwd") for k in features})
    rows = rows.withColumns({f"pct_{k}": F.coalesce(F.try_divide(100 * F.col(f"s_{k}"), F.sum(f"s_{k}").over(w)), F.lit(0.0)) for k in features})
    rows = rows.withColumn("g_raw", sum((F.coalesce(f"pct_{k}", F.lit(0.0)) for k in features), F.lit(0.0)))
    return rows.withColumn("g_norm", F.coalesce(F.try_divide(100 * F.col("g_raw"), F.sum("g_raw").over(w)), F.lit(0.0)))


def long_table(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows with A, the sum of the features' symmetric divergences, missing ones left out."""
    return rows.withColumn("a", sum((F.coalesce(f"s_{k}", F.lit(0.0)) for k in features), F.lit(0.0)))


def within_n_min(rows: DataFrame) -> DataFrame:
    """Transitions up to the number that every series reaches (A16), which is a scalar subquery."""
    return rows.where(F.col("n") <= n_min(rows).scalar())


def location_spread(rows: DataFrame, keys=("lab", "n"), a: str = "a") -> DataFrame:
    """I6 with A15: median and quartile range of g_norm and median of A over lasers, transitions up to N_min only."""
    q = F.percentile("g_norm", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    own = within_n_min(rows).groupBy(*keys).agg(q.alias("q"), F.percentile(a, F.lit(0.5)).alias("abs"))
    return own.select(*keys, F.col("q")[1].alias("loc"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "abs")


def dominance(rows: DataFrame) -> DataFrame:
    """Each (laser, n) up to N_min has one vote, shared by the groups that tie at the maximum."""
    w = Window.partitionBy("laser", "n")
    top = (F.col("g_norm") == F.max("g_norm").over(w)).cast("int")
    votes = within_n_min(rows).withColumn("top", top).withColumn("vote", F.col("top") / F.sum("top").over(w))
    return votes.groupBy("lab", "n").agg(F.sum("vote").alias("dom"))


def n_min(rows: DataFrame) -> DataFrame:
    """A16."""
    return rows.groupBy("lab", "laser").agg(F.max("n").alias("m")).agg(F.min("m").alias("n_min"))


def bh_fdr(tests: DataFrame, p: str = "p") -> DataFrame:
    """I4 with W9: q-values; a test without p has none and does not count.

    Equal p have equal q, so distinct ones are ranked, with the counts of their tests: within cells of log p in parallel, and by running totals
    and minimums over the cells (275,000 at most, for the range of doubles), which is all that passes through one task.
    """
    n = tests.agg(F.count(p)).scalar()
    known = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("k"))
    known = known.withColumn("cell", F.when(F.col("__p") > 0, F.floor(F.log2("__p") * 256)).otherwise(-(1 << 30)))
    own = Window.partitionBy("cell").orderBy("__p")
    cells = known.groupBy("cell").agg(F.sum("k").alias("n"))
    start = cells.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("start"))
    known = known.join(start, "cell").withColumn("raw", F.col("__p") * n / (F.col("start") + F.sum("k").over(own)))
    after = Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    least = known.groupBy("cell").agg(F.min("raw").alias("m")).select("cell", F.min("m").over(after).alias("later"))
    back = Window.partitionBy("cell").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.min("raw").over(back), F.col("later"))))
    known = known.join(least, "cell").select("__p", q.alias("q"))
    return tests.join(known, tests[p] == known["__p"], "left").drop("__p")


def median_gaps(values: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Largest less smallest group median for each row of labels; every row holds the same labels in another order."""
    kinds = np.unique(labels[0])
    if len(kinds) < 2:
        return np.zeros(len(labels))
    every = np.broadcast_to(values, labels.shape)
    medians = [np.median(every[labels == k].reshape(len(labels), -1), axis=1) for k in kinds]
    return np.max(medians, axis=0) - np.min(medians, axis=0)


def permutation_test(rows: DataFrame, group: str = "lab", n_perm: int = 5000, seed: int = 123) -> DataFrame:
    """I3 with O7: largest less smallest group median against permuted labels, a task for each n, seeded by n; one matrix holds all permutations."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values([group, "laser"])
        n = int(pdf["n"].iat[0])
        values, labels = pdf["g_norm"].to_numpy(), pd.factorize(pdf[group])[0]
        rng = np.random.default_rng(seed + n)
        seen = median_gaps(values, labels[None, :])[0]
        more = int((median_gaps(values, np.stack([rng.permutation(labels) for _ in range(n_perm)])) >= seen - 1e-12).sum())
        med = pdf.groupby(group)["g_norm"].median().sort_values(ascending=False, kind="stable")
        return pd.DataFrame({"n": [n], "top": [med.index[0]], "second": [med.index[1] if len(med) > 1 else None], "bottom": [med.index[-1]], "t": [seen], "p": [(1 + more) / (1 + n_perm)]})

    return rows.groupBy("n").applyInPandas(test, "n int, top string, second string, bottom string, t double, p double")


def summarize(tests: DataFrame, keys=("top",), most_q: float = 0.05) -> DataFrame:
    """I5 with A17: wins, sum, mean and largest step of the tests with q up to most_q, by winning group or other keys."""
    return tests.where(F.col("q") <= most_q).groupBy(*keys).agg(F.count("*").alias("wins"), F.sum("t").alias("sum_t"), F.avg("t").alias("mean_t"), F.max("t").alias("max_t"))


def top_share(tests: DataFrame, k: int = 5) -> DataFrame:
    """O3: the k largest steps and their share of the total."""
    total = tests.agg(F.sum("t")).scalar()
    return tests.withColumn("share", F.coalesce(F.try_divide(F.col("t"), total), F.lit(0.0))).orderBy(F.desc("t"), "n").limit(k)


def transition_labels(events: DataFrame, keys=("fecha", "lab"), number: str = "m") -> DataFrame:
    """W5 with J14: pairs of consecutive measurements whose numbers differ by one, with both times."""
    w = Window.partitionBy(*keys).orderBy(number)
    rows = events.withColumns({"to": F.lead(number).over(w), "t_to": F.lead("t_first").over(w)})
    return rows.where(F.col("to") == F.col(number) + 1)
