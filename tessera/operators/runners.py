"""Runs over a queue with a status for each measurement instead of a raise.

A run is one plan: what is missing shows as a status or reason in its row. ``watched`` counts statuses in the same pass, for a log of the run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import QualityPolicy
from ..functions import scalars as S
from . import relational


class RunError(ValueError):
    pass


def reference_rows(queue: DataFrame, group: str = "ALL", dates: Sequence[str] | None = None) -> DataFrame:
    """Rows of the queue that bins rest on: those with a path, of the given dates if any. A group other than ALL, UNK or blank raises."""
    if group.strip().upper() not in ("ALL", "UNK", ""):
        raise RunError(f"no reference group {group!r}: use ALL, or give dates")
    rows = queue.withColumn("fecha", F.trim(F.col("fecha").cast("string"))).where("parquet_path is not null")
    return rows if dates is None else rows.where(F.col("fecha").isin([str(d).strip() for d in dates]))


def table_run(plan: DataFrame, existing: DataFrame, raw: DataFrame, problems: DataFrame, overwrite: bool = False) -> DataFrame:
    """Plan (mid, raw_path) with error and status skipped_exists, skipped_missing_raw, error or ok.

    existing: mids that have a table; raw: paths that exist; problems: mid and error of those whose roles or bounds fail. Repeated rows of these
    count once, of errors the first in order. Only rows with ok are to be built.
    """
    have = existing.select("mid").distinct().withColumn("__have", F.lit(True))
    found = raw.select("raw_path").distinct().withColumn("__raw", F.lit(True))
    wrong = problems.groupBy("mid").agg(F.min("error").alias("error"))
    rows = plan.join(have, "mid", "left").join(found, "raw_path", "left").join(wrong, "mid", "left")
    status = relational.action_status(F.coalesce("__have", F.lit(False)), F.coalesce("__raw", F.lit(False)), F.col("error"), overwrite)
    return rows.select(*plan.columns, "error", status.alias("status"))


def quality_run(queue: DataFrame, files: DataFrame, metrics: DataFrame, schema: DataFrame | None = None, p: QualityPolicy = QualityPolicy()) -> DataFrame:
    """D9 with J8, H7 and H17: each row of the queue (mid, parquet_path) with n_channels, n_used, n_invalid, score, passed, reason and status.

    files: parquet_path, readable and n_channels of the tables that exist; metrics: channel metrics (mid, channel, score, status, pct_out);
    schema: mid and schema_ok, where a measurement that is absent is not sound; without it, or where it is empty, there is no gate. Reasons are
    schema_not_ok, parquet_missing, parquet_read_error and no_channel_columns, the first that holds; such rows have status FAIL and no
    metrics. A measurement without a usable channel has score 0. A null mid or path is parquet_missing.
    """
    used = (F.col("status") == "ok") & (F.col("pct_out") <= p.max_pct_out)
    own = metrics.groupBy("mid").agg(F.count_if(used).alias("n_used"), F.coalesce(F.avg(F.when(used, F.col("score"))), F.lit(0.0)).alias("score"))
    found = files.groupBy("parquet_path").agg(F.bool_and("readable").alias("__readable"), F.max("n_channels").alias("n_channels"))
    rows = queue.join(found, "parquet_path", "left").join(own, "mid", "left")
    sound = F.lit(True)
    if schema is not None:
        known = schema.groupBy("mid").agg(F.bool_or(S.is_true(F.col("schema_ok"))).alias("__sound"))
        some = known.agg(F.count("*")).scalar() > 0
        rows = rows.join(known, "mid", "left").withColumn("__gated", some)
        sound = ~F.col("__gated") | F.coalesce("__sound", F.lit(False))
    why = relational.skip_reason(F.col("mid").isNotNull() & F.col("__readable").isNotNull(), sound, F.coalesce("n_channels", F.lit(0)), F.coalesce("__readable", F.lit(False)))
    n_used, score = F.coalesce("n_used", F.lit(0)), F.coalesce("score", F.lit(0.0))
    rows = rows.withColumns({"n_used": n_used, "score": score, "n_channels": F.col("n_channels").cast("long")})
    rows = rows.withColumns({"n_invalid": F.col("n_channels") - F.col("n_used"), "passed": (F.col("n_used") >= p.min_channels) & (F.col("score") >= p.threshold_pass)})
    own = ["n_channels", "n_used", "n_invalid", "score", "passed"]
    return relational.failed(rows.select(*queue.columns, *own, why.alias("__why")), F.col("__why"), own).drop("__why")


def watched(rows: DataFrame, statuses: Sequence[str], column: str = "status") -> tuple[DataFrame, Observation]:
    """Rows and an observation that, once they have been written, holds n and the rows of each status; no job of its own runs."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) == s).alias(s) for s in statuses]), seen


def preflight_report(queue: DataFrame, listing: DataFrame, required: Sequence[str] = ("fecha", "lab", "parquet_path"), alpha: float = 0.05, examples: int = 3) -> DataFrame:
    """One row: ok, errors, warnings, n, n_dates, labs (sorted, blanks left out), n_paths, n_missing.

    Errors are columns that the queue lacks and an alpha outside (0, 1), warnings an empty queue and paths that listing (parquet_path) lacks,
    with the first few. All paths are looked up, not a sample of them. What the queue lacks counts as null.
    """
    have = queue.select(*[F.col(c).cast("string") if c in queue.columns else F.lit(None).cast("string").alias(c) for c in ("fecha", "lab", "parquet_path")])
    stats = have.agg(F.count("*").alias("n"), F.countDistinct("fecha").alias("n_dates"), F.array_sort(F.collect_set(F.nullif(F.trim("lab"), F.lit("")))).alias("labs"))
    paths = have.where("parquet_path is not null").select("parquet_path").distinct()
    missing = paths.join(listing.select(F.col("parquet_path").cast("string")).distinct(), "parquet_path", "left_anti")
    first = missing.orderBy("parquet_path").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("parquet_path")), ", ").alias("__some"))
    row = stats.select("*", paths.agg(F.count("*")).scalar().alias("n_paths"), missing.agg(F.count("*")).scalar().alias("n_missing"), first.scalar().alias("__some"))
    errors = [f"missing column {c}" for c in required if c not in queue.columns] + ([] if 0 < alpha < 1 else ["alpha must be in (0, 1)"])
    told = F.when(F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(" of "), F.col("n_paths").cast("string"), F.lit(" paths are missing: "), "__some"))
    warnings = F.array_compact(F.array(F.when(F.col("n") == 0, "the queue is empty"), told))
    return row.select(F.lit(not errors).alias("ok"), F.array(*map(F.lit, errors)).cast("array<string>").alias("errors"), warnings.alias("warnings"), *stats.columns, "n_paths", "n_missing")


def ready(report: DataFrame) -> DataFrame:
    """D11, strict: the report, which raises when read if it has errors."""
    return report.where(F.when(~F.col("ok"), F.raise_error(F.array_join("errors", ", ")).cast("boolean")).otherwise(True))
