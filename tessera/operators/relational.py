"""Projections, filters, joins, aggregates and set operations between the levels (P1-P4, P7, P10-P12, J1, J4, J5, J7, J8, A1, A14, A22-A24, O1, O5, O8, O9, U1, U5-U7, H3, H4, H7, H10, H13-H18, H20, D10-D12).

All functions take and return DataFrames or columns; only schemas and single counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Names by which queues and results call their columns.
QUEUE_ALIASES = {"laboratorio": "lab", "measurement_id": "mid", "path": "parquet_path"}
RESULT_ALIASES = {"columna": "laser_name", "calidad_general": "score_canal"}
# Prefixes of channel columns, spellings of the movement feature, column names that hold time in order of preference.
CHANNEL_PREFIXES = ("Ch", "Luz", "Laser", "Canal")
FEATURES = {"amplitude": ["amplitude"], "movement": ["movement", "increments", "increment", "inc", "mov"]}
TIME_COLUMNS = ("t_rel", "t_sys", "Time", "Tiempo", "time", "time_rel", "time_sys")


def by_position(rows: DataFrame, picks: Mapping[int, str]) -> DataFrame:
    """Columns by position under new names; a position out of range or a name twice raises."""
    if len(set(picks.values())) < len(picks) or not all(0 <= i < len(rows.columns) for i in picks):
        raise ValueError("positions must exist and names must differ")
    return rows.select(*[F.col(f"`{rows.columns[i]}`").alias(n) for i, n in picks.items()])


def channel_columns(rows: DataFrame, wanted: Sequence[str] | None = None, prefixes: Sequence[str] = CHANNEL_PREFIXES) -> list[str]:
    """P2 with U7: the wanted columns that are there, in their order, or those with a channel prefix."""
    return [c for c in wanted if c in rows.columns] if wanted else [c for c in rows.columns if c.startswith(tuple(prefixes))]


def renamed(rows: DataFrame, aliases: Mapping[str, str] = QUEUE_ALIASES) -> DataFrame:
    """Columns under their usual names, where these are free."""
    return rows.withColumnsRenamed({k: v for k, v in aliases.items() if k in rows.columns and v not in rows.columns})


def with_mid(queue: DataFrame) -> DataFrame:
    """Mid from archivo, else from a hash of the path, where there is none. A queue without parquet_path raises."""
    if "parquet_path" not in queue.columns:
        raise ValueError("a queue needs parquet_path")
    if "mid" in queue.columns:
        return queue
    return queue.withColumn("mid", F.col("archivo").cast("string") if "archivo" in queue.columns else F.left(F.sha2("parquet_path", 256), F.lit(16)))


def reordered(rows: DataFrame, first: Sequence[str]) -> DataFrame:
    """Preferred columns in front, the others behind in place."""
    front = [c for c in first if c in rows.columns]
    return rows.select(*front, *[c for c in rows.columns if c not in front])


def valid_rows(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows that are valid, have status ok or valid and all metrics; infinity stays."""
    return reduce(lambda r, m: r.where(F.col(m).isNotNull()), metrics, rows.where(S.is_true(F.col("valido")) & F.lower(F.trim("status")).isin("ok", "valid")))


def of_feature(pmf: DataFrame, feature: str) -> DataFrame:
    """P10: rows of a feature under any of its spellings."""
    return pmf.where(F.lower(F.trim("feature")).isin(FEATURES.get(feature, [feature])))


def light_channels(roles: DataFrame) -> DataFrame:
    """Channels whose canonical name has, in any measurement, a raw name that starts with luz or speaks of laser or light; if there is none at all, Ch1 to Ch6."""
    light = roles.where(F.lower(F.trim("raw_name")).rlike("^luz|laser|light")).select("canonical_name").distinct()
    some = light.agg(F.count("*")).scalar() > 0
    marked = roles.join(light.withColumn("__l", F.lit(True)), "canonical_name", "left")
    keep = F.when(some, F.col("__l").isNotNull()).otherwise(F.col("canonical_name").rlike("^Ch[1-6]$"))
    return marked.where(keep).select(*roles.columns)



def first_known(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """The first value of each column that is not null, in order."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def with_pivot(meta: DataFrame, entropies: DataFrame, lasers: Sequence[str], value: str = "h") -> DataFrame:
    """J1 with H14: meta with a column for each laser, null where it has none."""
    wide = entropies.groupBy("mid").pivot("channel", list(lasers)).agg(F.first(value))
    return meta.join(wide, "mid", "left")


def attached(rows: DataFrame, other: DataFrame, keys: Sequence[str], order: str, fill: bool = True) -> DataFrame:
    """The other's new columns by one key after the other; within a key the first row in order counts.

    fill: a later key also fills rows that an earlier one has missed; else it only brings columns that are absent still, which after a
    first key that both have are none.
    """
    new = [c for c in other.columns if c not in rows.columns and c not in keys]
    out, used = rows, [k for k in keys if k in rows.columns and k in other.columns]
    used = used if fill else used[:1]
    for i, key in enumerate(used):
        own = other.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(F.struct(*new), order).alias(f"__k{i}")])
        out = out.join(own, key, "left")
    found = F.coalesce(*[F.col(f"__k{i}") for i in range(len(used))])
    return out.withColumn("__k", found).select(*rows.columns, *[F.col("__k")[c].alias(c) for c in new])


def schema_gate(rows: DataFrame, schema: DataFrame | None) -> DataFrame:
    """Rows whose measurement has a sound schema; a table without mid does not gate."""
    if schema is None or "mid" not in schema.columns:
        return rows
    return rows.join(schema.where(S.is_true(F.col("schema_ok"))).select("mid").distinct(), "mid", "left_semi")


def count_by(rows: DataFrame, keys: Sequence[str] = ("fecha", "lab")) -> DataFrame:
    """A1."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def row_mean(rows: DataFrame, suffix: str, name: str) -> DataFrame:
    """Mean over the columns with a suffix, nulls and NaN left out."""
    values = F.filter(F.array(*[S.finite(F.col(f"`{c}`")) for c in rows.columns if c.endswith(suffix)]), lambda x: x.isNotNull())
    return rows.withColumn(name, F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)))


def sum_check(rows: DataFrame, keys: Sequence[str], value: str, total: float = 100.0, slack: float = 1e-6) -> DataFrame:
    """Sums by group and whether they reach the total."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("total")).withColumn("fits", F.abs(F.col("total") - total) <= slack)


def preflight(catalog: DataFrame) -> DataFrame:
    """One row of counts over the whole catalog: rows, dates, labs, measurements, numbers that are none, files that are missing."""
    bad = F.count_if(F.col("archivo").cast("string").try_cast("int").isNull())
    missing = F.count_if(~F.coalesce("raw_exists", F.lit(False)))
    return catalog.agg(F.count("*").alias("n"), F.countDistinct("fecha").alias("n_dates"), F.countDistinct("lab").alias("n_labs"), F.countDistinct("mid").alias("n_mids"), bad.alias("n_bad_numbers"), missing.alias("n_missing"))



def sorted_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order by those keys that exist."""
    have = [k for k in keys if k in rows.columns]
    return rows.orderBy(*have) if have else rows


def extremes(rows: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """The item with the largest and the one with the smallest value of each group, ties to the smaller item."""
    have = rows.where(F.col(value).isNotNull())
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(value, item))
    ranked = have.withColumns({"__b": best, "__w": last})
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("__b") == 1, F.col(item))).alias("best"), F.max(F.when(F.col("__w") == 1, F.col(item))).alias("worst"), F.max(value).alias("high"), F.min(value).alias("low"))


def natural(name: Column) -> Column:
    """A sort key by the number in a name; names without one stand last."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1 << 30))


def _digest(order: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", *order, F.lit(str(seed))).cast("binary"))


def sampled(rows: DataFrame, most: int, keys: Sequence[str], order: Sequence[str], seed: int = 0) -> DataFrame:
    """A seeded sample without replacement, the rows of each group with the least digests of order and seed, at most so many.

    For few groups of any size (channels). Counts by the first 16 bits of the digest (65,536 at most a group, summed before the shuffle) tell up to
    which of these rows are needed, so that only they are shuffled and ranked, not the group. A group's limit, a row, goes to the tasks by broadcast:
    a join by group would bring each group to one task.
    """
    own = rows.withColumn("__d", _digest(order, seed)).withColumn("__b", F.substring("__d", 1, 4))
    totals = own.groupBy(*keys, "__b").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.partitionBy(*keys).orderBy("__b")))
    last = totals.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("upto") >= most, F.col("__b"))), F.lit("ffff")).alias("__last"))
    own = own.join(F.broadcast(last), list(keys)).where("__b <= __last")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__d", *order))
    return own.withColumn("__r", rank).where(F.col("__r") <= most).select(*rows.columns)


def capped_sample(rows: DataFrame, per_file: int, in_all: int, file: Sequence[str], group: Sequence[str], order: Sequence[str], seed: int = 0) -> DataFrame:
    """A sample with a cap for each file and one for each group of files. Files are many and small: a file's rows are ranked where a task has them, without a shuffle if they are dealt by file."""
    rank = F.row_number().over(Window.partitionBy(*file).orderBy(_digest(order, seed), *order))
    own = rows.withColumn("__r", rank).where(F.col("__r") <= per_file).select(*rows.columns)
    return sampled(own, in_all, group, order, seed)


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pass_fail(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U6."""
    ok = F.coalesce("passed", F.lit(False))
    return gated.where(ok), gated.where(~ok)


def known_labels(labels: Column, unknown: str = "UNK") -> Column:
    """A group's labels without the unknown one, sorted."""
    return F.array_sort(F.array_except(F.collect_set(labels), F.array(F.lit(unknown))))


def to_manifest(plan: DataFrame) -> DataFrame:
    """H3."""
    return plan.select(F.col("date").alias("fecha"), F.col("group").alias("jornada"), "lab", F.lit(None).cast("string").alias("turno"), F.coalesce("color", F.lit("UNK")).alias("color"), F.col("label").alias("etiqueta"), "archivo")


def expected_schema(roles: DataFrame) -> DataFrame:
    """H4: the columns that a measurement should have: times, then channels in order."""
    place = F.when(F.col("role") == "t_sys", 0).when(F.col("role") == "t_rel", 1).otherwise(2)
    rows = roles.where("role is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "i", "role"))).alias("s"))
    channels = F.transform(F.filter("s", lambda x: x["p"] == 2), lambda x, k: F.concat(F.lit("Laser_"), (k + 1).cast("string")))
    return rows.select("path", F.concat(F.transform(F.filter("s", lambda x: x["p"] < 2), lambda x: x["role"]), channels).alias("columns"))


def laser_names(results: DataFrame) -> DataFrame:
    """Distinct names of lasers; blanks and nan, none, null are none."""
    column = next((c for c in ("laser", "laser_name") if c in results.columns), None)
    if column is None:
        raise ValueError("needs laser or laser_name")
    name = F.trim(F.col(column).cast("string"))
    return results.select(name.alias("laser")).where(F.col("laser").isNotNull() & ~F.lower("laser").isin("", "nan", "none", "null")).distinct()


def time_column(names: Sequence[str]) -> str | None:
    """H19."""
    return next((c for c in TIME_COLUMNS if c in names), None)


def table_paths(queue: DataFrame, listing: DataFrame) -> DataFrame:
    """The file of each measurement: its id's name, else index of two or three digits; status parquet_missing without one."""
    two, three = (F.format_string(f"%0{w}d.parquet", "archivo") for w in (2, 3))
    wanted = queue.select("*", F.posexplode(F.array(F.concat("mid", F.lit(".parquet")), two, three)).alias("__s", "name"))
    found = wanted.join(listing.select("name", "path").dropDuplicates(["name"]), "name", "left")
    own = found.groupBy(*queue.columns).agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("__s"))).alias("parquet_path"))
    return own.withColumn("status", F.when(F.col("parquet_path").isNull(), "parquet_missing").otherwise("ok"))


def failed(rows: DataFrame, why: Column, metrics: Sequence[str]) -> DataFrame:
    """Rows with a reason have status FAIL and no metrics."""
    return rows.withColumns({"reason": why, **{m: F.when(why.isNull(), F.col(m)) for m in metrics}, "status": F.when(why.isNull(), "OK").otherwise("FAIL")})


def skip_reason(known: Column, schema_ok: Column, n_channels: Column, readable: Column) -> Column:
    """Why the quality level skips a measurement, null if it does not."""
    return F.when(~schema_ok, "schema_not_ok").when(~known, "parquet_missing").when(~readable, "parquet_read_error").when(n_channels == 0, "no_channel_columns")


def action_status(exists: Column, raw: Column, error: Column, overwrite: bool = False) -> Column:
    """What a table build does with a measurement."""
    return F.when(exists & F.lit(not overwrite), "skipped_exists").when(~raw, "skipped_missing_raw").when(error.isNotNull(), "error").otherwise("ok")


def month_root(day: Column) -> Column:
    """Month and year of a date as a folder name."""
    return F.date_format(day, "MMMyy")


def listed_names(files: DataFrame, most: int = 3) -> DataFrame:
    """Files of each block with the first few names."""
    first = F.row_number().over(Window.partitionBy("date", "lab").orderBy("name"))
    names = files.where("name is not null").select("date", "lab", "name").distinct().withColumn("__r", first).where(F.col("__r") <= most)
    names = names.groupBy(F.col("date").alias("__d"), F.col("lab").alias("__l")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    n = files.groupBy("date", "lab").agg(F.count("*").alias("n"))
    return n.join(names, F.col("date").eqNullSafe(F.col("__d")) & F.col("lab").eqNullSafe(F.col("__l")), "left").select("date", "lab", "n", F.coalesce("names", F.lit("")).alias("names"))
