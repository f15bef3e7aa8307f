"""Bins specs: contracts in JSON files, of both layouts, as one table of edges.

Files of the current layout (``schema_version`` 2.0) list channels with their edges; older ones list bins with nested edges. They are read as
VARIANT, so a field of the wrong kind spoils its own channel only. What is wrong with a spec is a column; ``checked`` raises on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectral import edge_problem

VERSION = "2.0"
EDGES = ("amplitude", "increment", "coupling", "spectral")
# Where both layouts keep edges and whether values out of range are clipped.
CURRENT = {"amplitude": "$.amplitude_edges", "increment": "$.increment_edges", "coupling": "$.coupling_edges"}
OLDER = {"amplitude": "$.amplitude.edges", "increment": "$.increments.edges", "coupling": "$.coupling_categories.edges"}
CLIP = {"amplitude": "$.amplitude.clip_out_of_range", "increment": "$.increments.clip_out_of_range", "coupling": "$.coupling_categories.clip_out_of_range"}


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _is_set(node: Column) -> Column:
    return node.isNotNull() & ~F.is_variant_null(node)


def _flag(node: Column) -> Column:
    """A clip flag: true where it is absent, false where it is null."""
    return F.when(F.is_variant_null(node), False).otherwise(F.coalesce(F.try_variant_get(node, "$", "boolean"), F.lit(True)))


def _name(item: Column) -> Column:
    return F.nullif(F.trim(F.try_variant_get(item, "$.laser", "string")), F.lit(""))


def parsed(specs: DataFrame) -> DataFrame:
    """path, layout, channel, edges of four kinds, fs, unit, three clip flags and problem, a row a channel; of a name that stands twice the last counts.

    problem: not_json, no_channels (one row without a channel), or the field and what is wrong with it (too_few, not_finite, not_increasing,
    not_a_number), else null; entries that are no numbers are not finite. Coupling and spectral edges may be absent. A channel without spectral fields has those of the whole spec.
    """
    spec = specs.select("path", F.try_parse_json("text").alias("v"))
    at = lambda node, where, kind="variant": F.try_variant_get(node, where, kind)
    channels, older = at("v", "$.channels", "array<variant>"), at("v", "$.bins", "array<variant>")
    current = F.coalesce((at("v", "$.schema_version", "string") == VERSION) & channels.isNotNull(), F.lit(False))
    layout = F.when(current, "channels").otherwise("bins")
    rows = spec.select("path", "v", layout.alias("layout"), F.coalesce(older, F.array().cast("array<variant>")).alias("older"), F.posexplode_outer(F.when(current, channels).otherwise(older)).alias("pos", "item"))
    rows = rows.withColumn("channel", _name(F.col("item")))

    now, item, whole = F.col("layout") == "channels", F.col("item"), at("v", "$.spectral")
    nodes = {k: F.when(now, at(item, CURRENT[k])).otherwise(at(item, OLDER[k])) for k in CURRENT}
    # clip flags of the current layout stand in its list of older bins, if it has one
    same = F.try_element_at(F.filter("older", lambda b: _name(b) == F.col("channel")), F.lit(-1))
    flags = {f"{k}_clip": _flag(at(F.when(now, same).otherwise(item), w)) for k, w in CLIP.items()}
    own = at(item, "$.spectral")
    field = lambda f: F.when(now, F.coalesce(at(own, f"$.{f}"), at(whole, f"$.{f}"))).when(_is_set(own), at(own, f"$.{f}")).otherwise(at(whole, f"$.{f}"))
    nodes["spectral"] = field("freq_edges")
    rate = F.when(now, field("fs")).otherwise(F.coalesce(field("fs"), field("fs_hz")))
    rows = rows.select("path", "v", "layout", "pos", "channel", rate.alias("rate"), at(field("freq_unit"), "$", "string").alias("unit"), *[n.alias(f"n_{k}") for k, n in nodes.items()], *[c.alias(k) for k, c in flags.items()])
    rows = rows.withColumns({**{k: at(f"n_{k}", "$", "array<double>") for k in EDGES}, "fs": at("rate", "$", "double")})

    wrong = [F.when(F.lit(k in ("amplitude", "increment")) | _is_set(F.col(f"n_{k}")), F.concat(F.lit(f"{k}: "), edge_problem(F.col(k)))) for k in EDGES]
    problem = F.coalesce(F.when(F.col("v").isNull(), "not_json"), F.when(F.col("channel").isNull(), "no_channels"), *wrong, F.when(_is_set(F.col("rate")) & F.col("fs").isNull(), "fs: not_a_number"))
    columns = ["layout", *EDGES, "fs", "unit", *flags, "problem"]
    rows = rows.withColumn("problem", problem)
    last = rows.groupBy("path", "channel").agg(F.max_by(F.struct(*columns), F.coalesce("pos", F.lit(-1))).alias("c"))
    known = last.groupBy("path").agg(F.count("channel").alias("__n"))  # entries without a name go where others have one
    return last.join(known, "path").where(F.col("channel").isNotNull() | (F.col("__n") == 0)).select("path", F.col("c.layout").alias("layout"), "channel", *[f"c.{c}" for c in columns[1:]])


def checked(parts: DataFrame) -> DataFrame:
    """Specs without their problem column; a problem raises when its row is read."""
    told = F.concat_ws(" ", F.lit("bins spec"), "path", "channel", "problem")
    return parts.where(F.when(F.col("problem").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True)).drop("problem")


def edges_of(parts: DataFrame, kind: str) -> DataFrame:
    """channel and edges of one kind, as the PMFs take them; channels without it are left out."""
    return parts.where(F.col(kind).isNotNull()).select("channel", F.col(kind).alias("edges"))


def to_text(contract: DataFrame) -> DataFrame:
    """A row with the contract (channel, amplitude, increment, coupling) as JSON of the current layout, channels in order of name."""
    entry = F.struct(F.col("channel").alias("laser"), F.col("amplitude").alias("amplitude_edges"), F.col("increment").alias("increment_edges"), F.col("coupling").alias("coupling_edges"))
    channels = contract.agg(F.array_sort(F.collect_list(entry)).alias("channels"))  # a row a channel, hence small
    return channels.select(F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "channels")).alias("text"))
