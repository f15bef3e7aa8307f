"""Queries of runs with statuses, bins specs and windowed spectra, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import ALL_EDGES, CONTRACT, MET, POLICY, metrics, query, spec
from .operators import contract, runners, states
from .plans import views
from .sources import specs


@query("bins_spec", f"WITH {CONTRACT} SELECT channel, kind, CAST(i - 1 AS INTEGER) AS i, round(edges[i], 6) + 0.0 AS edge FROM {ALL_EDGES}, range(1, 300) t(i) WHERE i <= len(edges)")
def _(spark, d):
    text = specs.to_text(spec(spark, d)).select(F.lit("contract").alias("path"), "text")
    return contract.long_edges(specs.checked(specs.parsed(text)))


@query(
    "bins_spec_problems",
    """WITH K AS (SELECT s_suppkey AS k, s_suppkey % 8 AS c FROM supplier)
SELECT k AS spec, CASE WHEN c IN (1, 3, 5) THEN 'bins' ELSE 'channels' END AS layout, CASE WHEN c NOT IN (4, 5) THEN 'A' || k END AS channel, CAST(CASE WHEN c = 3 THEN 1 WHEN c NOT IN (4, 5) THEN 3 END AS INTEGER) AS n_edges,
   CASE WHEN c NOT IN (4, 5) THEN k + 0.0::DOUBLE END AS low, CASE WHEN c = 3 THEN k + 0.0::DOUBLE WHEN c NOT IN (4, 5) THEN k + 2.5::DOUBLE END AS high, CASE WHEN c IN (0, 2, 6) THEN k + 0.5::DOUBLE END AS fs, c <> 1 AS amplitude_clip,
   CASE c WHEN 2 THEN 'increment: not_increasing' WHEN 3 THEN 'amplitude: too_few' WHEN 4 THEN 'no_channels' WHEN 5 THEN 'not_json' WHEN 6 THEN 'coupling: not_finite' WHEN 7 THEN 'fs: not_a_number' END AS problem FROM K""",
)
def _(spark, d):
    k, c = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 8
    edges = F.format_string("[%s, %s, %s.5]", k, (F.col("s_suppkey") + 1).cast("string"), (F.col("s_suppkey") + 2).cast("string"))
    steps, coupling = F.when(c == 2, "[1, 0]").otherwise("[-1, 1]"), F.when(c == 6, "[0, null, 1]").otherwise("null")
    rate = F.when(c == 7, '"x"').otherwise(F.concat(k, F.lit(".5")))
    now = F.format_string('{"schema_version": "2.0", "spectral": {"fs": %s}, "channels": [{"laser": "A%s", "amplitude_edges": %s, "increment_edges": %s, "coupling_edges": %s}]}', rate, k, edges, steps, coupling)
    then = F.format_string('{"bins": [{"laser": "A%s", "amplitude": {"edges": %s, "clip_out_of_range": %s}, "increments": {"edges": [-1, 1]}}]}', k, F.when(c == 3, F.concat(F.lit("["), k, F.lit("]"))).otherwise(edges), F.when(c == 1, "false").otherwise("true"))
    text = F.when(c.isin(1, 3), then).when(c == 4, '{"schema_version": "2.0", "channels": []}').when(c == 5, "{").otherwise(now)
    rows = specs.parsed(views.table(spark, d, "supplier").select(k.alias("path"), text.alias("text")))
    return rows.select(F.col("path").cast("long").alias("spec"), "layout", "channel", F.array_size("amplitude").alias("n_edges"), F.get("amplitude", F.lit(0)).alias("low"), F.try_element_at("amplitude", F.lit(-1)).alias("high"), "fs", "amplitude_clip", "problem")


@query(
    "spectral_hann_blocks",
    """WITH V AS (SELECT vec_id AS mid, CAST(label AS INTEGER) AS channel, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
B AS (SELECT mid, channel, b, v[CAST(round(b * 32 / 7.0) AS INTEGER) + 1 : CAST(round(b * 32 / 7.0) AS INTEGER) + 32] AS x FROM V, range(8) r(b)),
X AS (SELECT mid, channel, b, t - 1 AS t, (x[t] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * (t - 1) / 31)) AS x FROM B, range(1, 33) r(t)),
P AS (SELECT mid, channel, b, CAST(f AS INTEGER) AS f, (pow(sum(x * cos(2 * pi() * f * t / 32)), 2) + pow(sum(x * sin(2 * pi() * f * t / 32)), 2)) / 32 AS e FROM X, range(17) r(f) GROUP BY ALL)
SELECT mid, channel, f, round(avg(e), 6) + 0.0 AS e FROM P GROUP BY ALL""",
)
def _(spark, d):
    own = states.psd(views.vectors(spark, d), 32, blocks=8, window="hann")
    return own.select("mid", "channel", F.posexplode("power").alias("f", "e"))


@query(
    "table_run",
    """WITH H AS (SELECT DISTINCT l_orderkey AS mid FROM lineitem WHERE l_quantity > 45), P AS (SELECT l_orderkey AS mid, min('line ' || l_linenumber) AS error FROM lineitem WHERE l_discount >= 0.09 GROUP BY ALL), C AS (SELECT c_custkey FROM customer WHERE c_nationkey < 20)
SELECT o_orderkey AS mid, 'r' || o_custkey AS raw_path, P.error, CASE WHEN H.mid IS NOT NULL THEN 'skipped_exists' WHEN c_custkey IS NULL THEN 'skipped_missing_raw' WHEN P.error IS NOT NULL THEN 'error' ELSE 'ok' END AS status
FROM orders LEFT JOIN H ON H.mid = o_orderkey LEFT JOIN P ON P.mid = o_orderkey LEFT JOIN C ON c_custkey = o_custkey""",
)
def _(spark, d):
    item = views.table(spark, d, "lineitem")
    plan = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("mid"), F.concat(F.lit("r"), "o_custkey").alias("raw_path"))
    wrong = item.where("l_discount >= 0.09").select(F.col("l_orderkey").alias("mid"), F.concat(F.lit("line "), "l_linenumber").alias("error"))
    raw = views.table(spark, d, "customer").where("c_nationkey < 20").select(F.concat(F.lit("r"), "c_custkey").alias("raw_path"))
    return runners.table_run(plan, item.where("l_quantity > 45").select(F.col("l_orderkey").alias("mid")), raw, wrong)


@query(
    "quality_run",
    f"""WITH {MET}, U AS (SELECT mid, count(*) FILTER (status = 'ok' AND pct_out <= 0.1) AS n_used, coalesce(avg(score) FILTER (status = 'ok' AND pct_out <= 0.1), 0) AS score FROM MET GROUP BY mid),
Q AS (SELECT s_suppkey AS mid, CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 23 = 0 THEN 'schema_not_ok' WHEN s_suppkey % 13 = 0 THEN 'parquet_missing' WHEN s_suppkey % 17 = 0 THEN 'parquet_read_error' WHEN s_suppkey % 19 = 0 THEN 'no_channel_columns' END AS reason,
   coalesce(n_used, 0) AS n_used, coalesce(score, 0) AS score FROM supplier LEFT JOIN U ON U.mid = s_suppkey)
SELECT mid, reason, CASE WHEN reason IS NULL THEN 'OK' ELSE 'FAIL' END AS status, CASE WHEN reason IS NULL THEN CAST(4 AS BIGINT) END AS n_channels, CASE WHEN reason IS NULL THEN n_used END AS n_used, CASE WHEN reason IS NULL THEN 4 - n_used END AS n_invalid,
   CASE WHEN reason IS NULL THEN round(score, 6) + 0.0 END AS score, CASE WHEN reason IS NULL THEN n_used >= 4 AND score >= 4.0 END AS passed FROM Q""",
)
def _(spark, d):
    k = F.col("s_suppkey")
    s = views.table(spark, d, "supplier")
    path = F.concat(F.lit("t"), k).alias("parquet_path")
    files = s.where(k % 13 != 0).select(path, (k % 17 != 0).alias("readable"), F.when(k % 19 == 0, 0).otherwise(4).alias("n_channels"))
    schema = s.where(k % 23 != 0).select(k.alias("mid"), F.when(k % 11 != 0, "ok").otherwise("no").alias("schema_ok"))
    return runners.quality_run(s.select(k.alias("mid"), path), files, metrics(spark, d), schema, POLICY).drop("parquet_path")


@query(
    "preflight_report",
    """WITH P AS (SELECT DISTINCT 'r' || o_custkey AS p FROM orders), M AS (SELECT p FROM P WHERE p NOT IN (SELECT 'r' || c_custkey FROM customer WHERE c_nationkey <> 3))
SELECT true AS ok, '' AS errors, (SELECT count(*) FROM M) || ' of ' || (SELECT count(*) FROM P) || ' paths are missing: ' || (SELECT string_agg(p, ', ' ORDER BY p) FROM (SELECT p FROM M ORDER BY p LIMIT 3)) AS warnings,
   count(*) AS n, count(DISTINCT o_orderdate) AS n_dates, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS labs, (SELECT count(*) FROM P) AS n_paths, (SELECT count(*) FROM M) AS n_missing FROM orders""",
)
def _(spark, d):
    queue = views.table(spark, d, "orders").select(F.col("o_orderdate").alias("fecha"), F.concat(F.lit(" "), "o_orderpriority").alias("lab"), F.concat(F.lit("r"), "o_custkey").alias("parquet_path"))
    listing = views.table(spark, d, "customer").where("c_nationkey <> 3").select(F.concat(F.lit("r"), "c_custkey").alias("parquet_path"))
    joined = {c: F.array_join(c, "|") for c in ("errors", "warnings", "labs")}
    return runners.preflight_report(queue, listing).withColumns(joined)


@query("reference_rows", "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS fecha, 'r' || o_custkey AS parquet_path FROM orders WHERE o_custkey % 4 <> 0 AND year(o_orderdate) IN (1995, 1997)")
def _(spark, d):
    path = F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("r"), "o_custkey"))
    queue = views.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" "), F.year("o_orderdate").cast("string")).alias("fecha"), path.alias("parquet_path"))
    return runners.reference_rows(queue, "all", ["1995", " 1997"])
