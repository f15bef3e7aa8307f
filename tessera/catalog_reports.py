"""Queries of profiles over several metrics, schema groups, transition labels, chart data and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import BASE, CORR, EV, MET, POLICY, STEPS, metrics, query, r6, results
from .operators import profiles, reports, runners, shaping
from .plans import views

METRICS = ["mean", "high"]
LASER = "CASE channel WHEN 'l_discount' THEN 1 WHEN 'l_extendedprice' THEN 2 WHEN 'l_quantity' THEN 3 ELSE 4 END"
#: v of both metrics in the measurements that have all lasers; sums of whole cents, so that both engines add them alike.
LONG = f"""{BASE},
LB AS (SELECT c.fecha, c.lab, c.mid, c.laser, m.metric, CASE m.metric WHEN 'mean' THEN c.v ELSE h.high END AS v FROM CAN c JOIN (SELECT fecha, lab, mid, {LASER} AS laser, max(value) AS high FROM SIG GROUP BY ALL) h USING (fecha, lab, mid, laser), (VALUES ('mean'), ('high')) m(metric)),
LP AS (SELECT metric, fecha, lab, laser, avg(v) AS v FROM LB GROUP BY ALL),
LN AS (SELECT fecha, lab, count(DISTINCT mid) AS k FROM LB GROUP BY ALL)"""


def long_base(spark, d):
    laser = F.when(F.col("channel") == "l_discount", 1).when(F.col("channel") == "l_extendedprice", 2).when(F.col("channel") == "l_quantity", 3).otherwise(4)
    rows = views.signal(spark, d).groupBy("fecha", "lab", "mid", laser.alias("laser")).agg(F.avg("value").alias("v"), F.max("value").alias("high"))
    kept = profiles.canonical_base(rows, 4)
    return kept.select("fecha", "lab", "mid", "laser", F.explode(F.create_map(F.lit("mean"), "v", F.lit("high"), "high")).alias("metric", "v"))


def _digits(v):
    """Ratios go up to millions; both engines round them off the half."""
    return f"{v} + 1e-5, 3" if "aniso" in v else f"{v} + 1e-9, 6"


def _cells(values):
    each = [f"round({_digits(f"max({v}) FILTER (metric = '{m}')")}) + 0.0 AS {m}__{v}" for m in METRICS for v in values]
    return ", ".join([*each, *[f"round({_digits(f'avg({v})')}) + 0.0 AS mean_{v}" for v in values]])


def _cut(df):
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.round(F.col(c) + 1e-5, 3) if "aniso" in c else F.round(F.col(c) + 1e-9, 6) for c in df.columns if kinds[c] == "double"})


@query(
    "metrics_summary",
    f"""WITH {LONG}, A AS (SELECT metric, fecha, lab, avg(v) AS profile_mean, stddev_samp(v) AS profile_std, max(v) / nullif(min(v), 0) AS anisotropy FROM LP GROUP BY ALL),
P AS (SELECT a.metric, a.fecha, a.lab, a.laser AS i, b.laser AS j, {CORR.format(x="a.v", y="b.v")} AS r FROM LB a JOIN LB b ON a.metric = b.metric AND a.fecha = b.fecha AND a.lab = b.lab AND a.mid = b.mid AND a.laser < b.laser GROUP BY ALL),
Q AS (SELECT metric, fecha, lab, avg(r) AS pair_corr FROM P GROUP BY ALL)
SELECT fecha, lab, {_cells(["profile_mean", "profile_std", "anisotropy", "pair_corr"])}, any_value(k) AS n_measurements FROM A JOIN Q USING (metric, fecha, lab) JOIN LN USING (fecha, lab) GROUP BY fecha, lab""",
)
def _(spark, d):
    return _cut(profiles.metrics_summary(long_base(spark, d), METRICS))


for _name, _vary, _fixed in (("pairwise_dates_metrics", "fecha", "lab"), ("pairwise_labs_metrics", "lab", "fecha")):
    query(
        _name,
        f"""WITH {LONG}, M AS (SELECT * FROM LP JOIN LN USING (fecha, lab) WHERE k >= 3),
B AS (SELECT x.metric, x.{_fixed}, x.{_vary} AS a, y.{_vary} AS b, x.k AS n_a, y.k AS n_b, {CORR.format(x="x.v", y="y.v")} AS corr, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS distance, max(x.v) / nullif(min(x.v), 0) AS anisotropy_a, max(y.v) / nullif(min(y.v), 0) AS anisotropy_b
   FROM M x JOIN M y ON x.metric = y.metric AND x.{_fixed} = y.{_fixed} AND x.laser = y.laser AND x.{_vary} < y.{_vary} GROUP BY ALL), D AS (SELECT *, anisotropy_b - anisotropy_a AS anisotropy_delta FROM B)
SELECT {_fixed}, a, b, n_a, n_b, {_cells(["corr", "distance", "anisotropy_a", "anisotropy_b", "anisotropy_delta"])} FROM D GROUP BY {_fixed}, a, b, n_a, n_b""",
    )(lambda spark, d, v=_vary: _cut(profiles.pairwise_metrics(long_base(spark, d), METRICS, v)))


@query(
    "schema_groups",
    """WITH Q AS (SELECT o_orderkey AS mid, CAST(year(o_orderdate) AS VARCHAR) AS fecha, o_orderpriority AS lab, CASE o_custkey % 5 WHEN 0 THEN 'UNK' WHEN 1 THEN 'LB' WHEN 2 THEN 'LA' END AS label, o_custkey % 3 AS c FROM orders),
F AS (SELECT *, CASE WHEN c = 0 AND mid % 50 = 0 THEN 't|b|a' WHEN mid % 70 = 0 THEN 't|a' ELSE 't|a|b' END AS cols FROM Q)
SELECT fecha, lab, count(*) AS n_files, count(*) FILTER (cols = 't|a|b') AS n_schema_ok, count(*) FILTER (cols <> 't|a|b') AS n_schema_fail, count(DISTINCT md5(cols)) AS n_schema_variants, count(DISTINCT md5(cols)) = 1 AS schema_consistent,
   count(DISTINCT label) FILTER (label <> 'UNK') > 1 AS mixed_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label <> 'UNK'), '') AS labels_present FROM F GROUP BY fecha, lab""",
)
def _(spark, d):
    o = views.table(spark, d, "orders")
    k = F.col("o_custkey") % 5
    label = F.when(k == 0, "UNK").when(k == 1, "LB").when(k == 2, "LA")
    cols = F.when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") % 50 == 0), F.array(*map(F.lit, "tba"))).when(F.col("o_orderkey") % 70 == 0, F.array(*map(F.lit, "ta"))).otherwise(F.array(*map(F.lit, "tab")))
    files = o.select(F.col("o_orderkey").alias("mid"), F.year("o_orderdate").cast("string").alias("fecha"), F.col("o_orderpriority").alias("lab"), label.alias("label"), cols.alias("columns"))
    return shaping.schema_groups(shaping.schema_checks(files, o.select(F.col("o_orderkey").alias("mid"), F.array(*map(F.lit, "tab")).alias("columns"))))


#: A measurement is an hour of a laboratory's events, numbered by the hour.
TIMES = f"""{EV}, H AS (SELECT lab, CAST(fecha AS VARCHAR) AS date, CAST(hour(ts) AS BIGINT) AS m_idx, lab || '_' || hour(ts) AS mid, strftime(min(ts), '%H:%M:%S') AS t_start, strftime(max(ts), '%H:%M:%S') AS t_end FROM EV GROUP BY lab, CAST(fecha AS VARCHAR), hour(ts)),
L AS (SELECT *, lead(m_idx) OVER w AS nxt, lead(mid) OVER w AS mid_to, lead(t_start) OVER w AS s2, lead(t_end) OVER w AS e2 FROM H WINDOW w AS (PARTITION BY lab, date ORDER BY m_idx)),
T AS (SELECT lab, date AS d, m_idx AS n, mid AS mid_from, mid_to, t_start AS t_start_transition, e2 AS t_end_transition, t_end AS t_from_end, s2 AS t_to_start, t_start AS label_start, t_start || ' → ' || e2 AS label_range, t_start || ' → ' || e2 || '  (' || mid || ' -> ' || mid_to || ')' AS label_full FROM L WHERE nxt = m_idx + 1)"""


def times(spark, d):
    e = views.event_signal(spark, d)
    clock = lambda c: F.date_format(c, "HH:mm:ss")
    rows = e.groupBy("lab", F.col("fecha").cast("string").alias("date"), F.hour("ts").cast("long").alias("m_idx")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return reports.transition_times(rows.select("lab", "date", "m_idx", F.concat_ws("_", "lab", F.col("m_idx").cast("string")).alias("mid"), clock("a").alias("t_start"), clock("b").alias("t_end")))


@query("transition_times", f"WITH {TIMES} SELECT * FROM T")
def _(spark, d):
    return times(spark, d)


@query(
    "labelled_report",
    f"""WITH {TIMES}, R AS (SELECT event_type AS lab, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CAST(hour(ts) AS BIGINT) AS n, count(*) AS k FROM events GROUP BY ALL)
SELECT lab, d, label_start AS n, k, R.n AS n_original, label_start AS transition, label_range AS transition_range FROM R LEFT JOIN T USING (lab, d, n)""",
)
def _(spark, d):
    e = views.table(spark, d, "events")
    report = e.groupBy(F.col("event_type").alias("lab"), F.to_date("ts").cast("string").alias("d"), F.hour("ts").cast("string").alias("n")).agg(F.count("*").alias("k"))
    return reports.labelled(report, times(spark, d))


@query(
    "labelled_by_slot",
    f"""WITH {TIMES}, S AS (SELECT n, lab, label_start, label_range FROM T WHERE d = (SELECT min(d) FROM T)), R AS (SELECT event_type AS lab, CAST(hour(ts) AS BIGINT) AS n, max(value) AS high FROM events GROUP BY ALL)
SELECT lab, n, round(high, 6) + 0.0 AS high, n AS n_original, label_start AS transition, label_range AS transition_range FROM R LEFT JOIN S USING (lab, n)""",
)
def _(spark, d):
    e = views.table(spark, d, "events")
    report = e.groupBy(F.col("event_type").alias("lab"), F.hour("ts").alias("n")).agg(F.max("value").alias("high"))
    return reports.labelled(report, reports.slots(times(spark, d), "1970-01-01"), ("lab", "n"), replace=False)


@query("bars", f"WITH {STEPS}, B AS (SELECT *, CAST('d' || (n % 3) AS VARCHAR) AS d FROM R) SELECT lab, laser, CAST(n AS BIGINT) AS n, d, round(quantile_cont(g_norm, 0.5), 6) + 0.0 AS height, CAST(n % 3 + 1 AS INTEGER) AS place FROM B GROUP BY ALL")
def _(spark, d):
    rows = results(spark, d).withColumn("d", F.concat(F.lit("d"), (F.col("n") % 3).cast("string")))
    return reports.bars(rows)


def run(spark, d):
    """The quality run of suppliers; some have no table."""
    k = F.col("s_suppkey")
    s = views.table(spark, d, "supplier")
    path = F.concat(F.lit("t"), k).alias("parquet_path")
    files = s.where(k % 13 != 0).select(path, (k % 17 != 0).alias("readable"), F.lit(4).alias("n_channels"))
    queue = s.select(k.alias("mid"), path, F.lit("2026").alias("fecha"), F.col("s_nationkey").cast("string").alias("lab"))
    return runners.quality_run(queue, files, metrics(spark, d), None, POLICY)


RUN = f"""{MET}, U AS (SELECT mid, count(*) FILTER (status = 'ok' AND pct_out <= 0.1) AS n_used, coalesce(avg(score) FILTER (status = 'ok' AND pct_out <= 0.1), 0) AS score FROM MET GROUP BY mid),
Q AS (SELECT s_suppkey AS mid, CAST(s_nationkey AS VARCHAR) AS lab, CASE WHEN s_suppkey % 13 = 0 THEN 'parquet_missing' WHEN s_suppkey % 17 = 0 THEN 'parquet_read_error' END AS reason, coalesce(score, 0) AS score, coalesce(n_used, 0) >= 4 AND coalesce(score, 0) >= 4.0 AS passed FROM supplier LEFT JOIN U ON U.mid = s_suppkey)"""


@query(
    "quality_summary",
    f"""WITH {RUN}, N AS (SELECT count(*) FILTER (reason IS NULL) AS s, count(*) FILTER (reason IS NULL AND passed) AS p, count(*) FILTER (reason IS NOT NULL) AS k FROM Q),
C AS (SELECT reason, count(*) AS k FROM Q WHERE reason IS NOT NULL GROUP BY ALL), A AS (SELECT lab, avg(score) AS m, count(*) AS k FROM Q WHERE reason IS NULL GROUP BY ALL),
L AS (SELECT 0 AS section, 0 AS i, 'Quality summary, threshold 4.00' AS line UNION ALL SELECT 0, 1, 'Files scored: ' || s FROM N UNION ALL SELECT 0, 2, 'Passed: ' || p FROM N UNION ALL SELECT 0, 3, 'Failed: ' || (s - p) FROM N UNION ALL SELECT 0, 4, 'Skipped: ' || k FROM N
   UNION ALL SELECT 1, 0, 'Skipped by reason' UNION ALL SELECT 1, 1, '- (none)' WHERE NOT EXISTS (FROM C) UNION ALL SELECT 1, 1 + row_number() OVER (ORDER BY -k, reason), '- ' || reason || ': ' || k FROM C
   UNION ALL SELECT 2, 0, 'Worst scores (up to 10)' UNION ALL SELECT 2, 1 + row_number() OVER (ORDER BY score, CAST(mid AS VARCHAR)), format('- {{}} | 2026 {{}} | score {{:.3f}}', mid, lab, score) FROM (SELECT * FROM Q WHERE reason IS NULL ORDER BY score, CAST(mid AS VARCHAR) LIMIT 10)
   UNION ALL SELECT 3, 0, 'Laboratories' UNION ALL SELECT 3, 1 + row_number() OVER (ORDER BY -m, lab), format('- {{}} | mean score {{:.3f}} | files {{}}', lab, m, k) FROM A)
SELECT CAST(section AS INTEGER) AS section, CAST(i AS INTEGER) AS i, line FROM L""",
)
def _(spark, d):
    return reports.quality_summary(run(spark, d), POLICY.threshold_pass)


@query(
    "tex_table",
    r"""WITH B AS (SELECT 1 AS part, 0 AS i, s_suppkey, s_suppkey || ' & ' || regexp_replace(replace(s_name, '\', '/'), '([_%&#$])', '\\\1', 'g') || ' & 50\% \\' AS line FROM supplier),
E AS (SELECT 0 AS part, 0 AS i, '\begin{longtable}{lll}' AS line UNION ALL SELECT 0, 1, '\caption{Suppliers \& shares} \label{t:s} \\' UNION ALL SELECT 0, 2, 's\_suppkey & s\_name & share \\ \hline' UNION ALL SELECT 2, 0, '\end{longtable}')
SELECT part, i, s_suppkey, line FROM B UNION ALL SELECT part, i, NULL, line FROM E""",
)
def _(spark, d):
    rows = views.table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit("50%").alias("share"))
    return reports.tex_table(rows, ["s_suppkey"], "Suppliers & shares", "t:s")
