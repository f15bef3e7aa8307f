"""Queries of the operators between the levels, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import BASE, DFT, EV, MET, MOVE, PMF, POLICY, SCO, SIG, STEPS, base, edges, metrics, movement, pmf, query, r6, results, scores, spectra, tests_of
from .operators import inference, relational, spectral, states
from .operators import quality as quality_ops
from .plans import views


@query("count_by_date_lab", f"WITH {SIG} SELECT fecha, lab, count(*) AS n FROM (SELECT DISTINCT fecha, lab, mid FROM SIG) GROUP BY ALL")
def _(spark, d):
    return relational.count_by(views.signal_wide(spark, d).select("fecha", "lab", "mid").distinct())


@query("valid_metric_rows", f"WITH {MET} SELECT lab, mid, channel, {r6('score')} FROM MET WHERE status = 'ok' AND pct_out <= 0.1 AND score IS NOT NULL AND slope IS NOT NULL")
def _(spark, d):
    rows = metrics(spark, d).withColumn("valido", F.when(F.col("pct_out") <= POLICY.max_pct_out, " Si").otherwise("no"))
    return relational.valid_rows(rows, ["score", "slope"]).select("lab", "mid", "channel", "score")


@query("entropy_pivot", f"WITH {PMF}, H AS (SELECT mid, channel, sum(CASE WHEN prob > 0 THEN -prob * log2(prob) ELSE 0 END) AS h FROM PMF GROUP BY ALL) SELECT s_suppkey AS mid, s_nationkey, " + ", ".join(f"round(max(h) FILTER (channel = '{c}'), 6) + 0.0 AS {c}" for c in views.CHANNELS) + " FROM supplier LEFT JOIN H ON mid = s_suppkey GROUP BY ALL")
def _(spark, d):
    meta = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("mid"), "s_nationkey")
    return relational.with_pivot(meta, states.entropy(pmf(spark, d)), views.CHANNELS)


@query("attached_schema", """WITH A AS (SELECT c_custkey % 60 AS mid, min_by(c_mktsegment, c_custkey) AS segment FROM customer WHERE c_custkey % 3 > 0 GROUP BY ALL), B AS (SELECT c_nationkey AS path, min_by(c_mktsegment, c_custkey) AS segment FROM customer GROUP BY ALL)
SELECT s_suppkey, s_suppkey AS mid, s_nationkey AS path, coalesce(A.segment, B.segment) AS segment FROM supplier LEFT JOIN A ON A.mid = s_suppkey LEFT JOIN B ON B.path = s_nationkey""")
def _(spark, d):
    rows = views.table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("mid"), F.col("s_nationkey").alias("path"))
    own = views.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 60).alias("mid"), F.col("c_nationkey").alias("path"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("row_no"))
    return relational.attached(rows, own, ["mid", "path"], "row_no").drop("row_no")


@query("schema_gate", "SELECT s_suppkey, s_suppkey % 50 AS mid FROM supplier WHERE s_suppkey % 50 IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def _(spark, d):
    schema = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("mid"), F.when(F.col("n_regionkey") < 2, "ok").otherwise("no").alias("schema_ok"))
    return relational.schema_gate(views.table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("mid")), schema)


@query("preflight", "SELECT count(*) AS n, count(DISTINCT o_orderdate) AS n_dates, count(DISTINCT o_orderpriority) AS n_labs, count(DISTINCT o_custkey) AS n_mids, count(*) FILTER (o_orderkey % 7 = 0) AS n_bad_numbers, count(*) FILTER (o_custkey % 5 = 0) AS n_missing FROM orders")
def _(spark, d):
    o = views.table(spark, d, "orders")
    number = F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderkey").cast("string"))
    return relational.preflight(o.select(F.col("o_orderdate").alias("fecha"), F.col("o_orderpriority").alias("lab"), F.col("o_custkey").alias("mid"), number.alias("archivo"), (F.col("o_custkey") % 5 != 0).alias("raw_exists")))


@query("first_known", "SELECT c_nationkey, min_by(c_mktsegment, c_custkey) FILTER (c_custkey % 3 = 0) AS segment, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def _(spark, d):
    c = views.table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    return relational.first_known(c, ["c_nationkey"], ["segment", "c_custkey"], "c_custkey")


@query("percent_sums", f"WITH {STEPS} SELECT lab, laser, round(sum(g_norm), 6) + 0.0 AS total, abs(sum(g_norm) - 100) <= 1e-6 AS fits FROM R GROUP BY ALL")
def _(spark, d):
    return relational.sum_check(results(spark, d), ["lab", "laser"], "g_norm")


@query("extreme_channels", f"WITH {MET}, K AS (SELECT lab, channel, round(avg(score), 9) AS s FROM MET GROUP BY ALL), B AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY s DESC, channel) AS b, row_number() OVER (PARTITION BY lab ORDER BY s, channel) AS w FROM K) SELECT lab, max(channel) FILTER (b = 1) AS best, max(channel) FILTER (w = 1) AS worst, round(max(s), 6) + 0.0 AS high, round(min(s), 6) + 0.0 AS low FROM B GROUP BY lab")
def _(spark, d):
    means = metrics(spark, d).groupBy("lab", "channel").agg(F.round(F.avg("score"), 9).alias("s"))
    return relational.extremes(means, ["lab"], "channel", "s")


@query("gate_fail_rows", f"WITH {SCO} SELECT lab, mid, {r6('score')} FROM SCO WHERE NOT (score >= 4.0 AND n_used >= n_required)")
def _(spark, d):
    return relational.pass_fail(quality_ops.gate(scores(spark, d), POLICY.threshold_pass))[1].select("lab", "mid", "score")


@query("stacked_series", f"WITH {EV} SELECT lab, laser, fecha, count(*) AS n, CAST(NULL AS DOUBLE) AS high FROM EV GROUP BY ALL UNION ALL SELECT lab, laser, NULL, NULL, round(max(value), 6) + 0.0 FROM EV GROUP BY ALL")
def _(spark, d):
    e = views.event_signal(spark, d)
    return relational.stacked([e.groupBy("lab", "laser", "fecha").agg(F.count("*").alias("n")), e.groupBy("lab", "laser").agg(F.max("value").alias("high"))])


@query("known_labels", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment) FILTER (c_mktsegment <> 'BUILDING')), '|') AS labels FROM customer GROUP BY c_nationkey")
def _(spark, d):
    return views.table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(relational.known_labels(F.col("c_mktsegment"), "BUILDING"), "|").alias("labels"))


@query("natural_order", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1073741824 ELSE s_suppkey END AS INTEGER) AS place FROM supplier")
def _(spark, d):
    name = F.when(F.col("s_suppkey") % 4 == 0, "laser").otherwise(F.concat(F.lit("Laser_"), "s_suppkey", F.lit("b7")))
    return views.table(spark, d, "supplier").select("s_suppkey", relational.natural(name).alias("place"))


@query("sampled_channels", f"WITH {SIG} SELECT channel, least(count(*), 1000) AS n FROM SIG GROUP BY channel")
def _(spark, d):
    return relational.count_by(relational.sampled(views.signal(spark, d, even=True), 1000, ["channel"], ["mid", "idx"]), ["channel"])


SAMPLE = SIG + """,
F1 AS (SELECT *, md5(concat_ws(':', mid, idx, '7')) AS h FROM SIG), F2 AS (SELECT *, row_number() OVER (PARTITION BY mid, channel ORDER BY h) AS r FROM F1),
F3 AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY h) AS g FROM F2 WHERE r <= 40)"""


@query("capped_sample", f"WITH {SAMPLE} SELECT mid, channel, idx, value FROM F3 WHERE g <= 1500")
def _(spark, d):
    rows = relational.capped_sample(views.signal(spark, d, even=True), 40, 1500, ["mid", "channel"], ["channel"], ["mid", "idx"], seed=7)
    return rows.select("mid", "channel", "idx", "value")


@query("light_channels", "WITH R AS (SELECT s_suppkey AS mid, 'Ch' || (s_suppkey % 9) AS canonical_name, CASE s_suppkey % 7 WHEN 0 THEN ' Luz roja' WHEN 1 THEN 'LASER ' || s_nationkey WHEN 2 THEN 'AccelZ' WHEN 3 THEN 'azul' ELSE 'flight' END AS raw_name FROM supplier WHERE s_suppkey % 9 < 5 OR s_suppkey % 7 IN (2, 3)) SELECT * FROM R WHERE canonical_name IN (SELECT canonical_name FROM R WHERE regexp_matches(lower(trim(raw_name)), '^luz|laser|light'))")
def _(spark, d):
    k = F.col("s_suppkey")
    raw = F.when(k % 7 == 0, " Luz roja").when(k % 7 == 1, F.concat(F.lit("LASER "), "s_nationkey")).when(k % 7 == 2, "AccelZ").when(k % 7 == 3, "azul").otherwise("flight")
    rows = views.table(spark, d, "supplier").where((k % 9 < 5) | (k % 7).isin(2, 3))
    return relational.light_channels(rows.select(k.alias("mid"), F.concat(F.lit("Ch"), (k % 9).cast("string")).alias("canonical_name"), raw.alias("raw_name"))).select("mid", "canonical_name", "raw_name")


@query("laser_names", f"WITH {SIG} SELECT DISTINCT channel AS laser FROM SIG")
def _(spark, d):
    rows = views.signal(spark, d).select(F.concat(F.lit(" "), "channel").alias("laser"))
    return relational.laser_names(rows.unionByName(rows.limit(1).select(F.lit("NaN").alias("laser"))))


@query("spectrum_cdf", f"WITH {DFT}, M AS (SELECT channel, f, avg(e) AS e FROM SPEC GROUP BY ALL) SELECT channel, f, round(sum(e) OVER (PARTITION BY channel ORDER BY f) / sum(e) OVER (PARTITION BY channel), 6) + 0.0 AS cdf FROM M")
def _(spark, d):
    return spectral.cumulative(spectral.mean_spectrum(spectra(spark, d)), ["channel"], "f", "e").select("channel", "f", "cdf")


EDGE = DFT + """,
M AS (SELECT channel, f, avg(e) AS e FROM SPEC GROUP BY ALL), C AS (SELECT channel, f, sum(e) OVER (PARTITION BY channel ORDER BY f) / sum(e) OVER (PARTITION BY channel) AS cdf FROM M),
ED AS (SELECT channel, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN 0.0::DOUBLE WHEN i = 6 THEN 0.5::DOUBLE ELSE min(f) FILTER (cdf >= i / 6.0::DOUBLE) / 64.0::DOUBLE END AS edge FROM C, range(7) r(i) GROUP BY channel, i)"""


@query("spectral_edges", f"WITH {EDGE} SELECT channel, i, round(edge, 6) + 0.0 AS edge FROM ED")
def _(spark, d):
    return spectral.spectral_edges(spectra(spark, d), 64).select("channel", F.posexplode("edges").alias("i", "edge"))


BANDS = EDGE + """,
B AS (SELECT mid, s.channel, x.i AS band, e FROM SPEC s JOIN ED x ON x.channel = s.channel JOIN ED y ON y.channel = s.channel AND y.i = x.i + 1 WHERE f / 64.0::DOUBLE >= x.edge AND (f / 64.0::DOUBLE < y.edge OR y.i = 6 AND f = 32)),
G AS (SELECT V.mid, V.channel, CAST(i AS INTEGER) AS band FROM V, range(6) r(i)),
E6 AS (SELECT mid, channel, band, coalesce(sum(e), 0) AS e FROM G LEFT JOIN B USING (mid, channel, band) GROUP BY ALL),
P6 AS (SELECT *, e / sum(e) OVER (PARTITION BY mid, channel) AS prob FROM E6)"""


@query("energy_bands", f"WITH {BANDS} SELECT mid, channel, band, {r6('e', 'prob')} FROM P6")
def _(spark, d):
    own = spectra(spark, d)
    return spectral.band_energy(own, spectral.spectral_edges(own, 64), 64)


@query("energy_summary", f"WITH {BANDS}, H AS (SELECT mid, channel, sum(CASE WHEN prob > 0 THEN -prob * log2(prob) ELSE 0 END) AS h FROM P6 GROUP BY ALL) SELECT mid, count(DISTINCT channel) AS n_channels, count(*) AS n_valid, round(avg(h), 6) + 0.0 AS mu, CASE WHEN count(*) > 1 THEN round(stddev_pop(h), 6) + 0.0 END AS sigma, round(sqrt(sum(h * h)), 6) + 0.0 AS norm2, 'OK' AS status FROM H GROUP BY mid")
def _(spark, d):
    own = spectra(spark, d)
    return spectral.energy_summary(spectral.band_energy(own, spectral.spectral_edges(own, 64), 64), own)


@query("modal_summary", f"WITH {DFT}, Z AS (SELECT mid, channel, e / sum(e) OVER (PARTITION BY mid, channel) AS p FROM SPEC WHERE f BETWEEN 4 AND 24) SELECT mid, channel, round(sum(-p * log2(p)), 6) + 0.0 AS h, count(*) AS n_modes FROM Z GROUP BY ALL")
def _(spark, d):
    return spectral.modal_summary(spectra(spark, d), 64, low=4 / 64, high=24 / 64)


@query("states_table", f"WITH {PMF}, H AS (SELECT mid, channel, sum(CASE WHEN prob > 0 THEN -prob * log2(prob) ELSE 0 END) AS h FROM PMF GROUP BY ALL), Q AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN -s_suppkey ELSE s_suppkey END AS mid FROM supplier) SELECT Q.mid, c.channel, {r6('h')}, CASE WHEN h IS NULL THEN 'missing_signal' ELSE 'ok' END AS status FROM Q CROSS JOIN (SELECT DISTINCT channel FROM EDGES) c LEFT JOIN H ON H.mid = Q.mid AND H.channel = c.channel")
def _(spark, d):
    queue = views.table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 10 == 0, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("mid"))
    return spectral.states_table(queue, views.signal(spark, d), edges(spark, d))


@query("safe_normalized", f"WITH {MOVE}, Z AS (SELECT mid, channel, bin, CASE WHEN mid % 5 = 0 THEN 0.0 ELSE prob END AS v FROM MP) SELECT mid, channel, bin, round(CASE WHEN sum(v) OVER w > 1e-12 THEN v / sum(v) OVER w WHEN bin = min(bin) OVER w THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS prob FROM Z WINDOW w AS (PARTITION BY mid, channel)")
def _(spark, d):
    rows = movement(spark, d).select("mid", "channel", "bin", F.when(F.col("mid") % 5 == 0, 0.0).otherwise(F.col("prob")).alias("v"))
    return spectral.safe_normalized(rows, ["mid", "channel"], "bin", "v").drop("v")


@query("estimated_rate", f"WITH {EV}, T AS (SELECT laser, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY laser ORDER BY ts, event_id) AS dt FROM EV) SELECT laser, CASE WHEN quantile_cont(dt, 0.5) > 0 THEN round(1 / quantile_cont(dt, 0.5), 6) + 0.0 END AS fs FROM T GROUP BY laser")
def _(spark, d):
    e = views.event_signal(spark, d).select("laser", F.struct("ts", "event_id").alias("o"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return spectral.estimated_rate(e, ["laser"], "t", "o")


@query("edge_problems", f"WITH {PMF} SELECT channel, CAST(NULL AS VARCHAR) AS problem FROM EDGES")
def _(spark, d):
    return edges(spark, d).select("channel", spectral.edge_problem(F.col("edges")).alias("problem"))


@query("mean_profile_row", f"WITH {BASE} SELECT fecha, lab, mid, round(avg(v) + 1e-9, 6) + 0.0 AS mean_v FROM CAN GROUP BY ALL")
def _(spark, d):
    wide = base(spark, d).groupBy("fecha", "lab", "mid").pivot("laser", [1, 2, 3, 4]).agg(F.first("v"))
    wide = wide.select("fecha", "lab", "mid", *[F.col(str(i)).alias(f"l{i}__v") for i in (1, 2, 3, 4)])
    return relational.row_mean(wide, "__v", "mean_v").select("fecha", "lab", "mid", F.round(F.col("mean_v") + 1e-9, 6).alias("mean_v"))


@query("inference_by_lab")
def _(spark, d):
    return inference.summarize(tests_of(spark, d), ("top", "bottom"))
