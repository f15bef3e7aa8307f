"""Registry of queries over the measurement views, and their SQL. Doubles are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import BinsPolicy, QualityPolicy
from .functions import scalars as S
from .operators import bins, contract, inference, profiles, quality, shaping, states
from .plans import views
from .sources import ladders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
POLICY = QualityPolicy(v_min=0.0, v_max=50_000.0, noise_scale=0.001, trend_scale=0.1, threshold_pass=4.0)

SIG = """
W AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS fecha, r_name AS lab, l_suppkey AS mid,
   CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS idx,
   l_quantity, l_extendedprice, l_discount, l_tax
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
SIG AS (SELECT fecha, lab, mid, idx, 'l_quantity' AS channel, l_quantity AS value FROM W UNION ALL SELECT fecha, lab, mid, idx, 'l_extendedprice', l_extendedprice FROM W
   UNION ALL SELECT fecha, lab, mid, idx, 'l_discount', l_discount FROM W UNION ALL SELECT fecha, lab, mid, idx, 'l_tax', l_tax FROM W)"""
MET = SIG + """,
M0 AS (SELECT lab, mid, channel, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high, quantile_cont(value, 0.5) AS median,
   coalesce(regr_slope(value, idx), 0) AS slope, coalesce(corr(value, idx), 0) AS trend_corr, count(*) FILTER (value < 0 OR value > 50000) AS n_out FROM SIG GROUP BY ALL),
M1 AS (SELECT *, CASE WHEN std = 0 THEN 'inf'::DOUBLE WHEN mean = 0 THEN '-inf'::DOUBLE ELSE 20 * log10(abs(mean) / std) END AS snr_db,
   CASE WHEN mean = 0 THEN 'inf'::DOUBLE ELSE std / abs(mean) * 100 END AS cv_pct, n_out * 100.0::DOUBLE / n AS pct_out FROM M0),
MET AS (SELECT *, CASE WHEN n >= 10 THEN least(10, greatest(0, (least(10, greatest(0, 10 - std * 0.001)) + least(10, greatest(0, snr_db / 5)) + least(10, greatest(0, 10 - abs(slope) * 0.1))) / 3)) END AS score,
   CASE WHEN n < 10 THEN 'insufficient_samples' ELSE 'ok' END AS status FROM M1)"""
SCO = MET + """,
SCO AS (SELECT lab, mid, count(*) AS n_channels, count(*) FILTER (pct_out <= 0.1) AS n_used, coalesce(avg(score) FILTER (pct_out <= 0.1), 0) AS score, 4 AS n_required FROM MET GROUP BY lab, mid)"""
BASE = SIG + """,
BASE AS (SELECT fecha, lab, mid, CASE channel WHEN 'l_discount' THEN 1 WHEN 'l_extendedprice' THEN 2 WHEN 'l_quantity' THEN 3 ELSE 4 END AS laser, avg(value) AS v FROM SIG GROUP BY ALL),
OK AS (SELECT fecha, lab, mid FROM BASE GROUP BY ALL HAVING count(*) = 4),
CAN AS (SELECT BASE.* FROM BASE SEMI JOIN OK USING (fecha, lab, mid))"""
CORR = "CASE WHEN count({x}) >= 2 AND min({x}) <> max({x}) AND min({y}) <> max({y}) THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
EDGES = SIG + """,
SUP AS (SELECT channel, quantile_cont(value, 0.0005) AS lo, quantile_cont(value, 0.9995) AS hi FROM SIG GROUP BY channel),
E0 AS (SELECT channel, list_transform(quantile_cont(least(hi, greatest(lo, value)), [{at}]), lambda x: round(x, 6)) AS e FROM SIG JOIN SUP USING (channel) GROUP BY channel),
EDGES AS (SELECT channel, list_reduce(list_transform(e, lambda x: [x]), lambda a, b: list_append(a, CASE WHEN b[1] <= a[-1] THEN a[-1] + 1e-12 ELSE b[1] END)) AS edges FROM E0)"""
BINS = 16
EDGES = EDGES.replace("{at}", ", ".join(str(i / BINS) for i in range(BINS + 1)))
PMF = EDGES + f""",
CELL AS (SELECT lab, mid, channel, idx, value, least(greatest(len(list_filter(edges, lambda e: e <= value)) - 1, 0), {BINS - 1}) AS bin FROM SIG JOIN EDGES USING (channel)),
PMF AS (SELECT m.mid, m.channel, CAST(b AS INTEGER) AS bin, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY m.mid, m.channel) AS prob
   FROM (SELECT DISTINCT mid, channel FROM SIG) m CROSS JOIN range({BINS}) r(b) LEFT JOIN (SELECT mid, channel, bin, count(*) AS k FROM CELL GROUP BY ALL) c ON c.mid = m.mid AND c.channel = m.channel AND c.bin = b)"""
EV = """
EV AS (SELECT CAST(ts AS DATE) AS fecha, event_type AS lab, CAST(user_id % 6 + 1 AS INTEGER) AS laser, ts, event_id, value FROM events)"""
STEPS = EV + """,
C AS (SELECT lab, laser, fecha, bin, count(*) AS k FROM (SELECT lab, laser, fecha, least(7, greatest(0, CAST(floor(value / 25) AS INTEGER))) AS bin FROM EV) GROUP BY ALL),
G AS (SELECT d.*, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT lab, laser, fecha FROM EV) d CROSS JOIN range(8) r(b)),
P AS (SELECT lab, laser, date_diff('day', DATE '1970-01-01', fecha) AS day, bin, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY lab, laser, fecha) AS prob FROM G LEFT JOIN C USING (lab, laser, fecha, bin)),
Q AS (SELECT *, lead(day) OVER w AS nxt, lead(prob) OVER w AS q FROM P WINDOW w AS (PARTITION BY lab, laser, bin ORDER BY day)),
KL AS (SELECT lab, laser, day, sum((prob + 1e-12) * log2((prob + 1e-12) / (q + 1e-12))) AS fwd, sum((q + 1e-12) * log2((q + 1e-12) / (prob + 1e-12))) AS bwd FROM Q WHERE nxt = day + 1 GROUP BY ALL),
ST AS (SELECT lab, laser, CAST(row_number() OVER (PARTITION BY lab, laser ORDER BY day) AS INTEGER) AS n, fwd, bwd, fwd + bwd AS s_forma FROM KL),
R0 AS (SELECT *, 100 * s_forma / sum(s_forma) OVER (PARTITION BY lab, laser) AS pct_forma FROM ST),
R AS (SELECT *, pct_forma AS g_raw, 100 * pct_forma / sum(pct_forma) OVER (PARTITION BY lab, laser) AS g_norm FROM R0)"""
DFT = """
V AS (SELECT vec_id AS mid, CAST(label AS INTEGER) AS channel, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
X AS (SELECT mid, channel, t - 1 AS t, v[t] - list_avg(v) AS x FROM V, range(1, 65) r(t)),
SPEC AS (SELECT mid, channel, CAST(f AS INTEGER) AS f, (pow(sum(x * cos(2 * pi() * f * t / 64)), 2) + pow(sum(x * sin(2 * pi() * f * t / 64)), 2)) / 64 AS e FROM X, range(33) r(f) GROUP BY ALL)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero cleared."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


def r6t(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


def untied(df: DataFrame, *names: str) -> DataFrame:
    """Moves means of few decimals off the half at which the two engines round apart."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def metrics(spark, d):
    return quality.channel_metrics(views.signal(spark, d), POLICY)


def scores(spark, d):
    return quality.file_scores(metrics(spark, d), F.col("pct_out") <= POLICY.max_pct_out, POLICY)


def base(spark, d):
    laser = F.when(F.col("channel") == "l_discount", 1).when(F.col("channel") == "l_extendedprice", 2).when(F.col("channel") == "l_quantity", 3).otherwise(4)
    rows = views.signal(spark, d).groupBy("fecha", "lab", "mid", laser.alias("laser")).agg(F.avg("value").alias("v"))
    return profiles.canonical_base(rows, 4)


def edges(spark, d):
    return bins.quantile_edges(views.signal(spark, d), BINS, digits=6)


def pmf(spark, d):
    return states.pmf(views.signal(spark, d), edges(spark, d))


def steps(spark, d):
    e = views.event_signal(spark, d)
    bin_ = F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.col("value") / 25).cast("int")))
    counts = e.groupBy("lab", "laser", "fecha", bin_.alias("bin")).agg(F.count("*").alias("k"))
    grid = e.select("lab", "laser", "fecha").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bin"))
    p = grid.join(counts, ["lab", "laser", "fecha", "bin"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    p = p.withColumn("prob", F.col("k") / F.sum("k").over(Window.partitionBy("lab", "laser", "fecha"))).withColumn("day", F.unix_date("fecha"))
    kl = states.consecutive_kl(p)
    n = F.row_number().over(Window.partitionBy("lab", "laser").orderBy("day"))
    return kl.select("lab", "laser", n.alias("n"), F.col("fwd").alias("forma_fwd"), F.col("bwd").alias("forma_bwd"))


def results(spark, d):
    return inference.recompute(steps(spark, d), ["forma"])


def tests_of(spark, d, n_perm=5000):
    return inference.bh_fdr(inference.permutation_test(inference.within_n_min(results(spark, d)), n_perm=n_perm))


def spectra(spark, d):
    return states.psd(views.vectors(spark, d), 64)


METRIC = ["mean", "std", "low", "high", "median", "snr_db", "cv_pct", "slope", "trend_corr", "pct_out", "score"]


@query("quality_channel_metrics", f"WITH {MET} SELECT lab, mid, channel, n, n_out, status, round(high - low, 6) + 0.0 AS range, {r6(*METRIC)} FROM MET")
def _(spark, d):
    return metrics(spark, d)


@query("quality_validation", f"""WITH {SIG} SELECT *, reason IN ('in_range', 'some_out_of_range') AS valid FROM (SELECT lab, mid, channel, CAST(0 AS BIGINT) AS n_bad, count(*) AS n, count(*) FILTER (value < 0 OR value > 50000) AS n_out,
 round(count(*) FILTER (value < 0 OR value > 50000) * 100.0 / count(*), 6) + 0.0 AS pct_out, CASE WHEN count(*) < 10 THEN 'few_samples' WHEN count(*) FILTER (value < 0 OR value > 50000) * 100.0 / count(*) > 0.1 THEN 'out_of_range'
 WHEN count(*) FILTER (value < 0 OR value > 50000) > 0 THEN 'some_out_of_range' ELSE 'in_range' END AS reason FROM SIG GROUP BY ALL)""")
def _(spark, d):
    return quality.validation(views.signal(spark, d), POLICY)


@query("quality_file_scores", f"WITH {SCO} SELECT lab, mid, n_channels, n_used, n_required, {r6('score')} FROM SCO")
def _(spark, d):
    return scores(spark, d)


@query("quality_gate", f"WITH {SCO} SELECT lab, mid, n_channels, n_used, n_required, {r6('score')}, score >= 4.0 AND n_used >= n_required AS passed FROM SCO")
def _(spark, d):
    return quality.gate(scores(spark, d), POLICY.threshold_pass)


@query("quality_gate_by_lab", f"WITH {SCO} SELECT lab, count(*) AS n, count(*) FILTER (score >= 4.0 AND n_used >= 4) AS n_pass, count(*) - count(*) FILTER (score >= 4.0 AND n_used >= 4) AS n_fail FROM SCO GROUP BY lab")
def _(spark, d):
    return quality.gate_by_lab(quality.gate(scores(spark, d), POLICY.threshold_pass))


@query("quality_summary_grouping_sets", f"WITH {MET} SELECT lab, channel, CAST(grouping(lab, channel) AS BIGINT) AS level, count(*) AS n, count(DISTINCT mid) AS n_mids, count(DISTINCT channel) AS n_channels, round(avg(score), 6) + 0.0 AS mean_score, round(stddev_samp(score), 6) + 0.0 AS std_score, round(avg(std), 4) + 0.0 AS mean_noise FROM MET WHERE status = 'ok' GROUP BY GROUPING SETS ((lab), (lab, channel), ())")
def _(spark, d):
    found = quality.summaries(metrics(spark, d), [["lab"], ["lab", "channel"], []])
    return found.withColumn("mean_noise", F.round("mean_noise", 4))


@query("worst_measurements", f"WITH {SCO} SELECT lab, mid, n_channels, n_used, n_required, {r6('score')} FROM SCO ORDER BY SCO.score, lab, mid LIMIT 10")
def _(spark, d):
    return quality.worst(scores(spark, d))


@query("status_breakdown", f"WITH {MET} SELECT status, channel, count(*) AS n FROM MET GROUP BY ALL")
def _(spark, d):
    return quality.status_breakdown(metrics(spark, d), ("status", "channel"))


@query("heatmap_mid_channel", f"WITH {MET} SELECT lab, mid, " + ", ".join(f"round(max(score) FILTER (channel = '{c}'), 6) + 0.0 AS {c}" for c in views.CHANNELS) + " FROM MET GROUP BY lab, mid")
def _(spark, d):
    return metrics(spark, d).groupBy("lab", "mid").pivot("channel", list(views.CHANNELS)).agg(F.first("score"))


@query("boxplot_by_lab", f"WITH {MET} SELECT lab, round(quantile_cont(score, 0.25), 6) + 0.0 AS q25, round(quantile_cont(score, 0.5), 6) + 0.0 AS q50, round(quantile_cont(score, 0.75), 6) + 0.0 AS q75 FROM MET GROUP BY lab")
def _(spark, d):
    q = metrics(spark, d).groupBy("lab").agg(F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("lab", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


@query("canonical_base", f"WITH {BASE} SELECT fecha, lab, mid, laser, {r6t('v')} FROM CAN")
def _(spark, d):
    return untied(base(spark, d), "v")


@query("block_means", f"WITH {BASE} SELECT fecha, lab, laser, round(avg(v), 6) + 0.0 AS block_v, count(*) AS n FROM CAN GROUP BY ALL")
def _(spark, d):
    return profiles.block_means(base(spark, d))


@query("profiles_by_measurement", f"WITH {BASE}, B AS (SELECT *, avg(v) OVER (PARTITION BY fecha, lab, laser) AS bv FROM CAN) SELECT fecha, lab, mid, round(avg(v) + 1e-9, 6) + 0.0 AS profile_mean, round(stddev_samp(v), 6) + 0.0 AS profile_std, round(min(v) + 1e-9, 6) + 0.0 AS profile_min, round(max(v) + 1e-9, 6) + 0.0 AS profile_max, CASE WHEN min(v) <> 0 THEN round(max(v) / min(v), 4) + 0.0 END AS anisotropy, round({CORR.format(x='v', y='bv')}, 6) + 0.0 AS coherence, round(sqrt(sum((v - bv) * (v - bv))), 6) + 0.0 AS distance FROM B GROUP BY ALL")
def _(spark, d):
    found = profiles.measurement_profiles(base(spark, d)).withColumn("anisotropy", F.round("anisotropy", 4))
    return untied(found, "profile_mean", "profile_min", "profile_max")


@query("summary_by_date_lab", f"WITH {BASE}, L AS (SELECT fecha, lab, laser, avg(v) AS v, stddev_samp(v) AS s, count(*) AS n FROM CAN GROUP BY ALL), K AS (SELECT fecha, lab, count(DISTINCT mid) AS k FROM CAN GROUP BY ALL) SELECT fecha, lab, round(avg(v), 6) + 0.0 AS profile_mean, round(stddev_samp(v), 6) + 0.0 AS profile_std, round(min(v), 6) + 0.0 AS profile_min, round(max(v), 6) + 0.0 AS profile_max, round(max(v) / min(v), 4) + 0.0 AS anisotropy, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_lasers, round(avg(s), 6) + 0.0 AS between_std, any_value(k) AS n_measurements, any_value(k) >= 3 AS valid FROM L JOIN K USING (fecha, lab) GROUP BY ALL")
def _(spark, d):
    return profiles.block_summary(base(spark, d)).withColumn("anisotropy", F.round("anisotropy", 4))


PAIRS = f"PR AS (SELECT a.fecha, a.lab, a.laser AS laser_i, b.laser AS laser_j, {CORR.format(x='a.v', y='b.v')} AS r, count(*) AS n_pairs FROM CAN a JOIN CAN b ON a.fecha = b.fecha AND a.lab = b.lab AND a.mid = b.mid AND a.laser < b.laser GROUP BY ALL)"


@query("intra_block_corr", f"WITH {BASE}, {PAIRS} SELECT fecha, lab, laser_i, laser_j, n_pairs, {r6('r')} FROM PR")
def _(spark, d):
    return profiles.intra_block_corr(base(spark, d))


@query("intra_block_corr_spearman", f"WITH {BASE}, RK AS (SELECT fecha, lab, mid, laser, rank() OVER (PARTITION BY fecha, lab, laser ORDER BY v) + (count(*) OVER (PARTITION BY fecha, lab, laser, v) - 1) / 2.0::DOUBLE AS v FROM (SELECT fecha, lab, mid, laser, round(v, 9) AS v FROM CAN)), {PAIRS.replace('CAN', 'RK')} SELECT fecha, lab, laser_i, laser_j, n_pairs, {r6('r')} FROM PR")
def _(spark, d):
    return profiles.intra_block_corr(base(spark, d).withColumn("v", F.round("v", 9)), "spearman")


@query("corr_matrix", f"WITH {BASE}, {PAIRS}, A AS (SELECT fecha, lab, laser_i, laser_j, r FROM PR UNION ALL SELECT fecha, lab, laser_j, laser_i, r FROM PR UNION ALL SELECT DISTINCT fecha, lab, laser, laser, 1.0::DOUBLE FROM CAN) SELECT fecha, lab, laser_i, laser_j, {r6('r')} FROM A")
def _(spark, d):
    return profiles.corr_matrix(profiles.intra_block_corr(base(spark, d)))


@query("global_summary", f"WITH {BASE}, {PAIRS} SELECT fecha, lab, round(avg(r), 6) + 0.0 AS mean_r, count(r) AS n_pairs FROM PR GROUP BY ALL")
def _(spark, d):
    return profiles.global_summary(profiles.intra_block_corr(base(spark, d)))


@query("channel_global", f"WITH {BASE}, L AS (SELECT fecha, lab, laser, avg(v) AS v FROM CAN GROUP BY ALL) SELECT laser, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS std, count(*) AS n_blocks FROM L GROUP BY laser")
def _(spark, d):
    return profiles.channel_global(base(spark, d))


for _name, _vary, _fixed in (("pairwise_dates", "fecha", "lab"), ("pairwise_labs", "lab", "fecha")):
    query(_name, f"WITH {BASE}, K AS (SELECT fecha, lab FROM CAN GROUP BY ALL HAVING count(DISTINCT mid) >= 3), L AS (SELECT fecha, lab, laser, avg(v) AS v FROM CAN SEMI JOIN K USING (fecha, lab) GROUP BY ALL) SELECT x.{_fixed}, x.{_vary} AS a, y.{_vary} AS b, round({CORR.format(x='x.v', y='y.v')}, 6) + 0.0 AS corr, round(sqrt(sum((x.v - y.v) * (x.v - y.v))), 6) + 0.0 AS distance, round(max(y.v) / min(y.v) - max(x.v) / min(x.v), 3) + 0.0 AS anisotropy_delta FROM L x JOIN L y ON x.{_fixed} = y.{_fixed} AND x.laser = y.laser AND x.{_vary} < y.{_vary} GROUP BY ALL")(lambda spark, d, v=_vary: profiles.pairwise(base(spark, d), v).withColumn("anisotropy_delta", F.round("anisotropy_delta", 3)))


@query("robust_support", f"WITH {SIG} SELECT channel, round(quantile_cont(value, 0.0005), 6) + 0.0 AS lo, round(quantile_cont(value, 0.9995), 6) + 0.0 AS hi, count(*) AS n FROM SIG GROUP BY channel")
def _(spark, d):
    return bins.robust_support(views.signal(spark, d))


@query("mad_sigma", f"WITH {SIG}, M AS (SELECT channel, quantile_cont(value, 0.5) AS m FROM SIG GROUP BY channel) SELECT channel, round(1.4826 * quantile_cont(abs(value - m), 0.5), 6) + 0.0 AS sigma FROM SIG JOIN M USING (channel) GROUP BY channel")
def _(spark, d):
    return bins.mad_sigma(views.signal(spark, d))


@query("fd_bins", f"WITH {SIG}, Q AS (SELECT channel, count(*) AS n, quantile_cont(value, 0.0005) AS lo, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(value, 0.9995) AS hi FROM SIG GROUP BY channel) SELECT channel, CAST(least(256, greatest(32, CASE WHEN n < 16 OR b <= a OR hi <= lo THEN greatest(2, round_even(sqrt(n), 0)) ELSE ceil((hi - lo) / (2 * (b - a) * pow(n, -1.0 / 3))) END)) AS INTEGER) AS n_bins FROM Q")
def _(spark, d):
    return bins.fd_bins(views.signal(spark, d))


@query("quantile_edges", f"WITH {EDGES} SELECT channel, CAST(i - 1 AS INTEGER) AS i, round(edges[i], 6) + 0.0 AS edge FROM EDGES, range(1, {BINS + 2}) r(i)")
def _(spark, d):
    return edges(spark, d).select("channel", F.posexplode("edges").alias("i", "edge"))


def steps_of(spark, d):
    """First differences of all samples, null for the first of a measurement."""
    return bins.steps(views.signal_wide(spark, d), views.CHANNELS)


@query("increment_support", f"WITH {SIG}, D AS (SELECT channel, abs(value - lag(value) OVER (PARTITION BY mid, channel ORDER BY idx)) AS a FROM SIG) SELECT channel, CASE WHEN quantile_cont(a, 0.999) > 0 THEN round(quantile_cont(a, 0.999), 6) + 0.0 ELSE round(max(a), 6) + 0.0 END AS support, count(*) AS n FROM D WHERE a IS NOT NULL GROUP BY channel")
def _(spark, d):
    return bins.increment_support(None, steps=steps_of(spark, d))


@query("coupling_q", f"WITH {SIG}, N AS (SELECT channel, count(value) AS n FROM SIG GROUP BY channel) SELECT CAST(greatest(4, least(16, floor(sqrt(min(n) / 25.0)))) AS INTEGER) AS q FROM N")
def _(spark, d):
    return bins.coupling_q(views.signal(spark, d))


@query("bins_health", f"WITH {EDGES}, H AS (SELECT channel, count(*) AS n, CAST(0 AS BIGINT) AS n_nan, count(*) FILTER (value < edges[1] OR value > edges[-1]) AS n_clip, any_value(edges) AS e FROM SIG JOIN EDGES USING (channel) GROUP BY channel) SELECT channel, n, n_nan, n_clip, round(n_clip / n, 6) + 0.0 AS clip_rate, 0.0::DOUBLE AS nan_rate, CAST(len(e) - 1 AS INTEGER) AS n_bins, round(e[-1] - e[1], 6) + 0.0 AS span, round(len(list_filter(range(1, len(e)), lambda i: (e[i + 1] - e[i]) / (e[-1] - e[1]) <= 1e-6)) / (len(e) - 1), 6) + 0.0 AS micro_fraction, CASE WHEN n_clip / n >= 0.02 THEN 'FAIL' WHEN n_clip / n >= 0.005 THEN 'WARN' ELSE 'OK' END AS status FROM H")
def _(spark, d):
    return bins.health(views.signal(spark, d), edges(spark, d))


@query("pmf_amplitude", f"WITH {PMF} SELECT mid, channel, bin, round(prob + 1e-9, 6) + 0.0 AS prob, round(edges[bin + 1], 6) + 0.0 AS bin_left, round(edges[bin + 2], 6) + 0.0 AS bin_right FROM PMF JOIN EDGES USING (channel)")
def _(spark, d):
    return untied(pmf(spark, d), "prob")


@query("entropy_summary", f"WITH {PMF} SELECT mid, channel, round(sum(CASE WHEN prob > 0 THEN -prob * log2(prob) ELSE 0 END), 6) + 0.0 AS h, count(*) AS n_bins FROM PMF GROUP BY ALL")
def _(spark, d):
    return states.entropy(pmf(spark, d))


@query("forma_summary", f"WITH {PMF}, H AS (SELECT mid, channel, sum(CASE WHEN prob > 0 THEN -prob * log2(prob) ELSE 0 END) AS h FROM PMF GROUP BY ALL) SELECT mid, count(*) AS n_valid, round(avg(h), 6) + 0.0 AS mu, CASE WHEN count(*) > 1 THEN round(stddev_pop(h), 6) + 0.0 END AS sigma, round(sqrt(sum(h * h)), 6) + 0.0 AS norm2 FROM H GROUP BY mid")
def _(spark, d):
    return states.across_channels(states.entropy(pmf(spark, d)))


DX = """,
DX AS (SELECT mid, channel, dx AS value FROM (SELECT mid, channel, value - lag(value) OVER (PARTITION BY mid, channel ORDER BY idx) AS dx FROM SIG) WHERE dx IS NOT NULL)"""


def sql_edges(name: str, source: str, spec: str) -> str:
    """CTEs that end in name (channel, edges): equiprobable edges of source's values, clipped to lo and hi, ties broken, ones closer than width merged; spec has channel, b, lo, hi, width and n."""
    up = "list_reduce(list_transform({e}, lambda x: [x]), lambda a, b: list_append(a, CASE WHEN b[1] <= a[-1] THEN a[-1] + 1e-12 ELSE b[1] END))"
    return f""",
{name}_R AS (SELECT channel, value, row_number() OVER (PARTITION BY channel ORDER BY value) - 1 AS r FROM {source}),
{name}_P AS (SELECT *, i / b * (n - 1) AS p FROM {spec}, range(257) t(i) WHERE i <= b),
{name}_X AS (SELECT p.channel, i, width, least(hi, greatest(lo, x.value)) AS x, least(hi, greatest(lo, y.value)) AS y, p - floor(p) AS f FROM {name}_P p
   JOIN {name}_R x ON x.channel = p.channel AND x.r = CAST(floor(p) AS BIGINT) JOIN {name}_R y ON y.channel = p.channel AND y.r = least(CAST(floor(p) AS BIGINT) + 1, n - 1)),
{name}_E AS (SELECT channel, any_value(width) AS width, list(x + (y - x) * f ORDER BY i) AS e FROM {name}_X GROUP BY channel),
{name}_U AS (SELECT channel, width, {up.format(e="e")} AS e FROM {name}_E),
{name}_M AS (SELECT channel, list_append(list_reduce(list_transform(e[1:len(e) - 1], lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] >= width THEN list_append(a, b[1]) ELSE a END), e[-1]) AS e FROM {name}_U),
{name} AS (SELECT channel, {up.format(e="e")} AS edges FROM {name}_M)"""


def sql_count(n: str, lo: str, hi: str, a: str, b: str) -> str:
    return f"CAST(least(256, greatest(32, CASE WHEN {n} < 16 OR {b} <= {a} OR {hi} <= {lo} THEN greatest(2, round_even(sqrt({n}), 0)) ELSE ceil(({hi} - {lo}) / (2 * ({b} - {a}) * pow({n}, -1.0 / 3))) END)) AS INTEGER)"


#: The bins contract: statistics of values and increments, then the three kinds of edges.
CONTRACT = (
    SIG
    + DX
    + f""",
A1 AS (SELECT channel, count(*) AS n, quantile_cont(value, 0.0005) AS lo, quantile_cont(value, 0.9995) AS hi, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q75 FROM SIG GROUP BY channel),
A2 AS (SELECT channel, 1.4826 * quantile_cont(abs(value - med), 0.5) AS sigma FROM SIG JOIN A1 USING (channel) GROUP BY channel),
D1 AS (SELECT channel, count(*) AS n, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q75, quantile_cont(abs(value), 0.999) AS tail, max(abs(value)) AS most FROM DX GROUP BY channel),
D2 AS (SELECT channel, 1.4826 * quantile_cont(abs(value - med), 0.5) AS sigma FROM DX JOIN D1 USING (channel) GROUP BY channel),
D3 AS (SELECT D1.*, sigma, CASE WHEN tail > 0 THEN tail WHEN sigma > 0 THEN 6 * sigma ELSE most END AS hi FROM D1 JOIN D2 USING (channel)),
SA AS (SELECT channel, n, lo, hi, sigma, greatest(1e-12, 0.25 * sigma) AS width, {sql_count("n", "lo", "hi", "q25", "q75")} AS b FROM A1 JOIN A2 USING (channel)),
SD AS (SELECT channel, n, -hi AS lo, hi, sigma, greatest(1e-12, 0.25 * sigma) AS width, {sql_count("n", "-hi", "hi", "q25", "q75")} AS b FROM D3),
SQ AS (SELECT channel, n, lo, hi, greatest(1e-9, 0.25 * sigma) AS width, (SELECT CAST(greatest(4, least(16, floor(sqrt(min(n) / 25.0)))) AS INTEGER) FROM A1) AS b FROM SA)"""
    + sql_edges("EA", "SIG", "SA")
    + sql_edges("ED", "DX", "SD")
    + sql_edges("EQ", "SIG", "SQ")
)
ALL_EDGES = "(SELECT channel, 'amplitude' AS kind, edges FROM EA UNION ALL SELECT channel, 'increment', edges FROM ED UNION ALL SELECT channel, 'coupling', edges FROM EQ)"
#: The small scale factor has fewer samples than the contract asks for by default.
LEAST = (1000, 256)


def spec(spark, d):
    return contract.contract(views.signal(spark, d), least=LEAST, steps=steps_of(spark, d))


@query("bins_contract", f"WITH {CONTRACT} SELECT channel, kind, CAST(i - 1 AS INTEGER) AS i, round(edges[i], 6) + 0.0 AS edge FROM {ALL_EDGES}, range(1, 300) t(i) WHERE i <= len(edges)")
def _(spark, d):
    return contract.long_edges(spec(spark, d))


@query("bins_contract_summary", f"WITH {CONTRACT} SELECT SA.channel, SA.n, SD.n AS n_dx, round(SA.sigma, 6) + 0.0 AS sigma, round(SD.sigma, 6) + 0.0 AS sigma_dx, CAST(len(EA.edges) - 1 AS INTEGER) AS b_amp, CAST(len(ED.edges) - 1 AS INTEGER) AS b_dx, CAST(len(EQ.edges) - 1 AS INTEGER) AS q, CASE WHEN SA.n < 1000 THEN 'few_samples' WHEN len(EA.edges) < 3 THEN 'amplitude_collapsed' WHEN SD.n < 256 THEN 'few_increments' WHEN len(ED.edges) < 3 THEN 'increment_collapsed' END AS problem FROM SA JOIN SD USING (channel) JOIN EA USING (channel) JOIN ED USING (channel) JOIN EQ USING (channel)")
def _(spark, d):
    size = lambda c: (F.size(c) - 1).alias
    return contract.contract(views.signal(spark, d), least=LEAST, strict=False, steps=steps_of(spark, d)).select("channel", "n", "n_dx", "sigma", "sigma_dx", size("amplitude")("b_amp"), size("increment")("b_dx"), size("coupling")("q"), "problem")


MOVE = CONTRACT + """,
MC AS (SELECT mid, channel, least(greatest(len(list_filter(edges, lambda e: e <= value)) - 1, 0), len(edges) - 2) AS bin, count(*) AS k FROM DX JOIN ED USING (channel) GROUP BY ALL),
MG AS (SELECT mid, channel, CAST(b AS INTEGER) AS bin, edges FROM (SELECT DISTINCT mid, channel FROM SIG) JOIN ED USING (channel), range(300) t(b) WHERE b < len(edges) - 1),
MT AS (SELECT *, sum(coalesce(k, 0)) OVER (PARTITION BY mid, channel) AS n FROM MG LEFT JOIN MC USING (mid, channel, bin)),
MP AS (SELECT mid, channel, bin, edges[bin + 1] AS bin_left, edges[bin + 2] AS bin_right, CASE WHEN n > 0 THEN coalesce(k, 0) / n ELSE CAST(bin = 0 AS DOUBLE) END AS prob FROM MT)"""


def movement(spark, d):
    """N12 on the contract's increment edges."""
    return states.pmf(steps_of(spark, d), contract.edges_of(spec(spark, d), "increment"), missing=False)


@query("pmf_movement", f"WITH {MOVE} SELECT mid, channel, bin, {r6('prob', 'bin_left', 'bin_right')} FROM MP")
def _(spark, d):
    return movement(spark, d)


@query("movimiento_summary", f"WITH {MOVE}, H AS (SELECT mid, channel, sum(CASE WHEN prob > 0 THEN -prob * log2(prob) ELSE 0 END) AS h FROM MP GROUP BY ALL) SELECT mid, count(*) AS n_valid, round(avg(h), 6) + 0.0 AS mu, CASE WHEN count(*) > 1 THEN round(stddev_pop(h), 6) + 0.0 END AS sigma, round(sqrt(sum(h * h)), 6) + 0.0 AS norm2 FROM H GROUP BY mid")
def _(spark, d):
    return states.across_channels(states.entropy(movement(spark, d)))


JOINT = PMF + """,
J AS (SELECT a.mid, a.channel AS channel_i, b.channel AS channel_j, a.bin AS bi, b.bin AS bj, count(*) AS k FROM CELL a JOIN CELL b ON a.mid = b.mid AND a.idx = b.idx AND a.channel < b.channel GROUP BY ALL)"""


def joint(spark, d):
    return states.joint_counts(views.signal_wide(spark, d, even=True), edges(spark, d), views.CHANNELS)


@query("joint_counts", f"WITH {JOINT} SELECT mid, channel_i, channel_j, CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj, k FROM J")
def _(spark, d):
    return joint(spark, d)


@query("mutual_information", f"WITH {JOINT}, Z AS (SELECT *, k / sum(k) OVER p AS p, sum(k) OVER (PARTITION BY mid, channel_i, channel_j, bi) / sum(k) OVER p AS pi, sum(k) OVER (PARTITION BY mid, channel_i, channel_j, bj) / sum(k) OVER p AS pj FROM J WINDOW p AS (PARTITION BY mid, channel_i, channel_j)) SELECT mid, channel_i, channel_j, round(sum(p * log2(p / (pi * pj))), 6) + 0.0 AS mi, round(sum(-p * log2(p / pj)), 6) + 0.0 AS h_cond FROM Z GROUP BY ALL")
def _(spark, d):
    return states.mutual_information(joint(spark, d)).select("mid", "channel_i", "channel_j", "mi", "h_cond")


@query("uncertainty", f"WITH {JOINT}, Z AS (SELECT *, k / sum(k) OVER p AS p, sum(k) OVER (PARTITION BY mid, channel_i, channel_j, bi) / sum(k) OVER p AS pi, sum(k) OVER (PARTITION BY mid, channel_i, channel_j, bj) / sum(k) OVER p AS pj FROM J WINDOW p AS (PARTITION BY mid, channel_i, channel_j)), Y AS (SELECT mid, channel_i, channel_j, sum(p * log2(p / (pi * pj))) AS mi, sum(-p * log2(pi)) AS h_i, sum(-p * log2(pj)) AS h_j FROM Z GROUP BY ALL) SELECT mid, channel_i, channel_j, {r6('h_i', 'h_j')}, CASE WHEN abs(h_i) > 1e-12 THEN round(mi / h_i, 6) + 0.0 ELSE 0 END AS u_i, CASE WHEN abs(h_j) > 1e-12 THEN round(mi / h_j, 6) + 0.0 ELSE 0 END AS u_j FROM Y")
def _(spark, d):
    return states.mutual_information(joint(spark, d)).select("mid", "channel_i", "channel_j", "h_i", "h_j", "u_i", "u_j")


@query("pmf_kl", f"WITH {STEPS} SELECT lab, laser, n, round(fwd, 6) + 0.0 AS forma_fwd, round(bwd, 6) + 0.0 AS forma_bwd FROM ST")
def _(spark, d):
    return steps(spark, d)


@query("kl_recompute", f"WITH {STEPS} SELECT lab, laser, n, round(fwd, 6) + 0.0 AS forma_fwd, round(bwd, 6) + 0.0 AS forma_bwd, {r6('s_forma', 'pct_forma', 'g_raw', 'g_norm')} FROM R")
def _(spark, d):
    return results(spark, d)


N_MIN = ", RN AS (SELECT * FROM R WHERE n <= (SELECT min(m) FROM (SELECT max(n) AS m FROM R GROUP BY lab, laser)))"


@query("loc_abs_iqr", f"WITH {STEPS}{N_MIN} SELECT lab, n, round(quantile_cont(g_norm, 0.5), 6) + 0.0 AS loc, round(quantile_cont(g_norm, 0.75) - quantile_cont(g_norm, 0.25), 6) + 0.0 AS iqr, round(quantile_cont(s_forma, 0.5), 6) + 0.0 AS abs FROM RN GROUP BY ALL")
def _(spark, d):
    return inference.location_spread(inference.long_table(results(spark, d), ["forma"]))


@query("dominance", f"WITH {STEPS}{N_MIN}, T AS (SELECT *, CAST(g_norm = max(g_norm) OVER (PARTITION BY laser, n) AS INTEGER) AS top FROM RN), Vt AS (SELECT *, top / sum(top) OVER (PARTITION BY laser, n) AS vote FROM T) SELECT lab, n, round(sum(vote), 6) + 0.0 AS dom FROM Vt GROUP BY ALL")
def _(spark, d):
    return inference.dominance(results(spark, d))


@query("n_min", f"WITH {STEPS}, A AS (SELECT lab, laser, max(n) AS m FROM R GROUP BY ALL) SELECT min(m) AS n_min FROM A")
def _(spark, d):
    return inference.n_min(results(spark, d))


@query("bh_fdr", f"WITH {MET}, P AS (SELECT CAST(mid AS INTEGER) AS n, round(1 / (1 + min(score)), 6) AS p FROM MET GROUP BY mid), K AS (SELECT *, row_number() OVER (ORDER BY p, n) AS r, count(*) OVER () AS m FROM P) SELECT n, p + 0.0 AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 6) + 0.0 AS q FROM K")
def _(spark, d):
    p = metrics(spark, d).groupBy(F.col("mid").cast("int").alias("n")).agg(F.round(1 / (1 + F.min("score")), 6).alias("p"))
    return inference.bh_fdr(p)


@query("perm_test")
def _(spark, d):
    return tests_of(spark, d)


@query("inference_summary")
def _(spark, d):
    return inference.summarize(tests_of(spark, d))


@query("top_transitions")
def _(spark, d):
    return inference.top_share(tests_of(spark, d))


@query("transition_labels", f"WITH {EV}, T AS (SELECT lab, fecha, CAST(date_diff('day', DATE '1970-01-01', fecha) AS INTEGER) AS m, min(ts) AS t_first FROM EV GROUP BY ALL), Z AS (SELECT *, lead(m) OVER w AS \"to\", lead(t_first) OVER w AS t_to FROM T WINDOW w AS (PARTITION BY lab ORDER BY m)) SELECT * FROM Z WHERE \"to\" = m + 1")
def _(spark, d):
    e = views.event_signal(spark, d).groupBy("lab", "fecha").agg(F.min("ts").alias("t_first")).withColumn("m", F.unix_date("fecha"))
    return inference.transition_labels(e, ("lab",))


@query("time_bounds", f"WITH {EV} SELECT lab, laser, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, count(*) AS n FROM EV GROUP BY ALL")
def _(spark, d):
    return shaping.time_bounds(views.event_signal(spark, d), ["lab", "laser"], ["ts", "event_id"], "value")


@query("spectral_energy", f"WITH {DFT}, B AS (SELECT mid, channel, CAST(least(7, floor(f * 8 / 32)) AS INTEGER) AS band, sum(e) AS e FROM SPEC GROUP BY ALL) SELECT mid, channel, band, round(e, 6) + 0.0 AS e, round(e / sum(e) OVER (PARTITION BY mid, channel), 6) + 0.0 AS prob FROM B")
def _(spark, d):
    return states.bands(spectra(spark, d), 8)


@query("spectral_entropy_modal", f"WITH {DFT}, Z AS (SELECT mid, channel, e / sum(e) OVER (PARTITION BY mid, channel) AS p FROM SPEC WHERE f > 0) SELECT mid, channel, round(sum(-p * log2(p)), 6) + 0.0 AS h, count(*) AS n_modes FROM Z GROUP BY ALL")
def _(spark, d):
    return states.modal_entropy(spectra(spark, d))


@query("top_modes", f"WITH {DFT}, Z AS (SELECT *, CAST(row_number() OVER (PARTITION BY mid, channel ORDER BY round(e, 9) DESC, f) AS INTEGER) AS r FROM SPEC WHERE f > 0) SELECT mid, channel, f, {r6('e')}, r FROM Z WHERE r <= 3")
def _(spark, d):
    return states.top_modes(spectra(spark, d), 3)


@query("downsample", f"WITH {SIG}, N AS (SELECT *, count(*) OVER (PARTITION BY mid, channel) AS k FROM SIG WHERE channel = 'l_quantity'), G AS (SELECT DISTINCT mid, CASE WHEN k <= 100 THEN i ELSE CAST(floor(i * (k - 1) / 99.0) AS BIGINT) END AS idx FROM N, range(100) r(i)) SELECT mid, idx, {r6('value')} FROM N SEMI JOIN G USING (mid, idx)")
def _(spark, d):
    return shaping.downsample(views.signal(spark, d, ("l_quantity",)), 100).select("mid", "idx", "value")


@query("minmax_normalize", f"WITH {SIG}, N AS (SELECT mid, channel, idx, (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) AS s FROM SIG WINDOW w AS (PARTITION BY mid, channel)) SELECT mid, channel, idx, round(coalesce(s, 0), 6) + 0.0 AS scaled FROM N")
def _(spark, d):
    return shaping.minmax(views.signal(spark, d)).select("mid", "channel", "idx", "scaled")


@query("mid_build", "SELECT o_orderkey, printf('%s_%s_%03d', strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, CAST(o_orderkey % 1500 AS INTEGER)) AS mid FROM orders")
def _(spark, d):
    o = views.table(spark, d, "orders")
    return o.select("o_orderkey", S.mid(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.col("o_orderkey") % 1500).alias("mid"))


@query("redaction", "SELECT c_custkey, CASE WHEN trim(c_mktsegment) <> '' THEN 'REDACTED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", S.redacted(F.col("c_mktsegment")).alias("c_mktsegment"))


@query("role_parse_ratio", "WITH C AS (SELECT source, trim(c) AS c FROM (SELECT source, unnest(string_split(text, ' ')) AS c FROM documents)) SELECT source, count(*) AS n, 0.0::DOUBLE AS time_ratio, round(avg(CASE WHEN regexp_matches(c, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS number_ratio FROM C GROUP BY source")
def _(spark, d):
    cells = views.table(spark, d, "documents").select("source", F.explode(F.split("text", " ")).alias("c"))
    return shaping.parse_ratio(cells, ["source"], F.col("c"))


@query("schema_rollup", "WITH L AS (SELECT mid, lab, string_agg(channel, '|' ORDER BY channel) AS c FROM (SELECT DISTINCT CAST(fecha AS VARCHAR) || lab AS mid, lab, CAST(laser AS VARCHAR) AS channel FROM (SELECT CAST(ts AS DATE) AS fecha, event_type AS lab, user_id % 6 + 1 AS laser FROM events)) GROUP BY ALL) SELECT lab, count(*) AS n_files, count(DISTINCT md5(c)) AS n_schemas, count(DISTINCT md5(c)) = 1 AS consistent FROM L GROUP BY lab")
def _(spark, d):
    e = views.event_signal(spark, d).select("lab", F.concat(F.col("fecha").cast("string"), "lab").alias("mid"), F.col("laser").cast("string").alias("c"))
    return shaping.schema_rollup(e.groupBy("lab", "mid").agg(F.array_sort(F.collect_set("c")).alias("columns")), ["lab"])


@query("label_precedence", """WITH L AS (SELECT c_custkey AS row_no, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS lab, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey % 50 AS VARCHAR) END AS mid FROM customer),
A AS (SELECT lab, mid, arg_max(label, row_no) AS label FROM L WHERE lab IS NOT NULL AND mid IS NOT NULL GROUP BY ALL), B AS (SELECT mid, arg_max(label, row_no) AS label FROM L WHERE lab IS NULL AND mid IS NOT NULL GROUP BY ALL)
SELECT s.s_suppkey, s.lab, s.mid, coalesce(A.label, B.label, 'UNK') AS label FROM (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS lab, CAST(s_suppkey % 70 AS VARCHAR) AS mid FROM supplier) s LEFT JOIN A ON A.lab = s.lab AND A.mid = s.mid LEFT JOIN B ON B.mid = s.mid""")
def _(spark, d):
    c = views.table(spark, d, "customer")
    labels = c.select(F.col("c_custkey").alias("row_no"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).alias("lab"), F.when(F.col("c_custkey") % 3 < 2, (F.col("c_custkey") % 50).cast("string")).alias("mid"))
    rows = views.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("lab"), (F.col("s_suppkey") % 70).cast("string").alias("mid"))
    return shaping.label_precedence(rows, labels, [["lab", "mid"], ["mid"]])


@query("file_resolution", """WITH C AS (SELECT CAST(c_nationkey AS VARCHAR) AS fecha, CAST(c_custkey % 3 AS VARCHAR) AS lab, CAST(c_custkey % 10 AS VARCHAR) AS i, c_custkey % 7 AS v, c_mktsegment AS color FROM customer),
L AS (SELECT DISTINCT fecha, lab, CASE v WHEN 0 THEN i || 'medRed.csv' WHEN 1 THEN '0' || i || 'medRed.csv' WHEN 2 THEN '00' || i || 'medred.csv' WHEN 3 THEN i || 'MED' || color || '.CSV' WHEN 4 THEN i || 'x.csv' WHEN 5 THEN fecha || '_' || lab || '_00' || i || '.csv' ELSE i || 'medRed.txt' END AS name FROM C),
M AS (SELECT *, fecha || '_' || lab || '_00' || i AS mid FROM (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS fecha, CAST(s_suppkey % 3 AS VARCHAR) AS lab, CAST(s_suppkey % 10 AS VARCHAR) AS i FROM supplier)),
X AS (SELECT s_suppkey, name, CASE WHEN name = M.i || 'medRed.csv' THEN 0 WHEN name = mid || '.csv' THEN 1 WHEN name = '0' || M.i || 'medRed.csv' THEN 2 WHEN name = '00' || M.i || 'medRed.csv' THEN 3 WHEN name = '0' || M.i || 'medred.csv' THEN 4 WHEN name = '00' || M.i || 'medred.csv' THEN 5 END AS step FROM M JOIN L USING (fecha, lab)
   UNION ALL SELECT s_suppkey, min(name), 6 FROM M JOIN L USING (fecha, lab) WHERE lower(name) LIKE '%.csv' AND starts_with(lower(name), i || 'med') GROUP BY s_suppkey HAVING count(*) = 1
   UNION ALL SELECT s_suppkey, min(name), 7 FROM M JOIN L USING (fecha, lab) WHERE lower(name) LIKE '%.csv' AND TRY_CAST(regexp_extract(name, '^[0-9]+') AS INTEGER) = CAST(i AS INTEGER) GROUP BY s_suppkey HAVING count(*) = 1),
B AS (SELECT s_suppkey, arg_min(name, step) AS name, min(step) AS step FROM X WHERE step IS NOT NULL GROUP BY s_suppkey)
SELECT M.s_suppkey, B.name AS found_name, CASE WHEN step = 0 THEN 'expected' WHEN step > 0 THEN 'compat_found' WHEN (M.fecha, M.lab) IN (SELECT (fecha, lab) FROM L) THEN 'missing' ELSE 'missing_dir' END AS resolve_tag FROM M LEFT JOIN B USING (s_suppkey)""")
def _(spark, d):
    c = views.table(spark, d, "customer")
    fecha, lab, i = F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 3).cast("string"), (F.col("c_custkey") % 10).cast("string")
    kinds = [F.concat(i, F.lit("medRed.csv")), F.concat(F.lit("0"), i, F.lit("medRed.csv")), F.concat(F.lit("00"), i, F.lit("medred.csv")), F.concat(i, F.lit("MED"), "c_mktsegment", F.lit(".CSV")), F.concat(i, F.lit("x.csv")), F.concat(S.mid(fecha, lab, i), F.lit(".csv")), F.concat(i, F.lit("medRed.txt"))]
    name = F.get(F.array(*kinds), (F.col("c_custkey") % 7).cast("int"))
    listing = c.select(fecha.alias("fecha"), lab.alias("lab"), name.alias("name")).withColumn("path", F.concat_ws("/", "fecha", "lab", "name"))
    s = views.table(spark, d, "supplier")
    rows = s.select("s_suppkey", F.col("s_nationkey").cast("string").alias("fecha"), (F.col("s_suppkey") % 3).cast("string").alias("lab"), (F.col("s_suppkey") % 10).cast("int").alias("archivo"), F.lit("Red").alias("color"))
    rows = rows.withColumn("mid", S.mid(F.col("fecha"), F.col("lab"), F.col("archivo")))
    rows = rows.withColumn("filename_expected", ladders.expected_name(F.col("mid"), F.col("archivo"), F.col("color"), blind=False))
    return ladders.resolve_files(rows, listing).select("s_suppkey", "found_name", "resolve_tag")


from . import catalog_levels, catalog_reports, catalog_runs  # noqa: E402, F401  add the queries between the levels and those of runs and reports
