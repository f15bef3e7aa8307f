"""Transition labels, chart data, reports as lines, schema groups, profiles over metrics: nulls, ties, repeated rows, empty tables."""

import numpy as np
import pytest

from tessera.operators import profiles, reports, shaping

MEASURED = "lab string, date string, m_idx int, mid string, t_start string, t_end string"
ROWS = [("L", "d1", 1, "a", "08", "09"), ("L", "d1", 2, "b", "10", None), ("L", "d1", 3, "c", None, "13"), ("L", "d1", 5, "e", "14", "15"), ("L", "d1", None, "x", "1", "2"), (None, "d1", 6, "y", "1", "2"), ("M", "d0", 2, "p", "1", "2"), ("M", "d0", 1, "q", "3", "4"), ("M", "d0", 1, "o", "5", "6")]


def test_transition_times(spark):
    got = {(r.lab, r.d, r.n): (r.mid_from, r.mid_to, r.label_start, r.label_range, r.t_from_end, r.t_to_start) for r in reports.transition_times(spark.createDataFrame(ROWS, MEASURED)).collect()}
    assert got == {("L", "d1", 1): ("a", "b", "08", None, "09", "10"), ("L", "d1", 2): ("b", "c", "10", "10 → 13", None, None), ("M", "d0", 1): ("q", "p", "3", "3 → 2", "4", "1")}
    assert reports.transition_times(spark.createDataFrame([], MEASURED)).count() == 0


def test_labels_of_a_report(spark):
    times = reports.transition_times(spark.createDataFrame(ROWS, MEASURED))
    report = spark.createDataFrame([("L", "d1", "1", 7), ("L", "d1", "2.0", 8), ("L", "d2", "1", 9), ("L", "d1", "x", 1), (None, "d1", "1", 2), ("L", "d1", "1", 7)], "lab string, d string, n string, transition int")
    got = sorted(((r.n, r.n_original, r.transition_range) for r in reports.labelled(report, times).collect()), key=str)
    assert got == sorted([("08", 1, None)] * 2 + [("10", 2, "10 → 13")] + [(None, 1, None)] * 2 + [(None, None, None)], key=str)
    assert [(r.n, r.lab) for r in reports.slots(times).collect()] == [(1, "M")]
    assert sorted(r.n for r in reports.slots(times, "d1").collect()) == [1, 2]
    flat = spark.createDataFrame([(1, 0.5), (9, 0.1)], "n int, p double")
    got = {(r.n, r.n_original, r.transition) for r in reports.labelled(flat, reports.slots(times), ("n",), replace=False).collect()}
    assert got == {(1, 1, "3"), (9, 9, None)}
    assert reports.labelled(report.limit(0), times).count() == 0 and reports.slots(times.limit(0)).count() == 0


def test_bars(spark):
    rows = [("L", 1, "1", "b", "2"), ("L", 1, "1", "b", "4"), ("L", 1, "1", "a", "7"), ("L", 1, "x", "a", "7"), ("L", 1, "1", None, "7"), ("L", 1, "1", "c", "NaN")]
    got = {(r.d, r.n, r.height, r.place) for r in reports.bars(spark.createDataFrame(rows, "lab string, laser int, n string, d string, g_norm string")).collect()}
    assert got == {("a", 1, 7.0, 1), ("b", 1, 3.0, 2)}


def test_quality_summary(spark, tmp_path):
    shape = "mid string, fecha string, lab string, score double, passed boolean, reason string"
    rows = spark.createDataFrame([("a", "d", "L", 5.0, True, None), ("b", None, "L", 1.0, False, None), (None, "d", None, 1.0, False, None), ("c", "d", "L", None, None, "gone")], shape)
    out = reports.quality_summary(rows, 4, worst=2)
    text = [r.line for r in out.orderBy("section", "i").collect()]
    assert text == ["Quality summary, threshold 4.00", "Files scored: 3", "Passed: 1", "Failed: 2", "Skipped: 1", "Skipped by reason", "- gone: 1", "Worst scores (up to 2)", "- UNK | d UNK | score 1.000", "- b | UNK L | score 1.000", "Laboratories", "- L | mean score 3.000 | files 2", "- UNK | mean score 1.000 | files 1"]
    none = [r.line for r in reports.quality_summary(rows.limit(0), 4).orderBy("section", "i").collect()]
    assert none.count("- (none)") == 3 and "Files scored: 0" in none
    reports.lines_to(out, f"{tmp_path}/r", ["section", "i"])
    assert "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "r").glob("part-*")) if p.stat().st_size) == "\n".join(text)


def test_tex_table(spark):
    rows = spark.createDataFrame([(2, "a_b\\c"), (1, None), (None, "5 % & #$")], "k int, some_text string")
    lines = [r.line for r in reports.tex_table(rows, ["k"], "A_b", "x").orderBy("part", "i", "k").collect()]
    assert lines == [r"\begin{longtable}{ll}", r"\caption{A\_b} \label{x} \\", r"k & some\_text \\ \hline", r" & 5 \% \& \#\$ \\", r"1 &  \\", r"2 & a\_b/c \\", r"\end{longtable}"]


def test_schema_groups(spark):
    files = spark.createDataFrame([(1, "d", "L", "B", ["t", "a"]), (2, "d", "L", "A", ["a", "t"]), (3, "d", "L", "A", None), (4, "d", "M", "UNK", ["t", "a"]), (5, "d", "M", None, ["t", "a"])], "mid int, fecha string, lab string, label string, columns array<string>")
    want = spark.createDataFrame([(i, ["t", "a"]) for i in (1, 2, 3, 4, 4)], "mid int, columns array<string>")
    got = {r.lab: tuple(r)[2:] for r in shaping.schema_groups(shaping.schema_checks(files, want)).collect()}
    assert got == {"L": (3, 1, 2, 3, False, True, "A,B"), "M": (2, 1, 1, 1, True, False, "")}


def test_metrics_of_profiles(spark):
    rng = np.random.default_rng(4)
    data = {(f, m, i, k): float(rng.normal() + 3) for f in "ab" for m in range(3) for i in range(1, 4) for k in ("p", "q")}
    data |= {("c", 0, 1, "p"): 1.0}
    base = spark.createDataFrame([(f, "L", str(m), i, k, v) for (f, m, i, k), v in data.items()], "fecha string, lab string, mid string, laser int, metric string, v double")
    prof = {(f, k): np.array([np.mean([data[f, m, i, k] for m in range(3)]) for i in range(1, 4)]) for f in "ab" for k in "pq"}
    r = profiles.pairwise_metrics(base, ["p", "q"]).collect()
    assert len(r) == 1 and (r[0].a, r[0].b, r[0].n_a, r[0].n_b) == ("a", "b", 3, 3)
    corr = {k: np.corrcoef(prof["a", k], prof["b", k])[0, 1] for k in "pq"}
    assert r[0]["p__corr"] == pytest.approx(corr["p"]) and r[0]["mean_corr"] == pytest.approx(np.mean(list(corr.values())))
    ratio = {f: prof[f, "q"].max() / prof[f, "q"].min() for f in "ab"}
    assert r[0]["q__anisotropy_delta"] == pytest.approx(ratio["b"] - ratio["a"])
    own = {x.fecha: x for x in profiles.metrics_summary(base, ["p", "q"]).collect()}
    assert own["a"]["q__profile_mean"] == pytest.approx(prof["a", "q"].mean()) and own["c"]["q__profile_mean"] is None and own["c"]["mean_profile_mean"] == 1.0
    pairs = [np.corrcoef([data["b", m, i, "p"] for m in range(3)], [data["b", m, j, "p"] for m in range(3)])[0, 1] for i, j in ((1, 2), (1, 3), (2, 3))]
    assert own["b"]["p__pair_corr"] == pytest.approx(np.mean(pairs)) and own["c"].mean_pair_corr is None and own["c"].n_measurements == 1
