"""Runs with statuses: each reason, empty tables, repeated rows, nulls, counts in the same pass."""

import pytest

from tessera.config import QualityPolicy
from tessera.operators import runners

POLICY = QualityPolicy(min_channels=2, threshold_pass=5.0)
QUEUE = "mid string, parquet_path string, note string"
FILES = "parquet_path string, readable boolean, n_channels int"
METRICS = "mid string, channel string, score double, status string, pct_out double"
SCHEMA = "mid string, schema_ok string"


def test_quality_run(spark):
    queue = spark.createDataFrame([(m, f"p{m}", "x") for m in "abcdefg"] + [(None, "pa", "x"), ("a", "pa", "twice"), ("h", None, "x")], QUEUE)
    files = spark.createDataFrame([("pa", True, 3), ("pb", True, 2), ("pd", False, None), ("pe", True, 0), ("pf", True, 2), ("pa", True, 3), ("pg", True, None)], FILES)
    rows = [("a", "1", 8.0, "ok", 0.0), ("a", "2", 4.0, "ok", 0.0), ("a", "3", 0.0, "ok", 50.0), ("b", "1", 9.0, "ok", 0.0), ("b", "2", None, "insufficient_samples", 0.0)]
    metrics = spark.createDataFrame(rows, METRICS)
    schema = spark.createDataFrame([(m, "no" if m == "f" else "ok") for m in "abcdefg"] + [("f", None)], SCHEMA)
    run = lambda *a: sorted(((r.mid, r.note, r.reason, r.status, r.n_channels, r.n_used, r.n_invalid, r.score, r.passed) for r in runners.quality_run(*a, p=POLICY).collect()), key=str)
    fail = lambda m, why: (m, "x", why, "FAIL", None, None, None, None, None)
    want = [("a", "x", None, "OK", 3, 2, 1, 6.0, True), ("a", "twice", None, "OK", 3, 2, 1, 6.0, True), ("b", "x", None, "OK", 2, 1, 1, 9.0, False), fail("c", "parquet_missing"), fail("d", "parquet_read_error"), fail("e", "no_channel_columns"), fail("g", "no_channel_columns")]
    gated = [fail("f", "schema_not_ok"), fail("h", "schema_not_ok"), fail(None, "schema_not_ok")]
    assert run(queue, files, metrics, schema) == sorted(want + gated, key=str)
    free = [("f", "x", None, "OK", 2, 0, 2, 0.0, False), fail("h", "parquet_missing"), fail(None, "parquet_missing")]
    assert run(queue, files, metrics) == run(queue, files, metrics, schema.limit(0)) == sorted(want + free, key=str)
    assert run(queue.limit(0), files, metrics, schema) == []
    assert {r[2] for r in run(queue, files.limit(0), metrics.limit(0))} == {"parquet_missing"}


def test_counts_in_one_pass(spark):
    rows, seen = runners.watched(spark.createDataFrame([("ok",), ("ok",), (None,), ("x",)], "status string"), ["ok", "error"])
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 4, "ok": 2, "error": 0}


def test_table_run(spark):
    plan = spark.createDataFrame([("a", "ra"), ("b", "rb"), ("c", "rc"), ("d", "rd"), (None, None)], "mid string, raw_path string")
    have = spark.createDataFrame([("a",), ("a",)], "mid string")
    raw = spark.createDataFrame([("ra",), ("rc",), ("rd",), ("rd",)], "raw_path string")
    wrong = spark.createDataFrame([("c", "roles"), ("c", "bounds"), ("a", "bounds")], "mid string, error string")
    run = lambda *a: {r.mid: (r.error, r.status) for r in runners.table_run(plan, have, raw, wrong, *a).collect()}
    want = {"a": ("bounds", "skipped_exists"), "b": (None, "skipped_missing_raw"), "c": ("bounds", "error"), "d": (None, "ok"), None: (None, "skipped_missing_raw")}
    assert run() == want and run(True) == want | {"a": ("bounds", "error")}
    assert runners.table_run(plan.limit(0), have, raw, wrong).count() == 0


def test_preflight_report(spark):
    queue = spark.createDataFrame([("d1", " L2", "p1"), ("d1", "L1", "p2"), ("d2", " ", "p2"), (None, None, None)], "fecha string, lab string, parquet_path string")
    listing = spark.createDataFrame([("p1",), ("p1",)], "parquet_path string")
    r = runners.ready(runners.preflight_report(queue, listing)).first()
    assert (r.ok, r.errors, r.warnings, r.n, r.n_dates, r.labs, r.n_paths, r.n_missing) == (True, [], ["1 of 2 paths are missing: p2"], 4, 2, ["L1", "L2"], 2, 1)
    bare = runners.preflight_report(queue.select("fecha").limit(0), listing, alpha=1.0)
    r = bare.first()
    assert (r.ok, r.errors, r.warnings, r.n, r.n_missing) == (False, ["missing column lab", "missing column parquet_path", "alpha must be in (0, 1)"], ["the queue is empty"], 0, 0)
    with pytest.raises(Exception, match="missing column lab"):
        runners.ready(bare).collect()


def test_reference_rows(spark):
    queue = spark.createDataFrame([(" d1", "p"), ("d2", "p"), ("d1", None), (None, "p")], "fecha string, parquet_path string")
    assert runners.reference_rows(queue).count() == 3
    assert [r.fecha for r in runners.reference_rows(queue, "unk", ["d1 "]).collect()] == ["d1"]
    with pytest.raises(runners.RunError):
        runners.reference_rows(queue, "CTRL")
