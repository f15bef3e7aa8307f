"""Bins specs of both layouts, seeded block starts, archives with dates and laboratories."""

import io
import json
import zipfile

import numpy as np
import pytest

from tessera.operators import states
from tessera.sources import raw, specs

GOOD = {"laser": " A ", "amplitude_edges": [0, 1, 2.5], "increment_edges": [-1, 1]}
OLD = {"laser": "A", "amplitude": {"edges": [0, 1, 2.5], "clip_out_of_range": False}, "increments": {"edges": [-1, 1], "clip_out_of_range": None}}


def parse(spark, *texts):
    rows = spark.createDataFrame([(str(i), t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "path string, text string")
    return specs.parsed(rows)


def test_both_layouts(spark):
    now = {"schema_version": "2.0", "channels": [{**GOOD, "amplitude_edges": [7, 8]}, GOOD, {"laser": "B", "amplitude_edges": [0, 1], "increment_edges": [0, 1], "coupling_edges": [0, 2], "spectral": {"freq_edges": [0, 0.5], "fs": 2}}, {"x": 1}, 5], "spectral": {"freq_edges": [0, 9], "fs": 10, "freq_unit": "Hz"}, "bins": [{"laser": "A", "amplitude": {"clip_out_of_range": False}}]}
    then = {"bins": [OLD, {**OLD, "laser": "B", "spectral": {"freq_edges": [0, 1], "fs_hz": "3"}}], "spectral": {"freq_edges": [0, 4], "fs": 8}}
    got = {(r.path, r.channel): r for r in parse(spark, now, then).collect()}
    assert set(got) == {("0", "A"), ("0", "B"), ("1", "A"), ("1", "B")} and all(r.problem is None for r in got.values())
    a, b, c, d = (got[k] for k in sorted(got))
    assert (a.layout, a.amplitude, a.increment, a.coupling, a.spectral, a.fs, a.unit) == ("channels", [0, 1, 2.5], [-1, 1], None, [0, 9], 10, "Hz")
    assert (a.amplitude_clip, a.increment_clip, a.coupling_clip) == (False, True, True)
    assert (b.coupling, b.spectral, b.fs, b.unit, b.amplitude_clip) == ([0, 2], [0, 0.5], 2, "Hz", True)
    assert (c.layout, c.amplitude, c.spectral, c.fs, c.amplitude_clip, c.increment_clip, c.coupling_clip) == ("bins", [0, 1, 2.5], [0, 4], 8, False, False, True)
    assert (d.spectral, d.fs) == ([0, 1], 3)


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ("no json", "not_json"),
        ("[1]", "no_channels"),
        ({"schema_version": "2.0", "channels": []}, "no_channels"),
        ({"schema_version": "2.0", "channels": [{"laser": " "}, 3]}, "no_channels"),
        ({"schema_version": "1.0", "channels": [GOOD]}, "no_channels"),
        ({"schema_version": "2.0", "channels": [{"laser": "A", "increment_edges": [0, 1]}]}, "amplitude: too_few"),
        ({"schema_version": "2.0", "channels": [{**GOOD, "amplitude_edges": [1]}]}, "amplitude: too_few"),
        ({"schema_version": "2.0", "channels": [{**GOOD, "amplitude_edges": [[0, 1], [1, 2]]}]}, "amplitude: not_finite"),
        ({"schema_version": "2.0", "channels": [{**GOOD, "increment_edges": [0, None, 1]}]}, "increment: not_finite"),
        ({"schema_version": "2.0", "channels": [{**GOOD, "coupling_edges": [0, 0]}]}, "coupling: not_increasing"),
        ({"schema_version": "2.0", "channels": [{**GOOD, "spectral": {"freq_edges": "x"}}]}, "spectral: too_few"),
        ({"schema_version": "2.0", "channels": [{**GOOD, "spectral": {"fs": "x"}}]}, "fs: not_a_number"),
        ({"bins": [{**OLD, "amplitude": {"edges": [2, 1]}}]}, "amplitude: not_increasing"),
    ],
)
def test_bad_specs(spark, text, problem):
    rows = parse(spark, text)
    assert [r.problem for r in rows.collect()] == [problem]
    with pytest.raises(Exception, match=problem.split(": ")[-1]):
        specs.checked(rows).collect()


def test_spec_files(spark, tmp_path):
    contract = spark.createDataFrame([("b", [0.1, 2.0], [-1.0, 0.0, 1.0], [0.0, 1.0]), ("a", [0.0, 1 / 3], [0.0, 1.0], None)], "channel string, amplitude array<double>, increment array<double>, coupling array<double>")
    (tmp_path / "s.json").write_text(specs.to_text(contract).first().text)
    back = specs.checked(specs.parsed(specs.read_specs(spark, f"{tmp_path}/s.json")))
    want = {r.channel: (r.amplitude, r.increment, r.coupling) for r in contract.collect()}
    assert {r.channel: (r.amplitude, r.increment, r.coupling) for r in back.collect()} == want
    assert [r.channel for r in specs.edges_of(back, "coupling").collect()] == ["b"]
    assert specs.parsed(specs.read_specs(spark, f"{tmp_path}/s.json").limit(0)).count() == 0


def test_seeded_blocks(spark):
    x = np.random.default_rng(5).normal(size=500)
    v = spark.createDataFrame([(1, "c", x.tolist()), (2, "c", x.tolist()), (3, "c", x[:66].tolist()), (4, "c", x[:63].tolist())], "mid int, channel string, samples array<double>")
    got = {r.mid: r.power for r in states.psd(v, 64, blocks=8, window="hann", selection="random", detrend=False).collect()}
    again = {r.mid: r.power for r in states.psd(v.repartition(3), 64, blocks=8, window="hann", selection="random", detrend=False).collect()}

    def want(y, starts):
        return np.mean([np.abs(np.fft.rfft(y[s : s + 64] * np.hanning(64))) ** 2 / 64 for s in starts], axis=0)

    assert got == again and got[1] != got[2] and got[4] is None
    assert all(np.allclose(got[i], want(x, states.block_starts(500, 64, 8, "random", f"{i}|c"))) for i in (1, 2))
    assert np.allclose(got[3], want(x[:66], [0, 1, 2]))
    assert {r.mid: r.power for r in states.psd(v, 64, blocks=2, min_blocks=3).collect()} == dict.fromkeys((1, 2, 3, 4))
    assert states.block_starts(66, 64, 4) == [0, 1, 1, 2] and states.block_starts(64, 64, 4) == [0]
    for bad in ({"window": "x"}, {"selection": "x"}):
        with pytest.raises(ValueError, match="unknown"):
            states.psd(v, 64, **bad)


def packed(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_inherit(spark):
    inner = packed(("csv_raw/1.csv", "one"), ("csv_raw/2026-03-07/2.csv", "two"), ("other/3.csv", "no"), ("csv_raw/4.txt", "no"))
    deep = packed(("north/2026-03-2_3.zip", packed(("in.zip", inner))), ("bad.zip", b"broken"), ("csv_raw/2026-02-30.csv", "x"))
    spoilt = bytearray(packed(("csv_raw/2026-01-01.csv", "abc" * 500)))
    spoilt[45:60] = b"\xff" * 15
    files = spark.createDataFrame([("top.zip", deep), ("South 2025-12-31.zip", inner), ("spoilt.zip", bytes(spoilt)), ("none.zip", None), ("no", b"x")], "path string, content binary")
    rows = raw.organised(raw.archive_members(files, {"north": "N", "south": "S"})).collect()
    got = {r.path: (r.date, r.lab, r.status, bytes(r.content) if r.content is not None else None) for r in rows}
    assert got == {
        "top.zip/north/2026-03-2_3.zip/in.zip/csv_raw/1.csv": ("02Mar26", "N", "ok", b"one"),
        "top.zip/north/2026-03-2_3.zip/in.zip/csv_raw/2026-03-07/2.csv": ("07Mar26", "N", "ok", b"two"),
        "top.zip/bad.zip": (None, "Unknown", "damaged", None),
        "top.zip/csv_raw/2026-02-30.csv": (None, "Unknown", "undated", b"x"),
        "South 2025-12-31.zip/csv_raw/1.csv": ("31Dec25", "S", "ok", b"one"),
        "South 2025-12-31.zip/csv_raw/2026-03-07/2.csv": ("07Mar26", "S", "ok", b"two"),
        "spoilt.zip/csv_raw/2026-01-01.csv": ("01Jan26", "Unknown", "damaged", None),
        "none.zip": (None, "Unknown", "damaged", None),
        "no": (None, "Unknown", "damaged", None),
    }
    assert {r.target for r in rows if r.status == "ok"} == {"Mar26/02Mar26/N/Raw Data/1.csv", "Mar26/07Mar26/N/Raw Data/2.csv", "Dec25/31Dec25/S/Raw Data/1.csv", "Mar26/07Mar26/S/Raw Data/2.csv"}
    assert {r.status for r in raw.organised(raw.archive_members(files.limit(0), {})).collect()} == set()
    twice = raw.organised(raw.archive_members(spark.createDataFrame([("2025-01-01.zip", inner), ("a2025-01-01.zip", inner)], "path string, content binary"), {})).collect()
    assert sorted((r.path[0], r.status) for r in twice) == [("2", "replaced"), ("2", "replaced"), ("a", "ok"), ("a", "ok")]
