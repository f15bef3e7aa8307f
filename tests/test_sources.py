import io
import zipfile

import pytest

from tessera.sources import raw
from tessera.streaming.windows import windowed_metrics


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    d = root / "03Ene24" / "LAB1" / "Raw Data"
    d.mkdir(parents=True)
    lines = ["Time;Time 2;A;B"] + [f"10:00:{i:02d};00:00:{i:02d};{i}.5;{-111.0 if i == 3 else i}" for i in range(20)] + ["", "short;row"]
    (d / "01medrojo.csv").write_text("﻿" + "\n".join(lines))
    (d / "zz.csv").write_text("a,b\n" + "\n".join(f"{i},{i},x" for i in range(12)))
    return str(root)


def test_raw_tree(spark, tree):
    files = raw.discover(spark, tree)
    ids = {r.name: (r.mid, r.color) for r in raw.plan(files).collect()}
    assert ids == {"01medrojo.csv": ("03Ene24_LAB1_001", "rojo"), "zz.csv": ("03Ene24_LAB1_002", None)}
    lines = raw.lines_of(files).cache()
    found = {r.path.rsplit("/", 1)[1]: r for r in raw.dialect(lines).collect()}
    assert found["01medrojo.csv"].delimiter == ";" and found["01medrojo.csv"].bad_rows == 2
    assert found["zz.csv"].extra_field and found["zz.csv"].extra_value == "x"
    data = raw.cells(lines)
    role = raw.roles(data)
    names = {r.name: r.role for r in role.where("path like '%rojo%'").collect()}
    assert names == {"Time": "t_sys", "Time 2": "t_rel", "A": "channel", "B": "channel"}
    table = raw.signal_table(data, role).where("path like '%rojo%'").collect()
    assert len(table) == 40 and [r.value for r in table if r.channel == "Laser_2" and r.idx == 3] == [None]
    with pytest.raises(raw.DiscoveryError):
        raw.discover(spark, tree, labs=["none"])


def test_archives(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("csv_raw/1med.csv", "a")
        z.writestr("other/2med.csv", "b")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
    rows = raw.unzip(spark.createDataFrame([("p", outer.getvalue()), ("q", b"bad")], "path string, content binary")).collect()
    assert [(r.path, bytes(r.content)) for r in rows] == [("p/in.zip/csv_raw/1med.csv", b"a")]


def test_windows(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = windowed_metrics(e, keys=("event_type",), size="1 day")
    assert rows.agg({"n": "sum"}).first()[0] == e.count()
