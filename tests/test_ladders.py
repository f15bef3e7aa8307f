import pytest

from tessera.sources import ladders

FILES = [("d1", "L", n) for n in ("1medred.csv", "02medred.csv", "3medblue.csv", "d1_L_004.csv", "5x.csv", "6a.csv", "06b.csv", "007medred.csv", "8med.txt")]


@pytest.fixture
def listing(spark):
    return spark.createDataFrame([(d, lab, n, f"/r/{d}/{lab}/Raw Data/{n}") for d, lab, n in FILES], "fecha string, lab string, name string, path string")


def manifest(spark):
    rows = [("d1", "L", str(i), "red", "Exp", None) for i in range(1, 9)] + [("d2", "L", "1", "red", None, "LB"), ("d1", "L", "x", " ", None, None), ("d1", "L", "1", "red", "Exp", None)]
    return spark.createDataFrame(rows, "fecha string, lab string, archivo string, color string, jornada string, etiqueta string")


def test_catalog(spark, listing):
    labels = ladders.external_keys(spark.createDataFrame([("d1_L_001", " ", "LB", 1), ("d1_L_001", "02medred.csv", "MEI", 2), (None, None, "LB", 3)], "mid string, canonical_name string, label string, row_no int"), "label", ladders.LABELS, ["mid", "canonical_name"], ["lab"])
    groups = ladders.external_keys(spark.createDataFrame([("d2", "Ctrl", 1)], "fecha string, `group` string, row_no int"), "group", ladders.GROUPS, ["fecha", "mid", "canonical_name"])
    rows = ladders.build_catalog(manifest(spark), listing, labels, groups, root="/r", blind=False).collect()
    got = sorted((r.fecha, r.archivo, r.canonical_name, r.resolve_tag, r.etiqueta, r.jornada) for r in rows)
    assert got == [
        ("d1", -1, "d1_L_-01.csv", "missing", "UNK", "UNK"),
        ("d1", 1, "1medred.csv", "expected", "MEI", "UNK"),
        ("d1", 1, "1medred.csv", "expected", "MEI", "UNK"),
        ("d1", 2, "02medred.csv", "compat_found", "MEI", "UNK"),
        ("d1", 3, "3medblue.csv", "compat_found", "UNK", "UNK"),
        ("d1", 4, "d1_L_004.csv", "compat_found", "UNK", "UNK"),
        ("d1", 5, "5x.csv", "compat_found", "UNK", "UNK"),
        ("d1", 6, "6medred.csv", "missing", "UNK", "UNK"),
        ("d1", 7, "007medred.csv", "compat_found", "UNK", "UNK"),
        ("d1", 8, "8medred.csv", "missing", "UNK", "UNK"),
        ("d2", 1, "1medred.csv", "missing_dir", "UNK", "Ctrl"),
    ]
    assert {r.raw_path for r in rows if r.fecha == "d2"} == {"/r/d2/L/Raw Data/1medred.csv"}
    strict = ladders.build_catalog(manifest(spark), listing, labels, groups, root="/r", blind=False, strict=True).collect()
    assert sum(r.raw_exists for r in strict) == 2 and {r.resolve_tag for r in strict} == {"expected", "missing"}


def test_wrong_labels(spark):
    with pytest.raises(ValueError, match="label"):
        ladders.external_keys(spark.createDataFrame([("m", "??", 1)], "mid string, label string, row_no int"), "label", ladders.LABELS, ["mid"])
    with pytest.raises(ValueError, match="needs"):
        ladders.external_keys(spark.createDataFrame([("LB", 1)], "label string, row_no int"), "label", ladders.LABELS, ["mid"])


def test_sheets(spark):
    raw = spark.createDataFrame([(0, " a b", "Unnamed: 1", "c"), (1, "1", "x", "2")], "i int, _0 string, _1 string, _2 string")
    out = ladders.sheets({"s": raw, "none": raw.where("false")}, "i")
    assert out["s"].columns == ["a_b", "c"] and [tuple(r) for r in out["s"].collect()] == [("1", "2")]
    assert out["none"].count() == 0
