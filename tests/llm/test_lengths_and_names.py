"""Vectors of several lengths; pages whose own columns have the names that the filter works with."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours, urls


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 if i % 3 else 6).tolist(), "x") for i in range(240)] + [(900, [0.0, 0.0], "x"), (901, None, "x"), (902, [1.0, None], "x"), (903, [2.0], "x"), (903, [2.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, score string")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=3, window=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for i in range(0, 240, 20):
        v = np.array(rows[i][1])
        best = sorted(((-float(v @ np.array(w)), j) for j, w, _ in rows[:240] if j != i and len(w) == len(v)))[:3]
        assert sorted(got[i]) == [(k + 1, j) for k, (_, j) in enumerate(best)]
    assert set(got) == set(range(0, 240, 20))
    assert neighbours.nearest(frame.limit(0), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
    with pytest.raises(TypeError):
        neighbours.nearest(frame.withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


def test_pages_keep_their_columns(spark):
    rows = [(1, "http://a.com/x", "c", "w", "l", "old"), (1, "http://a.com/x", "c", "w", "l", "old"), (2, None, None, "w", "l", "old"), (3, "http://b.net/" + "y" * 50_000, "c", "w", None, "old")]
    pages = spark.createDataFrame(rows, "page_id int, url string, __canon string, __w0 string, __listed string, host string")
    listed = spark.createDataFrame([("a.com/x",), ("a.com/x",), (None,)], "canon string")
    for size in (0, 8 << 20):
        got = sorted((r.page_id, r["__canon"], r["__w0"], r["__listed"], r.host, r.verdict, r.listed) for r in urls.filter_urls(pages, listed, broadcast_bytes=size).collect())
        assert got == [(1, "c", "w", "l", "a.com", "block", True)] * 2 + [(2, None, "w", "l", "", "allow", False), (3, "c", "w", None, "b.net", "allow", False)]
    assert urls.filter_urls(pages.limit(0), listed).count() == urls.filter_urls(pages, listed.limit(0)).where("listed").count() == 0
