"""Batches of texts are cut before they become Python strings; a pair of lines comes from few of the lists that it shares."""

from __future__ import annotations

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import lines
from tessera.llm.common import BATCH_KEY, FRAME, map_texts


def test_frames_are_small_and_ids_exact(spark):
    rows = [(None if i % 7 == 0 else (1 << 53) + i, None if i % 11 == 0 else f"text {i}") for i in range(3 * FRAME)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pdf["text"], "n": len(pdf)})

    found = map_texts(docs, work, "doc_id long, text string, n int").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted((d or 0, t or "") for d, t in rows)
    assert max(r.n for r in found) <= FRAME


def test_batches_of_texts_are_small(spark):
    docs = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("some words "), 400).alias("text"))
    before = spark.conf.get(BATCH_KEY)
    spark.conf.unset(BATCH_KEY)
    map_texts(docs, lambda batches: batches, "text string")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 8 << 20
    spark.conf.set(BATCH_KEY, before)


def test_pairs_come_from_few_lists(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    kinds = [[word() for _ in range(40)] for _ in range(6)]
    texts = [" ".join(rng.choice(kind) if rng.random() < 0.04 else w for w in kind) for kind in kinds for _ in range(8)]
    rows = spark.createDataFrame([(t,) for t in sorted(set(texts))], "line string").select(F.xxhash64("line").alias("h"), "line").cache()
    left = lines._head_lists(rows.select("h"), rows, 0.75).withColumn("c", F.col("h")).join(lines.line_signs(rows), "h").cache()
    few = [(r.a, r.b) for r in lines._met(left, 0.75).collect()]
    all_of = [(r.a, r.b) for r in lines._met(left.withColumn("before", F.array().cast("array<bigint>")), 0.75).collect()]
    assert set(few) == set(all_of) and len(set(few)) >= 20, (len(few), len(set(few)), len(all_of))
    assert 3 * len(few) < len(all_of), (len(few), len(set(few)), len(all_of))
