"""Reruns over other partitions, ids of other types, names that clash, texts of signs."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import langid, mixing

SCHEMA = "doc_id long, text string, source string, __size string, __c string, __b int"


def test_mix_reruns_agree_where_ids_repeat(spark):
    rows = [(i // 4, f"w{j} same words", "ab"[i % 2], "own", "col", j) for i in range(40) for j in range(3)]
    found = []
    for n in (1, 3, 7):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(n)
        mixed = mixing.mix_documents(docs)
        assert mixed.columns == docs.columns
        found.append(Counter(map(tuple, mixed.collect())))
    assert found[0] == found[1] == found[2]
    assert all(r[3:5] == ("own", "col") and r in set(rows) for r in found[0])


def test_mix_with_string_ids_and_long_text(spark):
    rows = [(f"id{i}", "word " * (i + 1), "s") for i in range(30)] + [(None, "w " * 50_000, "t"), ("x", None, None)]
    got = mixing.mix_copies(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    assert len(got) == 32 and max(r["__size"] for r in got) == 50_000


def test_signs_are_no_letters(spark):
    rows = [(f"d{i}", ("taka moru " if i % 2 else "schwer pflug ") * 9, "xy"[i % 2]) for i in range(60)] + [("n", "²½ ① 12", None), ("m", "", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = langid.fit_language_model(docs, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got["n"] == got["m"] == "und" and got["d1"] == "y" and got["d2"] == "x"
