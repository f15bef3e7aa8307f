"""Rows that share an id but not the text are other documents."""

from tessera.llm import jaccard


def test_keep_first_with_clashing_ids(spark):
    text = "the same long passage that stands in two documents and more words"
    rows = [(1, text), (2, text), (2, "a unique text under the id of a copy"), (2, None), (3, text), (3, text), (4, "alone"), (4, "alone")]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, text), (2, ""), (2, "a unique text under the id of a copy"), (4, "alone")]
