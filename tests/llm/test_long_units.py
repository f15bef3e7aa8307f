"""SentencePiece lattice over text without spaces, against a plain Viterbi path over the same pieces."""

import random
import time

import pytest

from tessera.llm import pieces


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable()


def plain(text, table):
    """Ids of the best path over the whole text, without units; the longer last piece wins ties."""
    s = pieces.spaced(text)
    by = {p: (i, score) for p, i, score in table.rows}
    best = [(0.0, None, None)] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - table.longest), end):
            sub = s[start:end]
            found = by.get(sub) or ((None, pieces.FALLBACK) if len(sub) == 1 else None)
            if found and (best[end] is None or best[start][0] + found[1] > best[end][0]):
                best[end] = (best[start][0] + found[1], start, found[0])
    out, end, k = [], len(s), text.count(pieces.MARK)
    chars = [c for c in text if c in (pieces.MARK, pieces.OTHER)]
    while end:
        _, start, i = best[end]
        c = s[start:end]
        if c == pieces.OTHER:
            c = chars.pop()
        out.append([i] if i is not None else [table.byte_ids[b] for b in c.encode()])
        end = start
    return [i for own in reversed(out) for i in own]


def test_units_of_any_length(spark, table):
    rng = random.Random(3)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF", k=3000))
    texts = ["ab" * 700, "a" * 1999, letters, "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(900)), " " * 1500, "word " * 50 + "é" * 700, "=" * 600 + "-" * 600, "".join(rng.choices("ACGT", k=257)), "".join(rng.choices("ACGT", k=256)), ("x▁y" * 200) + "▁" * 150, "short"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string").repartition(3)
    rows = pieces.decode(pieces.encode(docs, table), table, "ids", "back").collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        t = (texts + texts[:3])[r.doc_id]
        assert r.back == t
        want = plain(t, table)
        score = lambda ids: sum(table.scores[i] for i in ids)
        assert r.ids == want or abs(score(r.ids) - score(want)) < 1e-6


def test_long_texts_take_linear_time(spark, table):
    rng = random.Random(4)
    took = []
    for n in (25_000, 100_000):
        texts = ["".join(rng.choices("etaoin", k=n)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        t = time.time()
        rows = pieces.decode(pieces.encode(docs, table), table, "ids", "back").collect()
        took.append(time.time() - t)
        assert sorted(r.back for r in rows) == sorted(texts)
    assert took[1] < 10 * took[0]


def test_no_table_in_expressions(spark, table):
    """The scores of all pieces must not stand in the plan, whose text the driver makes anew for each stage."""
    words = spark.createDataFrame([("▁changed", [0])], "word string, blocks array<int>")
    windows = spark.createDataFrame([(b"u", 0, "a" * 300, [0])], "unit binary, off int, sub_text string, blocks array<int>")
    for df in (pieces.best_paths(words, table), pieces.long_paths(windows, table)):
        assert len(df._jdf.queryExecution().toString()) < 100_000


def test_words_across_batches(spark, table):
    """Words whose edges lie in several batches, and words with equal scores, have the paths of a plain search."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abst日▁é") for _ in range(rng.randint(1, 90))) for _ in range(400)})
    before, size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), pieces.FOLDED
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        pieces.FOLDED = 40
        found = pieces.best_paths(spark.createDataFrame([(w, [k]) for k, w in enumerate(words)], "word string, blocks array<int>").coalesce(1), table).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        pieces.FOLDED = size
    by = {p: (i, score) for p, i, score in table.rows}
    assert len(found) == len(words)
    for r in found:
        w = words[r.blocks[0]]
        best = [(0.0, [])] + [None] * len(w)
        for end in range(1, len(w) + 1):
            for start in range(max(0, end - table.longest), end):
                own = by.get(w[start:end]) or ((-ord(w[start]), pieces.FALLBACK) if end == start + 1 else None)
                if own and (best[end] is None or best[start][0] + own[1] > best[end][0]):
                    best[end] = (best[start][0] + own[1], [*best[start][1], own[0]])
        assert r.ids == best[-1][1]
