"""The ten operators against brute force, on small tables with nulls, ties, repeats, empty texts and clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, langid, licenses, lines, mixing, neighbours, pieces, quality, suffixes, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", size string, comp string, rank string, block string, n string"


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    texts = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(5, 30))) for _ in range(4))
        if i % 5 == 0:
            text += "\n" + passage
        texts.append(text)
    for i in (1, 2, 3):
        w = texts[i].split(" ")
        w[3] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], None, "", "   \n ", "one", "one two", "Ünïcode 日本語 ▁ \ue000▁ text \ue000", "ab " * 200]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id here", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in corpus()], EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix(docs, empty):
    rows = mixing.mix_copies(docs).toPandas()
    assert len(rows) == docs.count()
    own = rows.assign(source=rows["source"].fillna("~")).groupby("source")
    taken = own.apply(lambda g: (g["__size"] * g["__copies"]).sum(), include_groups=False)
    for s, g in own:
        assert abs(taken[s] - g["__target"].iloc[0]) <= g["__size"].max() * 3
        assert g["__copies"].max() <= 3 and g["__target"].iloc[0] <= 3 * g["__source_size"].iloc[0]
    assert abs(own["__target"].first().sum() - rows["__size"].sum()) < 1e-6
    again = mixing.mix_copies(docs.repartition(5)).toPandas()
    key = ["doc_id", "__size", "__copies"]
    assert Counter(map(str, rows[key].to_numpy().tolist())) == Counter(map(str, again[key].to_numpy().tolist()))
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_copies(empty).count() == 0


def test_base_counts():
    assert quality.base_counts("a b c a b c x") == (7, 7, 0, 0, 6)
    assert quality.base_counts("x #\nx #\n\n\ny") == (5, 5, 2, 1, 0)
    assert quality.base_counts(None) == quality.base_counts(" \t") == (0, 0, 0, 0, 0) or quality.base_counts(" \t")[0] == 0
    rng = random.Random(5)
    for _ in range(200):
        words = rng.choices("abc", k=rng.randint(0, 12))
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        cover = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert quality.base_counts(" ".join(words))[4] == len(cover)


def test_viterbi_is_best_sequence():
    rng = np.random.default_rng(2)
    field = quality.LineField(rng.normal(size=(2, quality.FEATURES)), rng.normal(size=(2, 2)))
    xs = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 2, 5, 7, 3)]
    for x, y in zip(xs, field.decode(xs), strict=True):
        score = lambda s: sum(x[t] @ field.state[s[t]] for t in range(len(s))) + sum(field.trans[a, b] for a, b in zip(s, s[1:], strict=False))
        assert max((tuple(int(b) for b in f"{k:0{len(x)}b}") for k in range(2 ** len(x))), key=score) == tuple(y)


def test_quality(docs, empty):
    rows = quality.judge(docs, quality.LineField.prior())
    assert rows.count() == docs.count() and rows.where("n_words < 50 and kept").count() == 0
    assert quality.judge(empty, quality.LineField.prior()).count() == 0
    kept = {r.doc_id for r in rows.where("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(docs, quality.LineField.prior()).collect()} == kept


def test_language(spark):
    rng = random.Random(1)
    vocab = {"xx": ["taka", "moru", "kani"], "yy": ["schwer", "pflug", "dicht"]}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=rng.randint(3, 40))), lang) for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    rows += [(900, None, "xx"), (901, "123 !!", None), (902, "taka", None)]
    found = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language_model(found, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.identify(found, model).collect()}
    held = [r for r in rows[:200] if r[0] % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) == len(held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xx"
    none = langid.fit_language_model(found, F.lit(False))
    assert {r.lang_pred for r in langid.identify(found, none).collect()} == {"und"}


def test_licenses(spark, empty):
    full = licenses.SENTENCES["mit_grant"][0] + ". " + licenses.SENTENCES["mit_notice"][0].capitalize() + "."
    rows = [(1, "Text. Released under the MIT License.\nMore."), (2, full), (3, "This licence is odd."), (4, None), (5, "")]
    got = {r.doc_id: (r.licenses, r.verdict) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["MIT"], "known"), 2: (["MIT"], "known"), 3: ([], "unknown"), 4: ([], "none"), 5: ([], "none")}
    assert licenses.scan_licenses(empty).count() == 0


def test_lines(docs, empty):
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    shingle = lambda x: {x.lower()[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))}
    found = [(d, i, x) for d, t in order for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    kinds = list(dict.fromkeys(x for _, _, x in found))
    comp = {x: x for x in kinds}
    for a in kinds:
        for b in kinds:
            x, y = shingle(a), shingle(b)
            if comp[a] != comp[b] and len(x & y) >= 0.75 * len(x | y):
                old = comp[b]
                comp = {k: comp[a] if v == old else v for k, v in comp.items()}
    seen, gone = set(), {}
    for d, i, x in found:
        if comp[x] in seen:
            gone.setdefault(d, []).append(i)
        seen.add(comp[x])
    assert {r.d: r.gone for r in lines.removed_lines(docs).collect()} == gone
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert lines.dedup_lines(empty).count() == 0


def test_lines_without_spaces(spark):
    rows = ["https://www.example.org/reports/2021/a", "https://www.example.org/about/contact", "今天天气很好我们一起去公园散步然后回家", "今天天气很好我们一起去公园散步不过下雨", "short", "shorter"]
    long = "".join(chr(0x4E00 + 7 * i % 2000) for i in range(200)) + "😀" * 3
    rows += [long, long[:150] + "x" + long[151:], long[:12] + long[:11:-1]]
    frame = spark.createDataFrame(enumerate(rows), "doc_id long, text string")
    assert [r.d for r in lines.removed_lines(frame).collect()] == [7]
    found = frame.select(F.size(lines.shingle_set(F.col("text"))).alias("n")).collect()
    low = [t.lower() for t in rows]
    assert [r.n for r in found] == [len({t[i : i + lines.SHINGLE] for i in range(max(1, len(t) - lines.SHINGLE + 1))}) for t in low]


def test_lines_of_many_kinds_in_a_band(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    head = " ".join(word() for _ in range(30))
    rows = []
    for kind in range(150):
        own = " ".join(word() for _ in range(16))
        rows += [(kind, f"{head} {own} {word()}"), (1000 + kind, f"{head} {own} {word()}")]
    gone = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.d, r.gone) for r in gone) == [(1000 + kind, [0]) for kind in range(150)]


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 3])) for _ in range(rng.randint(0, 30))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup(docs, empty):
    seen, want = {}, {}
    for d, t in sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for a in range(len(b) - 99):
            if b[a : a + 100] in seen:
                mark[a : a + 100] = True
            seen.setdefault(b[a : a + 100], 1)
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        want[d] = (len(b), int(mark.sum()), int((np.diff(np.r_[False, mark].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    rows = suffixes.removal(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want
    assert suffixes.removal(empty).count() == 0


def test_jaccard(docs, empty):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(sets[i]), comp[i]) for i in ids}
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in ids if comp[i] == i)
    assert jaccard.jaccard_components(empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (5, x[5].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") % 20 == 0).toPandas()
    hit = n = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        top = sorted(range(300), key=lambda i: (-round(s[i], 9), i))[:20]
        mine = got[got.query_id == q].sort_values("rank").vec_id.tolist()
        hit, n = hit + len(set(top) & set(mine)), n + 20
        assert len(mine) == 20
    assert hit / n >= 0.9 and set(got.query_id) == set(range(0, 300, 20))
    assert neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_neighbours_ties_and_curves(spark):
    line = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(200)], "vec_id long, embedding array<double>")
    turned = line.withColumn("embedding", F.when(F.col("vec_id") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.col("embedding")))
    got = neighbours.nearest(turned, F.col("vec_id") == 0, window=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 16))
    frame = spark.createDataFrame(enumerate(x.tolist()), "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") % 600 == 0).toPandas()
    hit = 0
    for q in range(0, 12_000, 600):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(got[got.query_id == q].vec_id))
    assert len(got) == 400 and hit / 400 >= 0.9


def test_lines_keep_clashing_columns(spark):
    rows = [(i, "one and the same long line of some words\nown line " + "abcdefgh"[i] * 30, "x", 1, "y", True) for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, gone string, tie int, d string, __hit boolean")
    out = lines.dedup_lines(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id, r.text.count("\n"), r.gone, r.tie, r.d, r["__hit"]) for r in out.collect()) == [(i, 1 if i == 0 else 0, "x", 1, "y", True) for i in range(4)]


def test_hilbert_is_continuous():
    cells = np.array([(a, b) for a in range(16) for b in range(16)])
    walk = cells[np.argsort(neighbours.hilbert_keys(cells, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_urls(spark):
    rows = [(1, "http://A.Example.org/es/x"), (2, "https://x.org"), (3, "http://q.com/fr/a"), (4, "http://www.bad.net/a.html?utm_x=1"), (5, None), (6, "nothing"), (7, "http://example.org.evil.net/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("bad.net/a",), ("bad.net/a",), (None,)], "canon string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, listed).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("x.org", "", None, "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][3] == "block" and got[5] == got[6] == ("", "", None, "allow") and got[7][2] is None
    shuffled = {r.page_id: r.verdict for r in urls.filter_urls(pages, listed, broadcast_bytes=0).collect()}
    assert shuffled == {k: v[3] for k, v in got.items()}
    assert urls.filter_urls(pages.limit(0), listed).count() == 0


def test_pieces(docs, empty):
    table = pieces.PieceTable()
    rows = pieces.decode(pieces.encode(docs.select("doc_id", "text"), table), table).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert pieces.encode(empty, table).count() == 0
    score = {p: s for p, _, s in table.rows}

    def best(word):
        b = [0.0] + [-1e9] * len(word)
        for e in range(1, len(word) + 1):
            for a in range(max(0, e - table.longest), e):
                b[e] = max(b[e], b[a] + score.get(word[a:e], pieces.FALLBACK if e == a + 1 else -1e9))
        return b[-1]

    words = ["▁changed", "▁Ünïcode", "▁日本語", "abab"]
    found = pieces.best_paths(docs.sparkSession.createDataFrame([(w, 0) for w in words], "word string, blocks int"), table).collect()
    spelled = {"".join(table.spelled[i] if i >= 0 else chr(-i) for i in r.ids): sum(table.scores[i] if i >= 0 else pieces.FALLBACK for i in r.ids) for r in found}
    assert set(spelled) == set(words) and all(abs(spelled[w] - best(w)) < 1e-9 for w in words)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("not round_trip").count() == 0 and 0 < out.count() <= 400
