"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import bytebpe, conversations, middles

DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", "a", "1", " ", "one two", "ab<P>c", "<S>", "é", "日本 語x", "ab " * 300, "x" * 5000, "don't 12ab\n\n  c", "<<M", "\x00a\x1f ", "🙂🙂a🙂"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def expected_middle(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, d = len(tokens), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "own", 7) for i in range(160)] + [(3, "one two", "own", 7)] * 2 + [(None, "a b c", "own", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n_tokens int").repartition(3)
    got = middles.restore(middles.fill_in_middle(docs), "form_", "fim_text", "back")
    found = sorted(((r.doc_id, r.text, r.n_tokens_, r.form_, r.prefix_chars, r.middle_chars, r.fim_text, r.back, r.form, r.n_tokens) for r in got.collect()), key=str)
    assert found == sorted(((i, t, *expected_middle(i, t), f, k) for i, t, f, k in rows), key=str)
    assert middles.fill_in_middle(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("x1", "some text here")], "doc_id string, text string")
    assert middles.fill_in_middle(named).first().fim_text == expected_middle("x1", "some text here")[4]


def test_ranked_bits():
    rng = random.Random(4)
    for size in (1, 2, 3, 64, 65, 1000):
        bits = rng.getrandbits(size)
        places = [i for i in range(size) if bits >> i & 1]
        assert [middles.selected(bits, k, size) for k in range(len(places) + 1)] == [*places, size]


def test_fill_in_middle_query(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = middles.op11_fill_in_middle(spark, DATA)
    want = db.sql(middles.ORACLE)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# ---- 12


def repaired(rows):
    """All of a conversation's numbers, by dynamic programming over (cost, audit) from the end."""
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        if not body:
            kinds.append("b")
            counts[0] += 1
        elif (role, text) in seen:
            kinds.append("d")
            counts[1] += 1
        elif body[-1] not in ".!?":
            kinds.append("t")
            counts[2] += 1
        else:
            kinds.append("")
        seen.add((role, text))
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    end = {0: (0, ""), 3: (0, "")}
    best = [None] * (len(rows) + 1)

    def inserted(table):
        for _ in range(4):
            for s in range(4):
                for c in "ua":
                    if c in after[s] and after[s][c] in table:
                        cost, audit = table[after[s][c]]
                        table[s] = min(table.get(s, (99999999, "")), (cost + 3, "I" + audit))
        return table

    best[-1] = inserted(dict(end))
    for i in range(len(rows) - 1, -1, -1):
        table, more = {}, 3 if kinds[i] == "t" else 0
        for s in range(4):
            ways = [(4, "D", s)]
            if kinds[i] not in ("b", "d"):
                initial = rows[i][1][:1]
                if initial in after[s]:
                    ways.append((more, "K", after[s][initial]))
                ways += [(3 + more, "R", after[s][c]) for c in "ua" if c in after[s]]
            own = [(best[i + 1][to][0] + cost, letter + best[i + 1][to][1]) for cost, letter, to in ways if to in best[i + 1]]
            if own:
                table[s] = min(own)
        best[i] = inserted(table)
    cost, audit = best[0][0]
    out, state, rest = [], 0, list(rows)
    for letter in audit:
        if letter == "I":
            role, text = ("assistant" if state == 2 else "user"), ""
        else:
            _, role, text = rest.pop(0)
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if state == 2 else "user"
        state = after[state][role[:1]]
        out.append(f"{role}:{text}")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *counts, illegal, cost, audit, sha("\n".join(out)))


def expected_repairs(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return sorted(((conv, *repaired(sorted(own, key=order))) for conv, own in by.items()), key=str)


def talk(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "assistant"]
    texts = ["Hi.", "What?", "cut of", "", " \n", None, "So!", "Yes. ", "no", "Ünï."] + [f"Text {i}." for i in range(40)]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_conversations(spark, most):
    rows = talk(7, 120, 9) + [r for r in talk(9, 3, 400) if r[0]] + [(500, None, None, None), (501, 0, "user", "x.")] * 3
    table = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    got = conversations.repair_report(conversations.damaged(table), table, most)
    assert sorted(map(tuple, got.collect()), key=str) == expected_repairs(rows)


def test_conversations_edges(spark):
    rows = [("c1", 0, "user", "Hi."), ("c1", 1, "user", "You?"), ("c1", 2, "assistant", "ok")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert conversations.repair_report(table.limit(0), table).collect()[0][1:8] == (0, 0, 0, 0, 0, 0, "")
    assert conversations.repair_report(table.limit(0), table.limit(0)).count() == 0
    whole = conversations.repair_report(table).first()
    assert (whole.conv_id, whole.illegal, whole.truncated) == ("c1", 1, 1)
    back = [(r.conv_id, r.place, r.role, r.text, r.edit) for r in conversations.repaired_rows(table).orderBy("place").collect()]
    want = repaired([r[1:] for r in rows])
    assert "".join(r[4] for r in back) == want[6].replace("D", "")
    assert sha("\n".join(f"{r[2]}:{r[3]}" for r in back)) == want[7] == whole.repaired_sha256
    assert [r[1] for r in back] == list(range(len(back)))


def test_distances_bridge_pieces():
    rng = random.Random(1)
    for _ in range(50):
        codes = bytes(rng.randint(0, 8) for _ in range(rng.randint(0, 30)))
        cut = rng.randint(0, len(codes))
        whole = conversations.distances(codes, conversations.GOAL)
        tail = conversations.distances(codes[cut:], conversations.GOAL)[:4]
        ways = conversations.matrix(codes[:cut])
        assert [min(ways[4 * s + e] + tail[e] for e in range(4)) for s in range(4)] == whole[:4]
        assert conversations.distances(codes[:cut], tail)[:4] == whole[:4]


def test_conversations_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{DATA}/conversations.parquet'").fetchall()
    got = conversations.op12_conversation_repair(spark, DATA)
    assert sorted(map(tuple, got.collect()), key=str) == expected_repairs(rows)


# ---- 13


@pytest.fixture(scope="module")
def table():
    return bytebpe.RankTable()


@pytest.fixture(scope="module")
def library(table):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=table.pattern, mergeable_ranks=table.ranks, special_tokens={})


def test_byte_bpe(spark, table, library):
    rng = random.Random(6)
    letters = "abcdefgehtione rs  .,'\n0123äßéç日本語🙂‍\x00\x85"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(200)] + ["".join(rng.choices("abet", k=100_000)), "語" * 30_000, "ab" * 50_000, " " * 3000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(None, "x y", "own")] * 2, "doc_id long, text string, ids string").repartition(3)
    rows = bytebpe.decode(bytebpe.encode(docs, table), table, "ids_").collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r.ids == "own"
        assert r.ids_ == (None if r.text is None else library.encode_ordinary(r.text))
        assert r.data == (None if r.text is None else r.text.encode())
    assert bytebpe.encode(docs.limit(0), table).count() == 0


def test_byte_bpe_small_tables():
    import tiktoken

    rng = random.Random(2)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 30:  # merges of what there is, and some tokens that no merge forms
            known = [t for t in ranks if set(t) <= set(b"abc")]
            t = rng.choice(known) + rng.choice(known) if rng.random() < 0.9 else bytes(rng.choices(b"abc", k=rng.randint(2, 5)))
            if len(t) < 12:
                ranks.setdefault(t, len(ranks))
        own = bytebpe.Encoder(bytebpe.RankTable.of(ranks, "[a-c]+"))
        library = tiktoken.Encoding("own", pat_str="[a-c]+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(60):
            text = "".join(rng.choices("abc", k=rng.randint(1, 40)))
            assert [int.from_bytes(own.ids(text)[i : i + 4], "little") for i in range(0, len(own.ids(text)), 4)] == library.encode_ordinary(text)


def test_byte_bpe_query(spark, table, library):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    want = {}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((t or "").encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.op13_byte_bpe(spark, DATA).collect()}
    assert got == want


def test_rank_file_needs_all_bytes(tmp_path):
    (tmp_path / "few").write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(255)))
    with pytest.raises(ValueError, match="single byte"):
        bytebpe.RankTable(str(tmp_path / "few"), "a")
