"""Runs of spaces: the best path over all normal pieces of the model."""

from tessera.llm import pieces


def test_mark_runs(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    table = pieces.PieceTable()
    normal = {i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    assert {i for _, i, _ in table.rows} == normal
    score = {p: s for p, _, s in table.rows}

    def best(text):
        b = [0.0] + [-1e9] * len(text)
        for e in range(1, len(text) + 1):
            for a in range(max(0, e - table.longest), e):
                b[e] = max(b[e], b[a] + score.get(text[a:e], pieces.FALLBACK if e == a + 1 else -1e9))
        return b[-1]

    texts = ["        return x", "a  b", "  ", " ", "if x:\n    y = 1\n\n\t  z", "end   ", " " * 37 + "deep 12  34", "\u2581  \ue000   a"]
    frame = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    rows = pieces.decode(pieces.encode(frame, table), table).collect()
    assert len(rows) == len(texts) and all(r.text == texts[r.doc_id] for r in rows)
    for r in rows:
        if pieces.MARK not in r.text and "\ue000" not in r.text and "\t" not in r.text:
            whole = pieces.MARK + r.text.replace(" ", pieces.MARK)
            cost = sum(pieces.FALLBACK if i < 259 else table.scores[i] for i in r.ids)
            assert abs(cost - best(whole)) < 1e-9, r
