"""Operator 5: quality rules by line sequence labelling.

A linear-chain conditional random field labels each line content (1) or boilerplate (0); Viterbi decoding gives the best label
sequence of the whole text, and the share of words that stand in content lines decides retention. The field is trained in numpy
by gradient ascent on its log-likelihood, on at most ``max_docs`` labelled documents (a documented bound): lines of documents
labelled good count as content. In a document labelled bad only lines that carry a visible fault (symbols after words,
shouting, table bars, words that repeat) count as boilerplate and the rest as content, so that the labels follow the lines and
not the document. Without labels a prior weight for each fault is used.

Base counts follow the contract of op5. Defined cases: null text has no words, fails the base rule and is not kept; a text
without words likewise; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
FEATURES = 10
#: Labelled documents that the model is fitted on, at most.
MAX_DOCS = 3000
MIN_SHARE = 0.5
MIN_WORDS = 50
_SYM = re.compile(r"[#*$%&|<>]")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split cuts at the six ASCII spaces only
    spaces = sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup, seen = 0, set()
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(" \t\n\r\x0b\x0c"):
                seen.add(line)
    n, repeat = len(words), 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        m = len(ids)
        if m < n:
            if m < 2_000_000:
                g = (a[:-2] * m + a[1:-1]) * m + a[2:]
            else:
                pair = np.unique(a[:-1] * m + a[1:], return_inverse=True)[1]
                g = pair[:-1] * m + a[2:]
            order = np.argsort(g, kind="stable")
            s = g[order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = np.zeros(len(g), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(n, bool)
                cover[:-2] |= twice
                cover[1:-1] |= twice
                cover[2:] |= twice
                repeat = int(cover.sum())
    return n, len(text) - spaces, symbols, dup, repeat


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (bias first), words and visible faults of each line."""
    x = np.zeros((len(lines), FEATURES), np.float32)
    n_words = np.zeros(len(lines), np.int64)
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        n_words[i] = n
        if not n:
            continue
        chars = len(line)
        upper = sum(map(str.isupper, words)) if line != line.lower() and n > 2 else 0
        stick = sum(map(str.__eq__, words[1:], words)) if n > 2 else 0
        x[i, 1] = min(1.0, 3 * len(_SYM.findall(line)) / n)
        x[i, 2] = upper / n
        x[i, 3] = stick / n
        x[i, 4] = min(1.0, line.count("!") / n)
        x[i, 5] = n <= 3
        x[i, 6] = line[-1] not in ".!?"
        x[i, 7] = 1 - len(set(words)) / n
        x[i, 8] = min(1.0, chars / n / 20)
        x[i, 9] = sum(map(line.count, "0123456789")) / chars
    x[:, 0] = 1
    faults = (x[:, 1] > 0.75) | (x[:, 2] > 0.6) | (x[:, 3] > 0.3) | (x[:, 7] > 0.75)
    return x, n_words, faults


class LineField:
    """Two-state linear-chain CRF: state weights (2, FEATURES) and transition weights (2, 2)."""

    def __init__(self, state: np.ndarray, trans: np.ndarray):
        self.state, self.trans = state, trans

    @classmethod
    def prior(cls) -> LineField:
        w = np.zeros((2, FEATURES))
        w[0, :5] = [-2.0, 6.0, 4.0, 8.0, 2.0]
        w[0, 7] = 1.0
        return cls(w, np.array([[0.5, 0.0], [0.0, 0.5]]))

    @classmethod
    def fit(cls, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 300, rate: float = 1.0, decay: float = 1e-4) -> LineField:
        """Maximum likelihood by full-batch gradient ascent with momentum; sequences of like length are stepped through together."""
        field = cls.prior()
        if not sequences:
            return field
        sequences = sorted(sequences, key=lambda s: -len(s[1]))
        n, longest = len(sequences), len(sequences[0][1])
        lengths = np.array([len(y) for _, y in sequences])
        x = np.zeros((longest, n, FEATURES))
        y = np.zeros((longest, n), int)
        for i, (a, b) in enumerate(sequences):
            x[: len(b), i], y[: len(b), i] = a, b
        live = np.arange(longest)[:, None] < lengths
        active = live.sum(1)
        one = np.eye(2)[y] * live[..., None]
        seen_state = np.einsum("tns,tnf->sf", one, x)
        seen_trans = np.einsum("tna,tnb->ab", one[:-1], one[1:]) if longest > 1 else np.zeros((2, 2))
        total, ms, mt = live.sum(), np.zeros((2, FEATURES)), np.zeros((2, 2))
        for _ in range(steps):
            emit = x @ field.state.T
            alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
            alpha[0] = emit[0]
            for t in range(1, longest):
                k = active[t]
                alpha[t, :k] = emit[t, :k] + np.logaddexp.reduce(alpha[t - 1, :k, :, None] + field.trans, axis=1)
            for t in range(longest - 2, -1, -1):
                k = active[t + 1]
                beta[t, :k] = np.logaddexp.reduce(field.trans + (emit[t + 1, :k] + beta[t + 1, :k])[:, None, :], axis=2)
            z = np.logaddexp.reduce(alpha[lengths - 1, np.arange(n)], axis=1)
            p = np.exp(alpha + beta - z[:, None]) * live[..., None]
            exp_trans = np.zeros((2, 2))
            for t in range(1, longest):
                k = active[t]
                q = alpha[t - 1, :k, :, None] + field.trans + (emit[t, :k] + beta[t, :k])[:, None, :] - z[:k, None, None]
                exp_trans += np.exp(q).sum(0)
            ms = 0.9 * ms + (seen_state - np.einsum("tns,tnf->sf", p, x)) / total - decay * field.state
            mt = 0.9 * mt + (seen_trans - exp_trans) / total - decay * field.trans
            field.state, field.trans = field.state + rate * ms, field.trans + rate * mt
        return field

    def decode(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi: the best label sequence of each text, all texts stepped through together, longest first."""
        order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(xs)
        at = 0
        while at < len(order):
            longest = len(xs[order[at]])
            to = at + 1
            while to < len(order) and len(xs[order[to]]) * 2 >= longest and (to - at) * longest < 200_000:
                to += 1
            group = order[at:to]
            at = to
            if not longest:
                continue
            lengths = np.array([len(xs[i]) for i in group])
            emit = np.zeros((longest, len(group), 2))
            for j, i in enumerate(group):
                emit[: lengths[j], j] = xs[i] @ self.state.T
            back = np.zeros((longest, len(group), 2), np.int8)
            best = emit[0].copy()
            last = np.zeros(len(group), np.int8)
            last[lengths == 1] = best[lengths == 1].argmax(1)
            for t in range(1, longest):
                k = int((lengths > t).sum())
                step = best[:k, :, None] + self.trans
                back[t, :k] = step.argmax(1)
                best[:k] = step.max(1) + emit[t, :k]
                ends = lengths[:k] == t + 1
                last[:k][ends] = best[:k][ends].argmax(1)
            labels = np.zeros((longest, len(group)), np.int8)
            for t in range(longest - 1, -1, -1):
                k = int((lengths > t).sum())
                here = np.where(lengths[:k] == t + 1, last[:k], 0)
                if t + 1 < longest:
                    more = lengths[:k] > t + 1
                    follow = back[min(t + 1, longest - 1), np.arange(k), labels[min(t + 1, longest - 1), :k]]
                    here = np.where(more, follow, here)
                labels[t, :k] = here
            for j, i in enumerate(group):
                out[i] = labels[: lengths[j], j]
        return out


def fit_line_field(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> LineField:
    """Fits on the max_docs labelled documents that come first by hash of the id, whole texts cut into sequences of 64 lines; of
    more than 4 max_docs sequences those that come first by a hash of their features."""
    chosen = labels.select("doc_id", "quality").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by max_docs

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, quality in zip(pdf["text"], pdf["quality"], strict=True):
                lines = (text or "").split("\n")
                for i in range(0, len(lines), 64):
                    x, n, faults = line_features(lines[i : i + 64])
                    if n.any():
                        y = np.ones(len(n), np.int8) if quality == 1 else np.where(faults, 0, 1).astype(np.int8)
                        out.append((x.astype(np.float32).tobytes(), y.tobytes()))
            yield pd.DataFrame(out, columns=["x", "y"])

    found = rows.mapInPandas(features, "x binary, y binary").orderBy(F.xxhash64("x", "y"), "x", "y").limit(4 * max_docs).collect()
    return LineField.fit([(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES), np.frombuffer(r["y"], np.int8).astype(int)) for r in sorted(found)])


def judge(docs: DataFrame, field: LineField, *, doc_id: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """Base counts, content words and verdict of every row, in one pass over whole texts and without a shuffle."""
    state, trans = field.state, field.trans

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LineField(state, trans)
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                texts = [t if isinstance(t, str) else None for t in pdf["t"]]
                base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
                found = [line_features((t or "").split("\n")) for t in texts]
                labels = model.decode([x for x, _, _ in found])
                content = np.array([int(n[y == 1].sum()) for (_, n, _), y in zip(found, labels, strict=True)], np.int64)
                words = np.array([int(n.sum()) for _, n, _ in found], np.int64)
                failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])
                share = content / np.maximum(words, 1)
                out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_words": base[:, 0], "word_chars": base[:, 1], "n_symbols": base[:, 2], "n_dup_lines": base[:, 3], "n_repeat_words": base[:, 4]})
                yield out.assign(base_failed=failed, kept=~failed & (share >= min_share), content_share=share)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInPandas(work, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def keep_good(docs: DataFrame, field: LineField, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs that pass, with their columns: the verdict is an Arrow column function over the text, so rows never leave their task."""
    state, trans = field.state, field.trans

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        model, out = LineField(state, trans), []
        for at in range(0, len(texts), 256):
            part = [t if isinstance(t, str) else None for t in texts.iloc[at : at + 256]]
            found = [line_features((t or "").split("\n")) for t in part]
            for t, (_, n, _), y in zip(part, found, model.decode([x for x, _, _ in found]), strict=True):
                words, _, _, _, repeat = base_counts(t)
                out.append(words >= MIN_WORDS and 100 * repeat <= 50 * words and n[y == 1].sum() >= min_share * max(1, n.sum()))
        return pd.Series(out, dtype=bool)

    return docs.where(good("text"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, fit_line_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
