"""Operator 2: language identification by averaged hashed subword embeddings with a linear softmax.

Every character 1-, 2- and 3-gram of the lower-cased text is hashed to a bucket with an embedding; a text is the mean of its
grams' embeddings, and a linear softmax over it gives the language. Both layers are trained together by stochastic gradient
descent in numpy on at most ``per_lang`` documents of each language (a documented bound, taken in order of a hash of the id),
whole and as short cuts, so that short texts are judged well too. As the model is linear, prediction adds up one row of
embedding times weights for each gram; whole texts are processed in blocks.

Rejection is calibrated: a temperature is fitted on a part of the training fold that the descent does not see, and a score
under the smallest threshold at which those texts reach ``precision`` is rejected (column accepted). Defined cases: text null
or without a letter is `und` with score 0; ties go to the language first in code point order; without training rows all is
`und`; rows with null lang are predicted but not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 13
DIM = 16
PER_LANG = 300
#: Documents that the model is fitted on: per_lang times this at most, those that come first by a hash of the id.
MOST_LANGS = 500
CUTS = (12, 30, 80, 200)
_BLOCK = 400_000


def gram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-grams of the lower-cased text; each run of non-letters counts as is."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (c[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
    three = (two[:-1] ^ (c[2:] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9FB21C651E98DF25)
    shift = np.uint64(64 - int(np.log2(buckets)))
    return np.concatenate([one, two, three]).__rshift__(shift).astype(np.int64)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embeddings times weights, over the temperature
    bias: np.ndarray
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not self.langs or not isinstance(text, str) or not any(map(str.isalpha, text)):
                names.append("und")
                continue
            total, n = np.zeros(len(self.langs)), 0
            for at in range(0, len(text), _BLOCK):
                grams = gram_buckets(text[max(0, at - 2) : at + _BLOCK])
                counts = np.bincount(grams, minlength=BUCKETS) if len(grams) > BUCKETS // 2 else None
                total += counts @ self.table if counts is not None else self.table[grams].sum(0)
                n += len(grams)
            z = total / n + self.bias
            p = np.exp(z - z.max())
            names.append(self.langs[int(z.argmax())])
            scores[i] = p.max() / p.sum()
        return names, scores


def fit_language_model(docs: DataFrame, learn: Column, *, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS, epochs: int = 30, precision: float = 0.995, seed: int = 7) -> LanguageModel:
    """Trains on rows of docs (doc_id, text, lang) where learn holds and lang and text are not null.

    The fit takes at most per_lang documents of each language and per_lang * most_langs in all, those that come first by a hash of the
    id: with more than most_langs languages some get fewer documents, or none, and are then not predicted; raise most_langs for them.
    """
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    chosen = rows.select("doc_id", "lang").withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang).select("doc_id").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_lang * most_langs)
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("t")).select("doc_id", "t.*")  # of rows that share an id one counts

    if rows.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        rows = rows.withColumn("doc_id", F.xxhash64("doc_id"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True):
                rng = np.random.default_rng(abs(hash(int(doc))) % (1 << 32))
                pieces = [text] + [text[a : a + n] for n in CUTS if len(text) > n for a in [int(rng.integers(len(text) - n))]]
                for piece in pieces:
                    if not any(map(str.isalpha, piece)):
                        continue
                    counts = sum(np.bincount(gram_buckets(piece[max(0, at - 2) : at + _BLOCK]), minlength=BUCKETS) for at in range(0, len(piece), _BLOCK))
                    keys = np.flatnonzero(counts)
                    out.append((lang, int(doc), keys.astype(np.uint16).tobytes(), (counts[keys] / counts.sum()).astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "doc", "keys", "shares"])

    found = sorted(rows.mapInPandas(features, "lang string, doc long, keys binary, shares binary").collect())
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    x = np.zeros((len(found), BUCKETS), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["keys"], np.uint16)] = np.frombuffer(r["shares"], np.float32)
    y = np.array([langs.index(r["lang"]) for r in found])
    apart = np.array([r["doc"] * 2654435761 % 5 == 0 for r in found])
    if len(langs) < 2 or apart.all() or not apart.any():
        apart[:] = False
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    train, scale = np.flatnonzero(~apart), np.float32(8.0)
    for epoch in range(epochs):
        rate = np.float32(2.0 * (1 - epoch / epochs))
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            xb = x[batch] * scale
            mean = xb @ embed
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            grad = p @ out.T
            out -= rate * (mean.T @ p)
            bias -= rate * p.sum(0)
            embed -= rate * (xb.T @ grad)
    table = (embed.astype(float) @ out) * float(scale)
    temperature, threshold = 1.0, 0.0
    if apart.any():
        z = x[apart] @ table + bias
        right = z.argmax(1) == y[apart]

        def loss(t: float) -> float:
            return float((np.logaddexp.reduce(z / t, axis=1) - z[np.arange(len(z)), y[apart]] / t).mean())

        temperature = min(np.geomspace(0.1, 10, 60), key=loss)
        p = np.exp(z / temperature - np.logaddexp.reduce(z / temperature, axis=1, keepdims=True)).max(1)
        order = np.argsort(-p)
        good = np.cumsum(right[order]) / np.arange(1, len(p) + 1) >= precision
        threshold = float(p[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return LanguageModel(langs, table / temperature, bias / temperature, threshold)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row of docs (doc_id, text), in one pass without a shuffle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, scores = model.predict(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "lang_pred": names, "score": scores, "accepted": scores >= model.threshold})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = identify(docs, fit_language_model(docs, ~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", F.col("accepted"))
