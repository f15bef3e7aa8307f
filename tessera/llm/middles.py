"""Operator 11: fill-in-middle transformation with big integers as bit vectors.

A text is handled as its UTF-8 bytes. ``bytes.translate`` maps each byte to 1 or 0 for a class (ASCII letters; first bytes of code
points), and the mask read as a number in base 2 is a bit vector with a bit a byte. Shifts and boolean operations on such
numbers mark where tokens (``[A-Za-z]+|[^A-Za-z]``) begin, ``bit_count`` gives their number n, and a ranked bit is selected by halving
the vector again and again. Everything is linear in the length of the text, and one text at a time is in memory. There is no shuffle.

``fill_in_middle`` gives the output texts, ``restore`` gives texts back from output and form.

Defined cases: a null text counts as empty (form plain, empty output); very long texts are cut whole; a text that holds a sentinel stays
plain; each row is transformed alone, so ties and repeated rows keep their rows; a null id draws as an empty string, ids of any type
draw by their decimal or other text; an empty table gives an empty result; result columns of ``fill_in_middle`` that a table has already get
underscores behind their names, and all other columns keep their values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Shares in percent: texts that stay plain, and texts of the others that come with the suffix first.
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20


def _class(members: set[int]) -> bytes:
    return bytes(49 if b in members else 48 for b in range(256))


_CONTINUATION = bytes(range(128, 192))
_LETTERS = _class({*range(65, 91), *range(97, 123)})
#: First bytes of code points that are no letters.
_OTHERS = _class({*range(256)} - {*_CONTINUATION} - {*range(65, 91), *range(97, 123)})


def bit_vector(data: bytes, members: bytes) -> int:
    """Bit i is set where byte i belongs to the class. A base that is a power of two reads digits in linear time."""
    return int(data[::-1].translate(members), 2) if data else 0


def token_starts(data: bytes) -> int:
    """Bits at the first bytes of tokens: every other character, and letters that follow no letter."""
    letters = bit_vector(data, _LETTERS)
    return bit_vector(data, _OTHERS) | letters & ~(letters << 1)


def selected(bits: int, rank: int, size: int) -> int:
    """Place of the set bit with the given rank (from 0) among the lowest size bits; size if there are not so many."""
    if rank >= bits.bit_count():
        return size
    at, width = 0, 1 << (size - 1).bit_length() if size > 1 else 1
    while width > 1:
        width >>= 1
        low = bits & ((1 << width) - 1)
        below = low.bit_count()
        if rank < below:
            bits = low
        else:
            bits, rank, at = bits >> width, rank - below, at + width
    return at


def draws(key: str) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(key: str, data: bytes) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the output."""
    starts = token_starts(data)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(key)
    if not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_SHARE:
        return n, "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = selected(starts, a, len(data)), selected(starts, b, len(data))
    head, middle, tail = data[:i], data[i:j], data[j:]
    chars = [len(x.translate(None, _CONTINUATION)) for x in (head, middle)]
    if h4 % 100 < SUFFIX_FIRST_SHARE:
        return n, "spm", *chars, b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, middle))
    return n, "psm", *chars, b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_tokens, form, prefix_chars, middle_chars and fim_text."""
    names = [free(docs, c) for c in ("n_tokens", "form", "prefix_chars", "middle_chars", "fim_text")]
    kinds = ["long", "string", "long", "long", "binary"]

    @F.pandas_udf(", ".join(f"{a} {k}" for a, k in zip(("n", "form", "prefix", "middle", "output"), kinds, strict=True)))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            found = [transformed(k, d) for k, d in zip(keys, texts, strict=True)]
            own = pd.DataFrame(found, columns=["n", "form", "prefix", "middle", "output"])
            yield own.astype({"n": "int64", "prefix": "Int64", "middle": "Int64"})

    own = free(docs, "__cut")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.withColumn(own, cut(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), data))
    fields = [F.col(f"{own}.{a}").alias(b) for a, b in zip(("n", "form", "prefix", "middle"), names, strict=False)]
    return rows.select(*docs.columns, *fields, F.col(f"{own}.output").cast("string").alias(names[4]))


def restored(form: Column, output: Column) -> Column:
    """The text that form and output were made from: the parts between the sentinels, put in order."""
    sentinels = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

    def parts(order: tuple[bytes, ...]) -> tuple[Column, Column, Column]:
        first, second, third = (s.decode() for s in order)
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        more = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(more, third, 1)
        return one, two, F.substr(more, F.length(two) + len(third) + 1)

    head, tail, middle = parts(sentinels["psm"])
    tail_, head_, middle_ = parts(sentinels["spm"])
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(head_, middle_, tail_)).otherwise(output)


def restore(rows: DataFrame, form: str = "form", output: str = "fim_text", text: str = "text") -> DataFrame:
    """rows with the column text rebuilt from form and output alone."""
    return rows.withColumn(text, restored(F.col(form), F.col(output)))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = restore(fill_in_middle(docs), text="back")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", sha("fim_text").alias("output_sha256"), sha("back").alias("restored_sha256"))


ORACLE = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
    SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
           CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
           CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4
    FROM d
), c AS (
    SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), p AS (
    SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
