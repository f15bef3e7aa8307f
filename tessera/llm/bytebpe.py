"""Operator 13: byte-level BPE encoding and decoding by backtracking from longest matches.

A text is cut by the table's pattern, and each piece is encoded alone. Bytes become Latin-1 characters, so that pyahocorasick
(which holds characters) finds every token that stands in a piece; the longest one at each place is kept. A piece's exact merges are those
of the only token sequence in which all neighbours are compatible: two tokens are, if merging the bytes of both gives them back. The
search goes from left to right by longest tokens; where none is compatible with the token before, it takes that one back, goes
on with its next shorter beginning, and never visits a place again that has failed. So a piece is encoded in linear time however long it is.
Whether two tokens are compatible is decided along the splits of both and remembered, in a memory of bounded size; so are the ids of short pieces.

A token is split into the two tokens whose merge forms it, found by merging its own bytes. Tokens that no merge forms can only
stand for a whole piece, as in the tiktoken library, whose ids these are. A table in which a token's bytes merge to it only after merges of
higher rank (none of the tables at hand; ``in_order`` is false then) has no such splits: its pieces are merged with a heap.

The table (ranks by bytes, from a vocabulary file of fixed size) is broadcast; each row is encoded alone, so there is no shuffle
and no row is larger than its text and ids.

Defined cases: null text has null ids in ``encode`` and counts as empty in the query; empty text has no ids; very long texts and texts
without spaces are encoded whole; repeated rows and null ids keep their rows; an empty table gives an empty result; ids of rows
may have any type; a column named as the result's gets its values replaced only if it is the named output column (``encode`` puts underscores behind
the name instead), other columns keep theirs. Decoding an id that the table lacks raises.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free

RANKS = "byte_bpe_multi_50k.tiktoken"
FOLDER = "/opt/tokenizers"
#: Entries that a worker remembers, at most: ids by piece (up to PIECE_BYTES each) and compatibility by pair.
PIECES, PIECE_BYTES, PAIRS = 1 << 18, 48, 1 << 20


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merged(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Merges of the lowest rank first, of ranks under below only. For tokens, which are short."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def heap_merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece by merges of the lowest rank, the leftmost first of equal ones, for any table; n log n."""
    n = len(data)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(data[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if end[i] < 0 or after[i] >= n or end[after[i]] != to:
            continue  # one of both parts has changed since
        j = after[i]
        end[i], after[i] = end[j], after[j]
        end[j] = -1
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = after[i]
    return out


class RankTable:
    """Tokens of a rank file: bytes by id, and what encoding needs to know of each. Read on the driver, then broadcast."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self.pattern = pattern or public_pattern()
        with open(path or f"{FOLDER}/{RANKS}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self._from(ranks)

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> RankTable:
        out = cls.__new__(cls)
        out.pattern = pattern
        out._from(ranks)
        return out

    def _from(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.raw: list[bytes | None] = [None] * size
        #: Both parts of a token; a byte is its own part.
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[tuple[int, int], int] = {}
        for data, r in ranks.items():
            self.raw[r] = data
        self.size = [len(data or b"") for data in self.raw]
        self.formed = [data is not None and len(data) == 1 for data in self.raw]
        for data, r in ranks.items():
            if len(data) > 1 and len(parts := merged(data, ranks, r)) == 2:
                a, b = ranks[parts[0]], ranks[parts[1]]
                self.left[r], self.right[r], self.formed[r] = a, b, True
                self.pairs[a, b] = r
        late = (d for d, r in ranks.items() if not self.formed[r] and len(merged(d, ranks, size)) == 1)
        self.in_order = next(late, None) is None
        #: The longest formed token that a formed token begins with, -1 for none.
        self.shorter = [-1] * size
        for data, r in ranks.items():
            for n in range(len(data) - 1, 0, -1):
                t = ranks.get(data[:n], -1)
                if t >= 0 and self.formed[t]:
                    self.shorter[r] = t
                    break


class Encoder:
    """Encodes texts in one worker."""

    def __init__(self, table: RankTable):
        import ahocorasick
        import regex

        self.table = table
        self.cut = regex.compile(table.pattern).findall
        self.search = ahocorasick.Automaton()
        for data, r in table.ranks.items():
            if table.formed[r]:
                self.search.add_word(data.decode("latin-1"), (len(data), r))
        self.search.make_automaton()
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b leaves them as they are.

        The merges at the border are followed back: the later formed of both tokens is taken apart, and no pair of what
        then meets at the border may have merged before that.
        """
        if (found := self.fits.get((a, b))) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """A pair at the border merges if its rank comes before the rank at which one of both becomes part of another token."""
        t, until = self.table, len(self.table.raw)
        while t.pairs.get((a, b), until) >= until:
            whole_a, whole_b = t.right[a] == a, t.left[b] == b
            if whole_a and whole_b:
                return True
            # before the rank of the later formed one (the right one, of equal tokens) its part stood at the border
            if not whole_a and (a > b or whole_b):
                until, a = a, t.right[a]
            else:
                until, b = b + 1, t.left[b]
        return False

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece that is no token itself."""
        if not self.table.in_order:
            return heap_merged(data, self.table.ranks)
        n, table = len(data), self.table
        longest = [0] * n
        for end, (size, r) in self.search.iter(data.decode("latin-1")):
            longest[end + 1 - size] = r  # ends rise, so the last token from a place is its longest
        size_of, shorter, compatible = table.size, table.shorter, self.compatible
        failed = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + size_of[token]
            if not failed[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            while (token := shorter[token]) < 0:
                failed[at] = 1
                token = out.pop()
                at -= size_of[token]

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        known, ranks, out = self.known, self.table.ranks, []
        for p in self.cut(text):
            found = known.get(p)
            if found is None:
                data = p.encode("utf-8", "surrogatepass")
                r = ranks.get(data)
                found = np.array([r] if r is not None else self.piece(data), "<u4").tobytes()
                if len(data) <= PIECE_BYTES:
                    if len(known) >= PIECES:
                        known.clear()
                    known[p] = found
            out.append(found)
        return b"".join(out)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.raw.__getitem__, ids.tolist()))


def encode_with(docs: DataFrame, table: RankTable, finish: Callable[[Encoder, str | None, np.ndarray | None], tuple], schema: str, *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns to keep (all if None) and finish(encoder, text, ids) for every row of docs. schema: finish's columns."""
    keep = docs.columns if keep is None else keep
    names = [c.split()[0] for c in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # as large as the vocabulary file, whatever the input is
    own = free(docs, "__coded")

    @F.pandas_udf(schema)
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Encoder(shared.value)
        for texts in batches:
            found = [finish(coder, t, None if t is None else np.frombuffer(coder.ids(t), "<u4")) for t in texts]
            yield pd.DataFrame(found, columns=names)

    rows = docs.select(*keep, work(text).alias(own))
    return rows.select(*keep, *[F.col(f"{own}.{c}").alias(free(docs.select(*keep), c)) for c in names])


def encode(docs: DataFrame, table: RankTable, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of every text."""
    return encode_with(docs, table, lambda coder, t, found: (None if found is None else found.astype(np.int64),), f"{ids} array<long>", text=text)


def decode(rows: DataFrame, table: RankTable, ids: str = "ids", data: str = "data") -> DataFrame:
    """rows with the bytes of their ids in the column data; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(table.raw)

    @F.pandas_udf("binary")
    def back(values: pd.Series) -> pd.Series:
        raw = shared.value

        def one(i: int) -> bytes:
            if not 0 <= i < len(raw) or raw[i] is None:
                raise ValueError(f"no token has the id {i}")
            return raw[i]

        return values.map(lambda x: None if x is None else b"".join(map(one, x)))

    return rows.withColumn(data, back(ids))


def digest(coder: Encoder, text: str | None, ids: np.ndarray | None) -> tuple[int, str, str]:
    """The number of ids, a digest of them, and one of the bytes that they decode to."""
    ids = np.zeros(0, "<u4") if ids is None else ids
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.bytes_of(ids)).hexdigest()


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_with(docs, RankTable(), digest, DIGEST, keep=["doc_id"])
