"""Operator 7: suffix-array dedup of passages of 100 bytes and more.

Every string of ``length`` bytes that also starts earlier in the corpus is removed, at every place but the first. The work goes
to places that can repeat:

1. Anchors: in each window of ``length`` bytes the 24-byte gram of least hash is an anchor. Equal strings have equal anchors at
   equal offsets, so any repeat shows as two anchors of one gram. An anchor's context is all bytes that a string over it can
   reach. Rows carry hashes only.
2. Rows of a gram come together. A context that occurred before is a repeat as a whole. If a gram has several contexts, the
   first place of each goes on.
3. For these a suffix array over 8-byte blocks (aligned to the anchor) is built by linear grouping (``suffix_array``). Runs of
   suffixes with a common prefix of 11 blocks are the places that can share a string of 100 bytes; there bytes decide.
4. Spans are merged by document and cut out of the whole text.

``suffix_array`` groups suffixes by their Lyndon prefix: groups are processed in descending order, each member points to the
next smaller group's suffix before it, those suffixes move to a new group behind their old one, and at last each group's order
is read off without renaming or recursion.

Defined cases: null text is empty; documents of less than 100 bytes lose nothing to others; null ids stand first; rows with equal id and
text are one document (each row gets its result); rows with equal id and other text are ordered by a digest of the text; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_words, marked, runs, stash

LENGTH, GRAM, BLOCK = 100, 24, 8
REACH = LENGTH - GRAM  # bytes before an anchor that a string over it can hold
NULL_ID = -(1 << 63)
_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of s in linear time by grouping on Lyndon prefixes."""
    n = len(s)
    if not n:
        return []
    by: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by.setdefault(c, []).append(i)
    members = [by[c] for c in sorted(by)]
    before = list(range(-1, len(members) - 1))  # groups as a linked list in ascending order
    after = [*range(1, len(members)), -1]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    left = list(range(-1, n))  # left[i + 1]: a suffix at i or before it that may be unprocessed
    prev = [-1] * n
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            left[i + 1] = i - 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while (k := left[j + 1]) != j:
                left[j + 1] = left[k + 1]
                j = k
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            levels: dict[int, list[int]] = {}
            for j, count in times.items():
                levels.setdefault(count, []).append(j)
            for count in sorted(levels, reverse=True):
                made: dict[int, int] = {}
                for j in levels[count]:
                    h = group[j]
                    new = made.get(h)
                    if new is None:
                        new = made[h] = len(members)
                        members.append([])
                        behind = after[h]
                        before.append(h)
                        after.append(behind)
                        after[h] = new
                        if behind >= 0:
                            before[behind] = new
                    members[new].append(j)
                    group[j] = new
        g = before[g]
    head = g = 0
    while before[head] >= 0:
        head = before[head]
    start, at, g = [0] * len(members), 0, head
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = after[g]
    out, placed = [-1] * n, [False] * n
    i, j = -1, n - 1
    while True:
        while j >= 0 and not placed[j]:
            placed[j] = True
            out[start[group[j]]] = j
            start[group[j]] += 1
            j = prev[j]
        i += 1
        if i >= n:
            return out
        j = out[i] - 1


def common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in sa with the one before it."""
    rank = [0] * len(s)
    for i, p in enumerate(sa):
        rank[p] = i
    out, h, n = [0] * len(s), 0, len(s)
    for p in range(n):
        if rank[p]:
            q = sa[rank[p] - 1]
            while p + h < n and q + h < n and s[p + h] == s[q + h]:
                h += 1
            out[rank[p]] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def shared_spans(contexts: list[bytes], lefts: list[int], places: list[tuple]) -> list[tuple[int, int, int]]:
    """(context, start, end) of strings of LENGTH bytes that stand earlier in another place of the contexts, merged.

    lefts: where the anchor stands in each context; places: document (in corpus order) and byte at which each context begins."""
    if len(contexts) < 2:
        return []
    blocks, owner, offset, ends = [], [], [], []
    for c, (text, left) in enumerate(zip(contexts, lefts, strict=True)):
        first = left % BLOCK
        part = np.frombuffer(text, np.uint8, count=(len(text) - first) // BLOCK * BLOCK, offset=first).view("<u8")
        blocks.append(part)
        owner += [c] * (len(part) + 1)
        offset += list(range(first, first + BLOCK * len(part) + 1, BLOCK))
        ends.append(len(part))
    kinds = np.unique(np.concatenate(blocks), return_inverse=True)[1] + len(contexts)
    s, at = [], 0
    for c, n in enumerate(ends):
        s += kinds[at : at + n].tolist()
        s.append(c)  # an end of its own, below all blocks
        at += n
    need = (LENGTH - BLOCK + 1) // BLOCK
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa)
    hits: dict[int, set[int]] = {}
    slack = LENGTH - need * BLOCK
    i = 1
    while i < len(sa):
        if lcp[i] < need:
            i += 1
            continue
        j = i
        while j < len(sa) and lcp[j] >= need:
            j += 1
        found = sorted((places[c := owner[p]][0], places[c][1] + offset[p], c, offset[p]) for p in sa[i - 1 : j])
        i = j
        seen: dict[tuple[int, bytes], tuple] = {}
        for doc, byte, c, b in found:
            text = contexts[c]
            for back in range(slack + 1):
                a = b - back
                if a < 0 or a + LENGTH > len(text):
                    continue
                key = (back, text[a : a + LENGTH])
                if seen.setdefault(key, (doc, byte)) != (doc, byte):  # contexts of one document may overlap
                    hits.setdefault(c, set()).add(a)
    out = []
    for c, starts in hits.items():
        a = b = None
        for x in sorted(starts):
            if b is not None and x <= b:
                b = x + LENGTH
                continue
            if b is not None:
                out.append((c, a, b))
            a, b = x, x + LENGTH
        out.append((c, a, b))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _A[4]
    x ^= x >> np.uint64(29)
    return x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, gram hash, context hash) of all anchors of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    n = int(sizes.sum())
    starts = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if n < LENGTH or sizes.max() < LENGTH:
        return none, none, none, none
    h, level = {1: _mix((data.astype(np.uint64) + np.uint64(1)) * _A[5])}, 1
    while level < 64:
        a = h[level]
        h[2 * level] = _mix(a[:-level] * _A[0] + a[level:])
        level *= 2
    gram = h[16][: len(h[16]) - 16] * _A[1] + h[8][16 : 16 + len(h[16]) - 16]
    gram = _mix(gram)[: max(0, n - GRAM + 1)]
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    low, width = key, 1
    while width * 2 <= REACH + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH + 1:
        low = np.minimum(low[: -(REACH + 1 - width)], low[REACH + 1 - width :])
    # windows that stay in one text
    live = np.ones(len(low) + 1, bool)
    for s, z in zip(starts.tolist(), sizes.tolist(), strict=True):
        live[max(s, s + z - LENGTH + 1) : s + z] = False
    at = (low[live[: len(low)]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    doc = np.searchsorted(starts, at, "right") - 1
    # empty texts share a start with the next one; the last of them owns the position
    pos = at - starts[doc]
    ctx = np.zeros(len(at), np.uint64)
    inner = (pos >= REACH) & (pos + LENGTH <= sizes[doc])
    b = at[inner] - REACH
    ctx[inner] = _mix(_mix(h[64][b] * _A[2] + h[64][b + 64]) * _A[3] + _mix(h[32][b + 128] * _A[2] + h[16][b + 160]))
    for i in np.flatnonzero(~inner):
        d, p = int(doc[i]), int(pos[i])
        part = texts[d][max(0, p - REACH) : p + LENGTH]
        ctx[i] = int.from_bytes(hashlib.blake2b(part + bytes([min(p, REACH)]), digest_size=8).digest(), "little")
    return doc, pos, gram[at].view(np.int64), ctx.view(np.int64)


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _groups(texts: list[bytes], most: int = 500_000) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, tie, a, b): spans of bytes of each document that the corpus holds earlier. docs: d long, tie long, text."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [_bytes(t) for t in pdf["text"]]
            d, tie = pdf["d"].to_numpy(), pdf["tie"].to_numpy()
            for lo, hi in _groups(texts):
                doc, pos, gram, ctx = anchors(texts[lo:hi])
                if len(doc):
                    yield pd.DataFrame({"gram": gram, "d": d[lo + doc], "tie": tie[lo + doc], "pos": pos.astype(np.int32), "ctx": ctx})

    rows = docs.mapInPandas(emit, "gram long, d long, tie long, pos int, ctx long")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams rows in order of gram and place; holds the contexts of the current gram only."""
        gram, seen, first = None, set(), None
        for pdf in batches:
            if not len(pdf):
                continue
            g, c = pdf["gram"].to_numpy(), pdf["ctx"].to_numpy()
            old = pdf.duplicated(["gram", "ctx"]).to_numpy()
            cont = g == gram if gram is not None else np.zeros(len(g), bool)
            if cont.any():
                old |= cont & np.isin(c, np.fromiter(seen, np.int64, len(seen)))
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g)]))
            fresh = np.bincount(group[~old], minlength=len(starts))
            several = fresh > 1
            if cont.any():
                several[0] = fresh[0] > 0  # the gram's contexts so far are others
            out = pdf.assign(new=~old)[old | several[group]]
            if cont.any() and several[0] and first is not None:
                out = pd.concat([first, out])
                first = None
            if len(out):
                yield out[["gram", "d", "tie", "pos", "new"]]
            last = group == group[-1]
            if g[-1] != gram:
                gram, seen = g[-1], set()
                one = pdf[last & ~old].iloc[:1].assign(new=True)
                first = one if not several[-1] else None
            seen.update(c[last & ~old].tolist())

    met = rows.repartition("gram").sortWithinPartitions("gram", "d", "tie", "pos").mapInPandas(meet, "gram long, d long, tie long, pos int, new boolean")
    met = stash(met, "met")
    asked = met.where("new").groupBy("d", "tie").agg(F.collect_list(F.struct("gram", "pos")).alias("at"))
    texts = _holding(docs, met.where("new").select("d")).join(asked, ["d", "tie"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, tie, text, at in zip(pdf["d"], pdf["tie"], pdf["text"], pdf["at"], strict=True):
                data = _bytes(text)
                for x in at:
                    p = x["pos"]
                    out.append((x["gram"], d, tie, p, min(p, REACH), data[max(0, p - REACH) : p + LENGTH]))
            yield pd.DataFrame(out, columns=["gram", "d", "tie", "pos", "lead", "part"])

    parts = texts.mapInPandas(cut, "gram long, d long, tie long, pos int, lead int, part binary")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, "gram"):
            out = []
            d, tie, pos, lead, part, gram = (pdf[c].tolist() for c in ("d", "tie", "pos", "lead", "part", "gram"))
            # a shared string holds 38 bytes before the anchor or 38 behind its gram: only places that agree there meet
            near: dict[tuple, list[int]] = {}
            for i, (x, z) in enumerate(zip(part, lead, strict=True)):
                if z >= 38:
                    near.setdefault((gram[i], 0, x[z - 38 : z]), []).append(i)
                if len(x) >= z + GRAM + 38:
                    near.setdefault((gram[i], 1, x[z + GRAM : z + GRAM + 38]), []).append(i)
            done = set()
            for key in near.values():
                if len(key) > 1 and tuple(key) not in done:
                    done.add(tuple(key))
                    for c, a, b in shared_spans([part[i] for i in key], [lead[i] for i in key], [((d[i], tie[i]), pos[i] - lead[i]) for i in key]):
                        i = key[c]
                        base = pos[i] - lead[i]
                        out.append((d[i], tie[i], base + a, base + b))
            yield pd.DataFrame(out, columns=["d", "tie", "a", "b"]).drop_duplicates()

    found = parts.repartition("gram").sortWithinPartitions("gram", "d", "tie", "pos").mapInPandas(compare, "d long, tie long, a int, b int")
    whole = met.where("not new").select("d", "tie", F.greatest(F.col("pos") - REACH, F.lit(0)).alias("a"), (F.col("pos") + LENGTH).alias("b"))
    return whole.unionByName(found)


def _holding(docs: DataFrame, ids: DataFrame, wanted: bool = True) -> DataFrame:
    """Documents whose id may be among ids (or surely is not), told by a bitmap of fixed size."""
    rows = marked(docs, F.col("d"), bit_words(ids, "d"))
    return rows.where("__hit" if wanted else "not __hit").select(docs.columns)


def _finish(data: bytes, spans) -> tuple[int, int, int, str]:
    merged: list[list[int]] = []
    for a, b in sorted((int(x["a"]), int(x["b"])) for x in spans if x["a"] < x["b"]):
        b = min(b, len(data))
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    keep, at = hashlib.sha256(), 0
    for a, b in merged:
        keep.update(data[at:a])
        at = b
    keep.update(data[at:])
    return len(data), sum(b - a for a, b in merged), len(merged), keep.hexdigest()


RESULT = "d long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    # rows that share an id are told apart by a digest of their text; usually there are none
    clash = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d")
    tie = F.xxhash64(F.coalesce("text", F.lit(""))) if clash else F.lit(0).cast("long")
    keyed = docs.select(d, tie.alias("tie"), "text")
    base = keyed.groupBy("d", "tie").agg(F.max("text").alias("text")) if clash else keyed
    spans = stash(repeated_spans(base), "spans")
    lists = spans.groupBy("d", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = pdf["spans"] if "spans" in pdf else [None] * len(pdf)
            out = [_finish(_bytes(t), s if s is not None else []) for t, s in zip(pdf["text"], spans, strict=True)]
            yield pd.concat([pdf[["d", "tie"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])], axis=1)

    hit = _holding(base, spans.select("d")).join(lists, ["d", "tie"], "left").mapInPandas(finish, RESULT)
    out = hit.unionByName(_holding(base, spans.select("d"), False).mapInPandas(finish, RESULT))
    if clash:
        out = out.join(keyed.groupBy("d", "tie").count(), ["d", "tie"]).withColumn("__c", F.explode(F.array_repeat(F.lit(0), F.col("count").cast("int"))))
    doc_id = F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
