"""Operator 8: n-gram Jaccard join by a size-aware heavy-light split, with connected components.

A document's set holds the hashes of its distinct five-word shingles. Equal sets are one class, so exact copies cost one row.

* Small sets (size up to a boundary) enumerate fixed-size subsets: for every partner size m that may link, all subsets of
  ceil(3 (n + m) / 7) shingles. Two linked sets share such a subset, and only linked sets do.
* Large sets scan inverted lists. Shingles have a fixed global order in which the heavy ones (found often in the whole corpus)
  stand last; a set lists its first floor(n / 4) + 1 shingles, and two linked sets share one of them, since at most n / 4 shingles of
  either set are missing in the other.
* The boundary is the size at which the two costs, rows emitted and list entries scanned, add up to least over the size
  histogram of the corpus.

Lists of up to SHORT members offer their pairs, of which each class tests one first and then those across components; a longer list
offers each member with its first and with the one before, and of long lists with equal members
one goes on. Later rounds take lists whose members still differ in component. There each member outside the list's largest
component is offered its nearest untested partners of other components, a few at first and more in each round; a list of many
members is dealt to several tasks by these members. A pair goes on only if the sets' parity bitmaps allow
a link (their distance never exceeds the symmetric difference, so no link is lost), and is then verified on whole texts. Rounds end
when no untested pair across components is left, so components are those of all links, and no group's pairs are all made. 64-bit
hashes stand for shingles; collisions are the only source of error.

Defined cases: null or wordless text has the empty set and links with nothing; fewer than five words are one shingle; very long texts count
whole; repeated rows are in one class and keep their rows; a null id is no component's smallest, and ``keep_first`` never drops its row; other
columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_words, components, map_texts, marked, runs, stash

SHINGLE = 5
#: Heavy shingles that are ordered last, at most: a bound for what the driver and the tasks hold. It changes cost, not results.
HEAVY = 400_000
#: Lists of up to so many members offer all pairs at once; longer ones offer best partners in rounds.
SHORT = 32
#: Partners that a member is offered in the first round, and how many times more in each later one, until none is left.
OFFERS = 8
MORE = 64
#: Bitmap comparisons of a long list that one task makes, about.
COMPARED = 16_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; seen keeps those of one batch."""
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, np.uint64)


def shingle_set(text: str | None, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words, seen)
    if len(h) < SHINGLE:
        x = np.array([len(h)], np.uint64)
        for v in h:
            x = (x ^ v) * _P[0]
            x ^= x >> np.uint64(29)
        return x
    n = len(h) - SHINGLE + 1
    x = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        x = (x ^ h[i : i + n]) * _P[i]
        x ^= x >> np.uint64(29)
    return np.unique(x)


def _batches(pdf: pd.DataFrame, column: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    seen: dict[bytes, int] = {}
    for i, text in enumerate(pdf[column]):
        if len(seen) > 100_000:
            seen.clear()
        yield i, shingle_set(text, seen)


def overlap_needed(n: int, m: int) -> int:
    return -(-3 * (n + m) // 7)


def subset_sizes(n: int) -> list[int]:
    return sorted({overlap_needed(n, m) for m in range(-(-3 * n // 4), 4 * n // 3 + 1) if overlap_needed(n, m) <= min(n, m)})


def boundary(sizes: dict[int, int], scanned: float, most: int = 12) -> int:
    """Largest size whose sets enumerate subsets: where enumeration plus list scans cost least over the size histogram."""

    def cost(x: int) -> float:
        small = sum(c * sum(math.comb(n, k) for k in subset_sizes(n)) for n, c in sizes.items() if 0 < n <= x)
        return small + sum(c * (n // 4 + 1) * scanned for n, c in sizes.items() if n > x or 4 * n // 3 > x)

    return min(range(most + 1), key=cost)


def list_keys(tokens: np.ndarray, heavy: np.ndarray, small: int) -> np.ndarray:
    """Keys under which a set looks for partners: subsets, list heads, or both near the boundary."""
    n, out = len(tokens), []
    if n <= small:
        for c in subset_sizes(n):
            for pick in itertools.combinations(tokens.tolist(), c):
                out.append(int.from_bytes(hashlib.blake2b(np.array(pick, np.uint64).tobytes() + bytes([c]), digest_size=8).digest(), "little"))
    if n > small or 4 * n // 3 > small:
        late = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens if len(heavy) else np.zeros(n, bool)
        out += np.concatenate([tokens[~late], tokens[late]])[: n // 4 + 1].tolist()
    return np.array(out, np.uint64)


def parity(tokens: np.ndarray) -> bytes:
    """Parity bitmap with two bits or more a shingle: the distance of two sets' bitmaps, folded to one width, never exceeds their symmetric difference."""
    bits = 512
    while bits < 2 * len(tokens):
        bits *= 2
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap as 64-bit words, folded to size bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, size // 8), axis=0)


def set_digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _stats(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray, dict[int, int], float]:
    """One pass over the texts: rows (doc_id, n, sig), classes (sig, rep, n, bits), heavy shingles, size histogram, and the length of the list that a light shingle's entry stands in, on average."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            sets = [t for _, t in _batches(part)]
            sigs = [set_digest(t) if len(t) else None for t in sets]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n": [len(t) for t in sets], "sig": pd.array(sigs, "Int64"), "bits": [parity(t) if len(t) else None for t in sets], "token": pd.array([None] * len(sets), "Int64")})
            once = {s: t for s, t in zip(sigs, sets, strict=True) if s is not None}
            if once:
                tokens = np.sort(np.concatenate(list(once.values())))
                starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
                counts = np.diff(np.r_[starts, len(tokens)])
                often = counts >= 2
                yield pd.DataFrame({"doc_id": None, "n": counts[often], "sig": pd.array([None] * int(often.sum()), "Int64"), "bits": None, "token": tokens[starts[often]].view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stash(map_texts(docs.select("doc_id", "text"), work, f"doc_id {kind}, n long, sig long, bits binary, token long", rows=1500), "sets")
    often = found.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    heavy = often.where("n >= 4").orderBy(F.desc("n"), "token").limit(HEAVY).select("token", "n").toArrow()  # at most HEAVY
    top = np.sort(heavy["token"].to_numpy().astype(np.int64).view(np.uint64))
    least = int(min(heavy["n"].to_pylist(), default=4)) if len(top) == HEAVY else 4
    light = often.where(F.col("n") < least).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    entries = found.where("token is null").agg(F.sum("n")).first()[0] or 0
    scanned = max(1.0, (entries - (light["n"] or 0) + (light["n2"] or 0)) / max(1, entries))
    rows = found.where("token is null").select("doc_id", "n", "sig")
    classes = found.where("token is null and sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    coarse = rows.groupBy(F.least("n", F.lit(64)).alias("n")).count().collect()  # at most 65 rows
    return rows, stash(classes, "classes"), top, {int(r["n"]): int(r["count"]) for r in coarse}, scanned


def set_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (doc_id, n, sig) of every row of docs, and (sig, comp) for classes in a component of several."""
    rows, classes, heavy, histogram, scanned = _stats(docs)
    small = boundary(histogram, scanned)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {}
            for _, tokens in _batches(pdf):
                if len(tokens) and (sig := set_digest(tokens)) not in out:
                    out[sig] = (list_keys(tokens, heavy, small).view(np.int64), len(tokens))
            if out:
                count = [len(k) for k, _ in out.values()]
                yield pd.DataFrame({"token": np.concatenate([k for k, _ in out.values()]), "sig": np.repeat(np.array(list(out), np.int64), count), "n": np.repeat(np.array([n for _, n in out.values()], np.int32), count)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of lists with up to SHORT classes; of longer lists the pairs with the first member and with the one before, and the members."""
        for pdf in runs(batches, "token"):
            t, s, n = (pdf[c].to_numpy() for c in ("token", "sig", "n"))
            keep = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]
            t, s, n = t[keep], s[keep], n[keep]
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            count = np.diff(np.r_[starts, len(t)])
            k, first, n_first = (np.repeat(x, count) for x in (count, s[starts], n[starts]))
            t, s, n, first, n_first, k = (x[k > 1] for x in (t, s, n, first, n_first, k))
            a, b = [], []
            for back in range(1, min(SHORT, len(t))):
                i = np.flatnonzero((t[back:] == t[:-back]) & (k[back:] <= SHORT))
                if not len(i):
                    break
                i = i[(4 * n[i] >= 3 * n[i + back]) & (4 * n[i + back] >= 3 * n[i])]
                a.append(s[i])
                b.append(s[i + back])
            i = np.flatnonzero((k > SHORT) & (s != first) & (4 * n >= 3 * n_first) & (4 * n_first >= 3 * n))
            j = 1 + np.flatnonzero((t[1:] == t[:-1]) & (k[1:] > SHORT) & (4 * n[1:] >= 3 * n[:-1]) & (4 * n[:-1] >= 3 * n[1:]))
            a, b = np.concatenate([*a, first[i], s[j - 1]]), np.concatenate([*b, s[i], s[j]])
            yield pd.DataFrame({"token": 0, "a": np.minimum(a, b), "b": np.maximum(a, b), "n": 0}).drop_duplicates()
            i = k > SHORT
            t, s, n = t[i], s[i], n[i]
            if len(t):  # a list goes on under a digest of its members
                starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                mixed = s.view(np.uint64) * _P[0]
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _P[1]
                t = np.repeat(np.add.reduceat(mixed, starts), np.diff(np.r_[starts, len(t)])).view(np.int64)
                yield pd.DataFrame({"token": t, "a": s, "b": s, "n": n}).drop_duplicates()

    keys = map_texts(docs.select("doc_id", "text"), emit, "token long, sig long, n int")
    met = keys.repartition("token").sortWithinPartitions("token", "sig").mapInPandas(meet, "token long, a long, b long, n int")
    met = stash(met, "met")
    pairs = stash(_allowed(met.where("a <> b").select("a", "b").distinct(), classes), "pairs")
    repeats = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    texts = stash(_reps(docs, _of(classes, _ends(pairs)), repeats), "texts")
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verify(texts, one)
    comps = components(links)
    rest = pairs  # what these links have not brought into one component yet
    for end in "ab":
        rest = rest.join(comps.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(one, ["a", "b"], "left_anti")
    links = stash(links.unionByName(_verify(texts, stash(rest, "rest"))), "links")
    comps = components(links)
    long = met.where("a = b").select("token", F.col("a").alias("sig"), "n").distinct()
    members = tested = None
    most = OFFERS
    while True:
        now = long.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        mixed = now.groupBy("token").agg((F.min("comp") < F.max("comp")).alias("mixed")).where("mixed").select("token")
        now = stash(now.join(mixed, "token").select("token", "sig", "n", "comp"), "mixed")
        if now.isEmpty():
            break
        if members is None:  # later lists are among these
            own = stash(_of(classes, now.select("sig").distinct()), "own")
            members = stash(_reps(docs, own, repeats).join(own.select("sig", "bits"), "sig"), "members")
        offered = stash(_offers(now, members, tested, most), "offers")
        if offered.isEmpty():
            break
        links = stash(links.unionByName(_verify(members, offered)), "links")
        comps = components(links)
        tested = offered if tested is None else stash(tested.unionByName(offered), "tested")
        long, most = now.select("token", "sig", "n"), most * MORE
    return rows, comps.withColumnRenamed("node", "sig")


def _ends(pairs: DataFrame) -> DataFrame:
    """(sig): the classes that pairs name."""
    return pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()


def _of(classes: DataFrame, sigs: DataFrame) -> DataFrame:
    """The classes named in sigs; most others are left out before the shuffle."""
    return marked(classes, F.col("sig"), bit_words(sigs, "sig")).where("__hit").drop("__hit").join(sigs, "sig", "left_semi")


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sizes and bitmaps allow a link."""
    pairs = stash(pairs, "pairs")
    own = _of(classes, _ends(pairs)).select("sig", "n", "bits")
    both = pairs.join(own.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
    both = both.join(own.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b").where("4 * na >= 3 * nb and 4 * nb >= 3 * na")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for n, m, x, y in zip(pdf["na"], pdf["nb"], pdf["x"], pdf["y"], strict=True):
                size = min(len(x), len(y))
                keep.append(7 * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= n + m)
            yield pdf[["a", "b"]][keep]

    return both.mapInPandas(work, "a long, b long")


def _reps(docs: DataFrame, classes: DataFrame, repeats: bool) -> DataFrame:
    """(sig, text) of classes: the text of each class's first row, the other texts filtered before the shuffle. repeats: whether an id occurs twice."""
    reps = classes.select("rep", "sig")
    rows = marked(docs.select(F.col("doc_id").alias("rep"), "text"), F.col("rep"), bit_words(reps, "rep"))
    texts = rows.where("__hit").select("rep", "text").join(reps, "rep")
    if not repeats:
        return texts.select("sig", "text")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[len(t) > 0 and set_digest(t) == s for (_, t), s in zip(_batches(pdf), pdf["sig"], strict=True)]][["sig", "text"]]

    return texts.mapInPandas(check, "sig long, text string").groupBy("sig").agg(F.min("text").alias("text"))


def _offers(lists: DataFrame, members: DataFrame, tested: DataFrame | None, most: int) -> DataFrame:
    """(a, b): for each member of a long list, those of the list's largest component apart, its nearest partners by bitmap distance
    among untested pairs across components, at most so many; over all its lists the nearest count."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, "key"):
            out = []
            for _, g in pdf.groupby(["key", "token", "z"], sort=False):
                n, comp, sig, done = g["n"].to_numpy(np.int64), g["comp"].to_numpy(), g["sig"].to_numpy(), g["done"].tolist()
                size = min(map(len, g["bits"]))
                bits = np.stack([folded(b, size) for b in g["bits"]])
                kinds, kind, count = np.unique(comp, return_inverse=True, return_counts=True)
                asks = (kind != count.argmax()) & (sig % g["s"].iat[0] == g["z"].iat[0])
                for at in np.flatnonzero(asks).tolist():
                    may = (4 * n >= 3 * n[at]) & (4 * n[at] >= 3 * n) & (comp != comp[at])
                    if done[at] is not None and len(done[at]):
                        may &= ~np.isin(sig, done[at])
                    i = np.flatnonzero(may)
                    d = np.bitwise_count(bits[i] ^ bits[at]).sum(1, dtype=np.int64)
                    fine = 7 * d <= n[i] + n[at]
                    i, d = i[fine], d[fine]
                    took = np.argsort(d, kind="stable")[:most]
                    out += zip([sig[at]] * len(took), sig[i[took]].tolist(), d[took].tolist(), strict=True)
            yield pd.DataFrame(sorted(set(out)), columns=["own", "other", "d"])

    parts = lists.groupBy("token").agg(F.ceil(F.count("*") * F.count("*") / COMPARED).cast("int").alias("s"))
    rows = lists.join(parts, "token").withColumn("z", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.join(members.select("sig", "bits"), "sig").withColumn("key", F.xxhash64("token", "z"))
    if tested is None:
        rows = rows.withColumn("done", F.lit(None).cast("array<long>"))
    else:
        both = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows = rows.join(both.groupBy(F.col("a").alias("sig")).agg(F.collect_set("b").alias("done")), "sig", "left")
    rows = rows.repartition("key").sortWithinPartitions("key", "token", "z", "sig")
    found = rows.mapInPandas(work, "own long, other long, d long").distinct()
    best = F.row_number().over(Window.partitionBy("own").orderBy("d", "other"))
    found = found.withColumn("r", best).where(F.col("r") <= most)
    return found.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()


def _verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets, of texts (sig, text), reach the threshold. Members travel to their partner's task as text; a partner with many members is split."""
    texts = texts.select("sig", "text")
    salt = F.pmod(F.xxhash64("b"), F.lit(1 << 20))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 200).alias("s"))
    keyed = pairs.join(many, "a").select("a", "b", F.pmod(salt, F.col("s")).alias("z"))
    left = keyed.select("a", "z").distinct().join(texts.withColumnRenamed("sig", "a"), "a").select("a", "z", F.col("a").alias("b"), F.lit(0).alias("other"), "text")
    right = keyed.join(texts.withColumnRenamed("sig", "b"), "b").select("a", "z", "b", F.lit(1).alias("other"), "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, out, seen = None, None, [], {}
        for pdf in batches:
            for a, z, b, text in zip(pdf["a"], pdf["z"], pdf["b"], pdf["text"], strict=True):
                if len(seen) > 100_000:
                    seen.clear()
                tokens = shingle_set(text, seen)
                if (a, z) != key:
                    key, own = (a, z), tokens
                else:
                    both = len(np.intersect1d(own, tokens, assume_unique=True))
                    if 100 * both >= 75 * (len(own) + len(tokens) - both):
                        out.append((a, int(b)))
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []

    both = left.unionByName(right).repartition("a", "z").sortWithinPartitions("a", "z", "other", "b")
    return stash(map_texts(both, compare, "a long, b long"), "links")


def _components(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig and component_id of every row of docs."""
    rows, comps = set_rows(docs)
    rows = rows.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    low = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("low"))
    return rows.join(low, "comp", "left").select("doc_id", "n", "sig", F.coalesce("low", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return _components(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; columns of docs. Equal rows of one id and text keep one row.

    Rows with one id and other texts are other documents: where ids repeat, the set's digest tells them apart.
    """
    found = stash(_components(docs).where("doc_id <> component_id").select("doc_id", "sig").distinct(), "dropped")
    rows = marked(docs, F.col("doc_id"), bit_words(found, "doc_id"))
    hit, rest = rows.where("__hit"), rows.where("not __hit").select(docs.columns)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return hit.join(found, "doc_id", "left_anti").select(docs.columns).unionByName(rest)

    @F.pandas_udf("long")
    def sig(texts: pd.Series) -> pd.Series:
        return pd.Series([set_digest(t) if len(t) else None for _, t in _batches(texts.to_frame("text"))], dtype="Int64")

    kept = hit.withColumn("__sig", sig("text")).join(found.withColumnRenamed("sig", "__sig"), ["doc_id", "__sig"], "left_anti")
    return kept.select(docs.columns).unionByName(rest).dropDuplicates(["doc_id", "text"])


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y)
SELECT x AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""
