"""Operator 10: SentencePiece encoding and decoding over a relational lattice.

A text becomes units: a space is written as the piece mark, a run of marks opens a unit, a line feed is a unit, and letters and other
characters part where no piece of the table joins them. Distinct units are the words of the lattice:

* bounded-length substrings of each word are exploded and equi-joined to the piece table (a vocabulary file of fixed size, so
  it may be broadcast); a character without a piece gets a byte-fallback edge;
* edges of a word stand together behind the join, as it keeps the order of rows; each task folds them in order of their end: the Viterbi step keeps for
  each position of all words of a batch the best score and its piece.

Words that are counted often in the corpus, ``FREQUENT`` at most and each of up to ``FREQUENT_LENGTH`` characters, are folded first and
broadcast to the tasks. Each other word is folded once, in the place where the shuffle by word has put it. Documents are dealt into
blocks of like size by id and text; a word's path goes to the blocks that need it and meets their documents there, which gives the
ids of whole texts. Which words count as frequent changes cost, not results.

Units of over ``CUT_ABOVE`` characters (text without spaces) are cut again between any two characters that stand next to each other in no
piece, where no edge can cross. What is still longer than ``LONG`` takes a way of its own, linear in its length: windows of LONG starts are exploded and joined
like words, edges are grouped by unit and window, and the fold keeps the scores of the last window only and lays finished ones aside.

Scores: the vocabulary at hand is of the merge kind, whose scores are ranks, not log-probabilities. A Viterbi path over ranks
splits common words, so a rank r counts as log-probability -ln(r + RANK_SHIFT) - 5, and the result is the best unigram path
over the model's pieces. It is not the library's merge order; both decode to the same text.

Decoding looks up each id's bytes, writes marks as spaces, joins byte pieces and drops the first space; it returns the text
exactly, a literal piece mark included (it goes by bytes).

Defined cases: null text has null ids in ``encode`` and counts 0 in the query; empty text has no ids; very long texts, with or without
spaces, are encoded whole, and nothing is cut at a length; of paths with equal score the one with the longer last piece wins; repeated rows keep
their rows, null and repeated ids included; ids may have any type; columns beside id and text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, parts_for

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a literal mark while pieces are looked up; no piece holds it.
OTHER = "\ue000"
RANK_SHIFT = 1000
FALLBACK = -60.0
BLOCK_BYTES = 8 << 20
#: Edges that are folded, and ids that are decoded, at once, about.
FOLDED, DECODED = 1 << 16, 1 << 16
#: Words that are folded once for all blocks and broadcast, at most, and their length in characters, at most.
FREQUENT = 1 << 17
FREQUENT_LENGTH = 32
#: A word counts in a part of COUNT_BYTES of text if it stands there so often, at least.
COUNT_LEAST, COUNT_BYTES = 3, 4 << 20
#: Words that are not frequent and that a task holds before it gives them on, about.
HELD = 1 << 16
#: Partitions that blocks are dealt over, at most.
MOST_PARTS = 100_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNITS = rf"\n|{MARK}*[{_LETTER}]+|{MARK}*[^{_LETTER}{MARK}\n]+|{MARK}+"
#: Units for tables with pieces that hold both letters and other characters.
_WHOLE = rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+"
#: Units above this length are cut where no piece joins two characters; longer ones than LONG are folded by windows.
CUT_ABOVE, LONG = 32, 256


class PieceTable:
    """Pieces of a model file, read on the driver."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rows: list[tuple[str, int, float]] = []
        self.raw: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                self.rows.append((piece, i, -math.log(RANK_SHIFT - model.get_score(i)) - 5))
        self.spelled = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.scores = [FALLBACK] * model.get_piece_size()
        for _, i, score in self.rows:
            self.scores[i] = score
        sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        #: The bytes of all pieces one after the other, and where those of each begin and end.
        self.bytes, self.begins, self.ends = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes)
        self.longest = max(len(p) for p, _, _ in self.rows)
        cut = re.compile(_UNITS).fullmatch
        #: No piece may span two units: then the best path of a text is that of its units, one after the other.
        self.units = _UNITS if all(cut(p) for p, _, _ in self.rows) else _WHOLE
        #: Characters that stand next to each other in some piece.
        self.joined = {p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)}

    def cutter(self) -> Callable[[Collection[str]], Collection[str]]:
        """Cuts long ones of units where no piece joins two characters."""
        joined = self.joined

        def cut(units: Collection[str]) -> Collection[str]:
            if max(map(len, units), default=0) <= CUT_ABOVE:
                return units
            out = []
            for u in units:
                begin = 0
                if len(u) > CUT_ABOVE:
                    for i in range(1, len(u)):
                        if u[i - 1 : i + 1] not in joined:
                            out.append(u[begin:i])
                            begin = i
                out.append(u[begin:])
            return out

        return cut

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(self.rows, columns=["sub", "id", "score"]), "sub string, id int, score double")

    def decode(self, ids: np.ndarray) -> str:
        def part(own: np.ndarray) -> bytes:
            begins, sizes = self.begins[own], self.ends[own] - self.begins[own]
            ends = np.cumsum(sizes)
            return self.bytes[np.arange(ends[-1]) + np.repeat(begins - ends + sizes, sizes)].tobytes()

        return b"".join([part(ids[i : i + DECODED]) for i in range(0, len(ids), DECODED)])[1:].decode("utf-8", "surrogatepass")


def marked_text(text: Column) -> Column:
    """The text with a mark in front and for each space; a literal mark becomes another character, told apart later by its place."""
    return F.when(F.length(text) > 0, F.concat(F.lit(MARK), F.translate(text, MARK + " ", OTHER + MARK)))


def may_be_long(text: Column) -> Column:
    """False for texts that surely have no unit longer than LONG: half of such a unit at least is marks, or characters between spaces."""
    return F.contains(text, F.lit(" " * (LONG // 2))) | F.exists(F.split(text, " "), lambda x: F.length(x) >= LONG // 2)


def _edge(start: Column, size: Column, sub: str) -> Column:
    """An edge as one number: its end, its start back from the end (less than 2^8) and id + 2^22 in 21, 8 and 24 bits or more, so that edges sort by end and take little room. A negative id is a code point that goes by bytes."""
    end = F.shiftleft((start + size).cast("long"), 32).bitwiseOR(F.shiftleft(F.lit(255) - size, 24).cast("long").bitwiseAND((1 << 32) - 1))
    return end.bitwiseOR((F.coalesce("id", -F.ascii(sub)) + (1 << 22)).cast("long"))


def _place(x: Column) -> Column:
    """The start of an edge."""
    return (F.shiftright(x, 32) - 255 + F.shiftright(x, 24).bitwiseAND(255)).cast("int")


def _piece(x: Column) -> Column:
    return x.bitwiseAND((1 << 24) - 1).cast("int") - (1 << 22)


def _edges(spans: DataFrame, table: PieceTable) -> DataFrame:
    """spans (with sub and l) that are pieces, or single characters, with the id of the piece."""
    known = table.frame(spans.sparkSession).withColumnRenamed("sub", "piece").withColumn("key", F.xxhash64("piece"))
    spans = spans.withColumn("key", F.xxhash64("sub"))  # a number as the only key makes the lookup cheap; the pieces themselves decide behind it
    spans = spans.join(F.broadcast(known), spans["key"] == known["key"], "left").where("piece = sub or l = 1")
    return spans.withColumns({c: F.when(F.col("piece") == F.col("sub"), F.col(c)) for c in ("id", "score")})


def _folded(first: np.ndarray, edges: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the best paths of some words, and how many each has. first: whether an edge is its word's first; scores: by id, the one of characters without a piece behind them."""
    word = np.cumsum(first) - 1
    end, size, ids = edges >> 32, 255 - (edges >> 24 & 255), ((edges & (1 << 24) - 1) - (1 << 22)).astype(np.int32)
    order = np.lexsort((-size, word, end))  # of equal scores the longer last piece wins, so it stands first
    length = np.maximum.reduceat(end, np.flatnonzero(first))
    base = np.cumsum(length + 1) - length - 1  # of each word's places 0 to length
    to = (base[word] + end)[order]
    since = to - size[order]
    score = scores[np.where(ids < 0, len(scores) - 1, ids)[order]]
    best, taken = np.zeros(base[-1] + length[-1] + 1), np.zeros(base[-1] + length[-1] + 1, np.int64)
    for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(end[order])) + 1):
        value, place = best[since[part]] + score[part], to[part]
        begins = np.flatnonzero(np.diff(place, prepend=-1))
        most = np.maximum.reduceat(value, begins)
        hit = np.flatnonzero(value == np.repeat(most, np.diff(begins, append=len(place))))
        hit = hit[np.diff(place[hit], prepend=-1) != 0]  # the first of each place
        best[place[hit]], taken[place[hit]] = most, part[hit]
    own, at, found = np.arange(len(base)), base + length, []
    while len(own):  # from the ends of all words back to their starts
        edge = taken[at]
        found.append((own, edge))
        left = since[edge] > base[own]
        own, at = own[left], since[edge][left]
    own, edge = (np.concatenate([x[i] for x in found][::-1]) for i in (0, 1))
    return ids[order][edge[np.argsort(own, kind="stable")]], np.bincount(own, minlength=len(base))


def folded_paths(words: DataFrame, table: PieceTable) -> DataFrame:
    """(blocks, path): the best path of each of words (word, blocks), which are LONG characters long at most, as 32-bit numbers. The ids spell the word."""
    spans = words.select("word", "blocks", F.length("word").alias("n")).select("blocks", "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.col("n") - F.col("s")))).alias("l")
    spans = spans.select("blocks", "word", "s", size).withColumn("sub", F.substring("word", F.col("s") + 1, F.col("l")))
    # a word's first edge is its first character, which tells words apart and holds what belongs to the word
    edges = _edges(spans, table).select(F.when((F.col("s") == 0) & (F.col("l") == 1), F.col("blocks")).alias("blocks"), _edge(F.col("s"), F.col("l"), "sub").alias("edge"))
    scores = np.array([*table.scores, FALLBACK])

    def done(batch: pa.Table) -> pa.RecordBatch:
        ids, count = _folded(batch["blocks"].is_valid().to_numpy(), batch["edge"].to_numpy(), scores)
        data, ends = ids.tobytes(), (4 * np.cumsum(count)).tolist()
        paths = pa.array([data[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([batch["blocks"].drop_null().combine_chunks(), paths], ["blocks", "path"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= FOLDED:
                own = pa.Table.from_batches(held)
                last = int(np.flatnonzero(own["blocks"].is_valid().to_numpy())[-1])
                if last:
                    yield done(own[:last])
                held = own[last:].to_batches()  # a word that may go on in the next batch
                rows = sum(map(len, held))
        if rows:
            yield done(pa.Table.from_batches(held))

    return edges.mapInArrow(fold, f"blocks {words.schema['blocks'].dataType.simpleString()}, path binary")


def best_paths(words: DataFrame, table: PieceTable) -> DataFrame:
    """``folded_paths`` with ids as an array."""

    @F.pandas_udf("array<int>")
    def ids(paths: pd.Series) -> pd.Series:
        return paths.map(lambda x: np.frombuffer(x, np.int32))

    return folded_paths(words, table).select("blocks", ids("path").alias("ids"))


def long_paths(windows: DataFrame, table: PieceTable) -> DataFrame:
    """(blocks, path) of units of any length from their windows (unit, off, sub_text, blocks): LONG starts each, with the characters that pieces from there may take.

    Spark's fold copies its state in each step. So a fold over the windows holds what is finished, as an array a window, and a fold within each
    window holds the scores of that window and of the last places before it only; the way back does the same.
    """
    own = windows.withColumn("n", F.length("sub_text"))
    spans = own.select("unit", "off", "blocks", "sub_text", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(LONG), F.col("n")) - 1)).alias("s"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.col("n") - F.col("s")))).alias("l")
    spans = spans.select("unit", "blocks", (F.col("off") + F.col("s")).alias("s"), size, F.substring("sub_text", F.col("s") + 1, F.col("l")).alias("sub"))
    edges = _edges(spans, table).select("unit", "blocks", F.floor((F.col("s") + F.col("l") - 1) / LONG).alias("part"), F.struct(_edge(F.col("s"), F.col("l"), "sub").alias("edge"), F.coalesce("score", F.lit(FALLBACK)).alias("score")).alias("edge"))
    parts = edges.groupBy("unit", "blocks", "part").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    units = parts.groupBy("unit", "blocks").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "edges"))), lambda p: p["edges"]).alias("parts"))
    more = 2 * table.longest

    def step(tail: Column, scored: Column, base: Column) -> Column:
        """tail: pairs of score and edge of the places from base on (an edge has 53 bits, exact as a double)."""
        x = scored["edge"]
        score = F.get(tail, 2 * (_place(x) - base)) + scored["score"]
        put = lambda to: F.concat(to, F.array(score, x.cast("double")))
        first = F.size(tail) == 2 * (F.shiftright(x, 32).cast("int") - base)
        return F.when(first, put(tail)).when(score > F.element_at(tail, -2), put(F.slice(tail, F.lit(1), F.size(tail) - 2))).otherwise(tail)

    def window(acc: Column, part: Column) -> Column:
        def end(tail: Column) -> Column:
            held = F.least(F.lit(more), F.size(tail))
            new = F.slice(tail, F.size(acc["tail"]) + 1, F.size(tail) - F.size(acc["tail"]))
            base = acc["base"] + F.shiftright(F.size(tail) - held, 1)
            return F.struct(F.slice(tail, F.size(tail) - held + 1, held).alias("tail"), base.alias("base"), F.array_append(acc["done"], new).alias("done"))

        return F.aggregate(part, acc["tail"], lambda tail, x: step(tail, x, acc["base"]), end)

    zero = F.array(F.lit(0.0), F.lit(0.0))
    start = F.struct(zero.alias("tail"), F.lit(0).alias("base"), F.array().cast("array<array<double>>").alias("done"))
    states = F.aggregate("parts", start, window, lambda acc: acc["done"])  # window k has the places from k LONG + 1 on

    def back(acc: Column, k: Column) -> Column:
        """acc: the place to go on from, and the edges taken in each window, the last ones first."""
        own = F.element_at("states", k + 1)

        def take(now: Column, i: Column) -> Column:
            edge = F.get(own, 2 * i + 1).cast("long")
            return F.when(now["need"] == k * LONG + i + 1, F.struct(_place(edge).alias("need"), F.array_append(now["out"], edge).alias("out"))).otherwise(now)

        places = F.sequence(F.shiftright(F.size(own), 1) - 1, F.lit(0), F.lit(-1))
        begin = F.struct(acc["need"].alias("need"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(places, begin, take, lambda now: F.struct(now["need"].alias("need"), F.array_append(acc["outs"], now["out"]).alias("outs")))

    last = (F.size("states") - 1) * LONG + F.shiftright(F.size(F.element_at("states", -1)), 1)
    begin = F.struct(last.alias("need"), F.array().cast("array<array<bigint>>").alias("outs"))
    path = F.aggregate(F.sequence(F.size("states") - 1, F.lit(0), F.lit(-1)), begin, back, lambda acc: F.transform(F.reverse(F.flatten(acc["outs"])), _piece))
    paths = units.select("blocks", states.alias("states")).select("blocks", path.alias("ids"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"blocks": pdf["blocks"], "path": [np.asarray(x, np.int32).tobytes() for x in pdf["ids"]]})

    return paths.mapInPandas(packed, f"blocks {windows.schema['blocks'].dataType.simpleString()}, path binary")


def even_labels(spark: SparkSession, parts: int) -> list[int]:
    """A number for each partition of a hash repartition into parts, so that blocks fill partitions evenly."""
    ids = spark.range(12 * parts + 200).select(F.col("id").cast("int").alias("i"))
    rows = ids.groupBy(F.pmod(F.hash("i"), F.lit(parts)).alias("p")).agg(F.min("i").alias("i")).collect()  # parts rows at most
    return sorted(r["i"] for r in rows)


def counted(docs: DataFrame, table: PieceTable, text: str) -> DataFrame:
    """(word, n): how often units of up to FREQUENT_LENGTH characters stand in the corpus, those apart that are rare in every part of it."""
    find = re.compile(table.units).findall

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, size = Counter(), 0

        def often() -> pd.DataFrame:
            return pd.DataFrame([(w, n) for w, n in seen.items() if n >= COUNT_LEAST and len(w) <= FREQUENT_LENGTH], columns=["word", "n"])

        for pdf in batches:
            for t in pdf["text"]:
                if isinstance(t, str) and t:
                    seen.update(find(spaced(t)))
                    size += len(t)
                    if size >= COUNT_BYTES:
                        yield often()
                        seen, size = Counter(), 0
        yield often()

    parts = map_texts(docs.select(F.col(text).alias("text")), work, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def spaced(text: str) -> str:
    """``marked_text`` of one text."""
    return MARK + text.replace(MARK, OTHER).replace(" ", MARK)


def by_bytes(ids: list[int], others: Iterator[str], byte_ids: list[int]) -> bytes:
    """The ids as little-endian 32-bit numbers, characters without a piece by their bytes; others gives the characters that stand-ins stand for."""
    chars = ((i, "" if i >= 0 else next(others) if chr(-i) == OTHER else chr(-i)) for i in ids)
    return np.array([j for i, c in chars for j in ([i] if i >= 0 else [byte_ids[b] for b in c.encode("utf-8", "surrogatepass")])], np.int32).tobytes()


def frequent_words(docs: DataFrame, table: PieceTable, text: str, most: int = FREQUENT) -> dict[str, bytes]:
    """Ids of the words that stand most often in the corpus; at most ``most`` words of bounded length reach the driver."""
    words = counted(docs, table, text).orderBy(F.desc("n"), "word").limit(most).select("word", F.lit(0).alias("blocks"))
    words = words.repartition(parts_for(most, 8192, 8), "word")
    found, odd = spelled_paths(folded_paths(words, table).select("path").toArrow()["path"].to_pylist(), table.spelled, table.byte_ids)
    return {w: path for w, path in found.items() if w not in odd}


def spelled_paths(paths: list[bytes], spelled: list[str], byte_ids: list[int]) -> tuple[dict[str, bytes], dict[str, list[int]]]:
    """The words that paths spell with their ids, and the ids of those that hold a stand-in."""
    flat = np.frombuffer(b"".join(paths), np.int32)
    parts = [spelled[i] if i >= 0 else chr(-i) for i in flat.tolist()]
    ends = (np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths))) // 4).tolist()
    known = {"".join(parts[a:b]): path for a, b, path in zip([0, *ends], ends, paths, strict=False)}
    odd = {}
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), "right")).tolist():
        ids = np.frombuffer(paths[k], np.int32).tolist()
        word = "".join([spelled[i] if i >= 0 else chr(-i) for i in ids])
        known[word] = by_bytes(ids, repeat(MARK), byte_ids)
        if OTHER in word:
            odd[word] = ids
    return known, odd


def encode_with(docs: DataFrame, table: PieceTable, finish: Callable[[str | None, np.ndarray | None], tuple], schema: str, *, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """A row doc_id and finish(text, ids) for every row of docs. schema: finish's columns."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    labels = even_labels(spark, parts_for(int(size), BLOCK_BYTES, 8, MOST_PARTS))
    # a block is told by id and text, so that rows of one id, or of none, spread as their texts do
    block = F.get(F.lit(np.array(labels, np.int32)), F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(len(labels))).cast("int"))
    shared = spark.sparkContext.broadcast(frequent_words(docs, table, text, frequent))
    raw, cut, byte_ids, spelled, longest = re.compile(table.units).findall, table.cutter(), table.byte_ids, table.spelled, table.longest

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The long units of texts that may have some."""
        for pdf in batches:
            for t, b in zip(pdf["text"], pdf["block"], strict=True):
                for u in {u for u in cut(raw(spaced(t))) if len(u) > LONG}:
                    unit = hashlib.sha256(u.encode("utf-8", "surrogatepass")).digest()
                    yield pd.DataFrame([(unit, i, u[i : i + LONG + longest - 1], b) for i in range(0, len(u), LONG)], columns=["unit", "off", "sub_text", "block"])

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The words of each block that are not frequent, once for each HELD of them."""
        always = shared.value
        own: dict[int, set[str]] = {}

        def held() -> pd.DataFrame:
            count = [len(w) for w in own.values()]
            return pd.DataFrame({"word": [w for words in own.values() for w in words], "block": np.repeat(np.array(list(own), np.int32), count)})

        for pdf in batches:
            for t, b in zip(pdf["text"], pdf["block"], strict=True):
                if isinstance(t, str) and t:
                    found = cut(set(raw(spaced(t))).difference(always))
                    own.setdefault(b, set()).update([u for u in found if len(u) <= LONG and u not in always])
            if sum(map(len, own.values())) >= HELD:
                yield held()
                own = {}
        yield held()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[zlib.compress(t.encode("utf-8", "surrogatepass"), 6) if isinstance(t, str) else None for t in pdf["text"]])

    words = map_texts(docs.select(F.col(text).alias("text"), block.alias("block")), rare, "word string, block int")
    words = words.groupBy("word").agg(F.collect_set("block").alias("blocks"))  # no more than there are blocks
    runs = docs.select(F.col(text).alias("text"), block.alias("block")).where(may_be_long(F.col("text")))
    pieces = map_texts(runs, windows, "unit binary, off int, sub_text string, block int").groupBy("unit", "off", "sub_text").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    paths = folded_paths(words, table).unionByName(long_paths(pieces, table)).select(F.explode("blocks").alias("place"), "path")
    kind = docs.schema[doc_id].dataType.simpleString()
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), block.alias("block"))
    dealt = map_texts(dealt, packed, f"doc_id {kind}, text binary, block int").repartition(len(labels), "block")
    names = [c.split()[0] for c in schema.split(", ")]

    def whole(texts: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        known, odd = spelled_paths(paths["path"].tolist(), spelled, byte_ids)
        known |= shared.value
        out = []
        for data in texts["text"]:
            text = ids = None
            if data is not None:
                text = zlib.decompress(data).decode("utf-8", "surrogatepass")
                units = raw(spaced(text)) if text else []
                if OTHER in text:  # a text that holds the stand-in itself: its places are told apart
                    places = iter([c for c in text if c in (MARK, OTHER)])
                    parts = [by_bytes(odd[u], places, byte_ids) if u in odd else known[u] for u in cut(units)]
                else:
                    try:
                        parts = list(map(known.__getitem__, units))
                    except KeyError:  # a unit that is cut; none such is a word
                        parts = list(map(known.__getitem__, cut(units)))
                ids = np.frombuffer(b"".join(parts), np.int32)
            out.append(finish(text, ids))
        return pd.concat([texts[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return dealt.groupBy("block").cogroup(paths.groupBy("place")).applyInPandas(whole, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, table: PieceTable, **names) -> DataFrame:
    """doc_id and ids of every row."""
    return encode_with(docs, table, lambda text, ids: (None if ids is None else ids.tolist(),), "ids array<int>", **names)


def decode(rows: DataFrame, table: PieceTable, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids; null ids give null."""

    @F.pandas_udf("string")
    def back(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else table.decode(np.asarray(x, np.int64)))

    return rows.withColumn(text, back(ids))


def digest(table: PieceTable) -> Callable[[str | None, np.ndarray | None], tuple]:
    """Counts, an md5 of the ids as little-endian 32-bit numbers, and whether decoding gives the text back."""

    in_bytes = np.zeros(len(table.raw), bool)
    in_bytes[table.byte_ids] = True

    def finish(text: str | None, ids: np.ndarray | None) -> tuple:
        if ids is None:
            return 0, 0, hashlib.md5(b"").hexdigest(), True
        return len(ids), int(in_bytes[ids].sum()), hashlib.md5(ids.astype("<i4").tobytes()).hexdigest(), table.decode(ids) == text

    return finish


DIGEST = "n_pieces long, n_bytes_pieces long, ids_md5 string, round_trip boolean"


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    table = PieceTable()
    return encode_with(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), table, digest(table), DIGEST)
