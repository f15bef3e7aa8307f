"""Operator 12: conversation structure repair by shortest paths over edits.

A row of a conversation is kept (cost 0), gets the role user or assistant (3) or is deleted (4, the only way for blank rows and repeats of
an earlier role and text); an empty row of user or assistant may be inserted anywhere (3); a truncated row that stays costs 3 more. Wanted is
the cheapest edit after which the initials of the roles are ``(s?(ua)+)?``, of those with equal cost the one whose initials (D, I, K, R) are
least in ASCII. Nodes are pairs of a place between rows and one of four states of that pattern; costs are small integers, so Dial's
bucket queue records all distances to the end in linear time; the audit is the walk from the start along tight arcs
(those whose cost is the difference of the distances), the least letter first.

How it runs on Spark, whatever the size of one conversation:

* Light rows (order, initial, faults; a digest for the text) are range-partitioned in conversation order and leave as pieces, one byte a
  row, up to ``PIECE`` rows each, so that a conversation may span many pieces and tasks. A piece that is a whole conversation is solved at once.
* For every other piece the distances from each state at its end to each state at its start (16 numbers) are recorded by Dial's queue. A pass
  over these matrices from the last piece to the first gives each piece the distances at its end; all pieces are then walked in parallel from
  every state they may be entered in, and a pass from first to last picks the walk that the one before leads to. Both passes keep one
  piece's numbers.
* The repaired text is digested by streaming a conversation's rows, sorted by Spark, past its audit: a digest is sequential, so
  this pass alone takes a conversation through one task, with one row in memory at a time.

Order within a conversation: turn (nulls first), then role, then digest of the text; rows equal in all of these follow each other.

Defined cases: null roles and texts become one space (so a null text is blank, and such a role can only be replaced or deleted); an empty
role has no initial and cannot be kept either, it makes its neighbours illegal; null ids form one conversation; ids may have any type;
very long texts are streamed whole; repeated rows count as often as they stand; columns beside the four play no part, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stash

#: Rows of a piece, at most (more only where one row is repeated).
PIECE = 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user row, after an assistant row. NEXT[state][initial] is the state then.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that may follow each state by an insertion or a new role, and the state then.
ADDED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
GOAL: tuple[int | None, ...] = (0, None, None, 0)
NONE = 1 << 60
#: Codes of rows: 0 to 7, the place of the initial in INITIALS + 4 if truncated, or GONE for blank rows and repeats.
INITIALS, GONE = "sua", 8
_DIAL = 8  # more than the largest cost of an arc


def _arcs() -> list[list[list[tuple[int, str, int]]]]:
    """By code and state: (cost, letter, next state) of the arcs that use up the row, least letter first."""
    out = []
    for code in range(GONE + 1):
        row = [[(DELETE, "D", s)] for s in range(4)]
        if code != GONE:
            more = TRUNCATED if code >= 4 else 0
            for s in range(4):
                if code % 4 < 3 and (to := NEXT[s].get(INITIALS[code % 4])) is not None:
                    row[s].append((KEEP + more, "K", to))
                row[s].append((REROLE + more, "R", ADDED[s][1]))
        out.append(row)
    return out


ARCS = _arcs()
#: By code: (cost, state before, state after) of the same arcs, as they are gone through from the end.
_BACK = [[[(c, s) for s in range(4) for c, _, to in ARCS[code][s] if to == t] for t in range(4)] for code in range(GONE + 1)]
_INSERTED = [[s for s in range(4) if ADDED[s][1] == t] for t in range(4)]


def distances(codes: bytes, end: list[int | None] | tuple) -> list[int]:
    """Distance from node 4 * place + state to the end, whose states have the distances given (None: no way); Dial's buckets in a ring."""
    n = len(codes)
    dist = [NONE] * (4 * n + 4)
    low = min((d for d in end if d is not None), default=None)
    if low is None:
        return dist
    # distances of the end spread wider than the ring: these nodes wait, in order, until the ring gets there
    waiting = sorted(((d, 4 * n + s) for s, d in enumerate(end) if d is not None), reverse=True)
    ring: list[list[int]] = [[] for _ in range(_DIAL)]
    now, filled = low, 0
    while filled or waiting:
        if not filled:
            now = max(now, waiting[-1][0])
        while waiting and waiting[-1][0] == now:
            d, node = waiting.pop()
            if d < dist[node]:
                dist[node] = d
                ring[now % _DIAL].append(node)
                filled += 1
        bucket = ring[now % _DIAL]
        while bucket:
            node = bucket.pop()
            filled -= 1
            if dist[node] != now:
                continue  # a shorter way came first
            place, state = node >> 2, node & 3
            if place:
                base = 4 * place - 4
                for cost, before in _BACK[codes[place - 1]][state]:
                    if now + cost < dist[base + before]:
                        dist[base + before] = now + cost
                        ring[(now + cost) % _DIAL].append(base + before)
                        filled += 1
            for before in _INSERTED[state]:
                if now + INSERT < dist[4 * place + before]:
                    dist[4 * place + before] = now + INSERT
                    ring[(now + INSERT) % _DIAL].append(4 * place + before)
                    filled += 1
        now += 1
    return dist


def walk(codes: bytes, dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least tight walk from state at the first place, and the state at its end. Insertions at the end belong to the last piece."""
    n, place, out = len(codes), 0, []
    while place < n or last and dist[4 * place + state]:
        here = dist[4 * place + state]
        steps = [(letter, 4 * place + 4 + to, cost) for cost, letter, to in ARCS[codes[place]][state]] if place < n else []
        steps.append(("I", 4 * place + ADDED[state][1], INSERT))
        letter, node, _ = min(s for s in steps if dist[s[1]] + s[2] == here)
        out.append(letter)
        place, state = node >> 2, node & 3
    return "".join(out), state


def matrix(codes: bytes) -> list[int]:
    """Distances through a piece, at 4 * state at its start + state at its end."""
    ways = [distances(codes, [0 if s == e else None for s in range(4)])[:4] for e in range(4)]
    return [ways[e][s] for s in range(4) for e in range(4)]


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    dist = distances(codes, GOAL)
    return dist[0], walk(codes, dist, 0, True)[0]


_FINE = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """rows without those dropped: by a checksum of id and turn some are emptied, some lose their marks of sentence ends, some repeat, some go to the user.

    The columns conv_id, turn, role, text and times (how often the row stands there).
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


#: The order of rows. conv spells the id, some is 0 where there is no turn; no column is null.
ORDER = ["conv", "some", "turn", "role", "digest"]
#: What a conversation is told apart by: the id as a string behind a mark, or the mark of a null id.
_CONV = "coalesce('=' || cast(conv_id as string), 'null')"
COUNTS = ["illegal", "blank", "duplicate", "truncated", "cost"]


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text and maybe times) under ORDER, with nulls replaced."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    turn = F.col("turn").cast("long")
    return rows.select(F.expr(_CONV).alias("conv"), turn.isNotNull().cast("int").alias("some"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"), times.cast("long").alias("times"))


def light_rows(rows: DataFrame) -> DataFrame:
    """ORDER, blank, cut, times and again: one row for rows equal in order, how many these are, and whether role and text stood earlier."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = rows.select(*ORDER, "times", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    own = own.groupBy(*ORDER, "blank", "cut").agg(F.sum("times").alias("times"))
    many = own.where("not blank").groupBy("conv", "role", "digest").agg(F.min(F.struct("some", "turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("first").isNotNull() & (F.col("first") != F.struct("some", "turn"))
    return own.join(many, ["conv", "role", "digest"], "left").select(*ORDER, "blank", "cut", "times", F.coalesce(again, F.lit(False)).alias("again"))


_PIECE = "conv string, some int, turn long, role string, digest binary, piece long, codes binary, open boolean, first string, last string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, ways array<long>"
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


class _Piece:
    """A piece as it grows."""

    def __init__(self, key: tuple, part: int):
        self.key, self.part, self.codes = key, part, bytearray()
        self.first, self.last = key[3][:1], None
        self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, initial: str, times: int, blank: bool, cut: bool, again: bool) -> None:
        if self.last is not None and self.last + initial not in _FINE:
            self.illegal += 1
        self.illegal += times - 1  # no role may follow itself
        self.last = initial
        kept = 0 if blank or again else 1
        if kept:
            place = INITIALS.find(initial) if initial else -1
            self.codes.append((3 if place < 0 else place) + (4 if cut else 0))
            self.truncated += int(cut)
        self.codes += bytes([GONE]) * (times - kept)
        if blank:
            self.blank += times
        else:
            self.duplicate += times - kept

    def row(self, number: int, whole: bool) -> tuple:
        codes = bytes(self.codes)
        cost, audit = solve(codes) if whole else (None, None)
        counts = (self.illegal, self.blank, self.duplicate, self.truncated)
        return (*self.key, self.part << 32 | number, codes, not whole, self.first, self.last, *counts, cost, audit, None if whole else matrix(codes))


def pieces_of(light: DataFrame, most: int = PIECE) -> DataFrame:
    """Pieces of conversations in order: ORDER of the first row, a byte a row, counts; solved, or with the matrix of one that may not be whole."""
    parts = int(light.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = light.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id().cast("long"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, number = None, 0
        edge = True  # the conversation may have begun in another piece
        for pdf in batches:
            done = []
            for *key, blank, cut, times, again, part in pdf.itertuples(index=False, name=None):
                if piece is not None and (piece.key[0] != key[0] or len(piece.codes) >= most):
                    whole = piece.key[0] != key[0] and not edge
                    done.append(piece.row(number, whole))
                    edge = piece.key[0] == key[0]
                    piece, number = None, number + 1
                if piece is None:
                    piece = _Piece(tuple(key), int(part))
                piece.add(key[3][:1], int(times), bool(blank), bool(cut), bool(again))
            yield pd.DataFrame(done, columns=_NAMES)
        if piece is not None:
            yield pd.DataFrame([piece.row(number, False)], columns=_NAMES)  # it may go on in the next partition

    return dealt.mapInPandas(work, _PIECE)


def _fold(rows: DataFrame, descending: bool, step: Callable, schema: str) -> DataFrame:
    """Streams the pieces of each conversation in order past a state: step(state or None, row) gives the next state and output values."""
    names = ["piece", *(c.split()[0] for c in schema.split(", "))]
    dealt = rows.repartition("conv").sortWithinPartitions("conv", F.col("piece").desc() if descending else "piece")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.conv != conv:
                    conv, state = row.conv, None
                state, values = step(state, row)
                out.append((row.piece, *values))
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(work, f"piece long, {schema}")


def _ends(state, row):
    """From the last piece to the first: the distances at a piece's end, and from them those at its start (-1: no way)."""
    end = list(GOAL) if state is None else state
    start = [min((int(row.ways[4 * s + e]) + d for e, d in enumerate(end) if d is not None), default=NONE) for s in range(4)]
    start = [None if d >= NONE else d for d in start]
    return start, ([-1 if d is None else d for d in end], state is None, start[0])


def _picks(state, row):
    """From the first piece to the last: the walk from the state in which the one before ends, and whether the roles at the border are illegal neighbours."""
    entry, initial, cost = (0, None, row.total) if state is None else (*state, 0)
    border = int(initial is not None and initial + row.first not in _FINE)
    return (int(row.exits[entry]), row.last), (row.walks[entry], border, cost)


def linked(opened: DataFrame) -> DataFrame:
    """piece, walk, border and total of pieces that are parts of conversations; the total cost stands at the first."""
    ends = _fold(opened.select("conv", "piece", "ways"), True, _ends, "ends array<long>, final boolean, total long")
    rows = opened.select("conv", "piece", "codes", "first", "last").join(ends, "piece")

    @F.pandas_udf("exits array<int>, walks array<string>")
    def walked(codes: pd.Series, ends: pd.Series, final: pd.Series) -> pd.DataFrame:
        out = []
        for c, e, last in zip(codes, ends, final, strict=True):
            dist = distances(c, [None if d < 0 else int(d) for d in e])
            out.append([walk(c, dist, s, bool(last)) if dist[s] < NONE else (None, 0) for s in range(4)])
        return pd.DataFrame({"exits": [[x[1] for x in found] for found in out], "walks": [[x[0] for x in found] for found in out]})

    rows = rows.withColumn("w", walked("codes", "ends", "final")).select("conv", "piece", "first", "last", "total", "w.exits", "w.walks")
    return _fold(rows, False, _picks, "walk string, border long, whole_cost long")


def audits(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """ORDER, piece, audit and COUNTS of the pieces of ``ordered`` rows, as a table of the shared folder."""
    pieces = stash(pieces_of(light_rows(rows), most), "conversation-pieces")
    own = pieces.drop("codes", "ways").join(linked(pieces.where("open")), "piece", "left")
    own = own.withColumns({"audit": F.coalesce("walk", "audit"), "cost": F.coalesce("whole_cost", "cost"), "illegal": F.col("illegal") + F.coalesce("border", F.lit(0))})
    out = stash(own.select(*ORDER, "piece", "audit", *COUNTS), "conversation-audits")
    forget(pieces)
    return out


class _Repair:
    """Applies audits to the rows of one conversation after the other; put takes each repaired row."""

    def __init__(self, put: Callable[[str, str, str], None]):
        self.put, self.conv, self.letters, self.at, self.state = put, None, "", 0, 0

    def added(self, text: str, letter: str) -> None:
        role, self.state = ADDED[self.state]
        self.put(role, text, letter)

    def flush(self) -> None:
        """Insertions that are left behind the last row of a piece."""
        for _ in range(self.at, len(self.letters)):
            self.added("", "I")
        self.letters, self.at = "", 0

    def begin(self, conv: str, letters: str) -> None:
        if conv != self.conv:
            self.conv, self.state = conv, 0
        self.letters, self.at = letters, 0

    def row(self, role: str, text: str) -> None:
        while (letter := self.letters[self.at]) == "I":
            self.at += 1
            self.added("", "I")
        self.at += 1
        if letter == "R":
            self.added(text, "R")
        elif letter == "K":
            self.state = NEXT[self.state][role[:1]]
            self.put(role, text, "K")


def _streamed(rows: DataFrame, pieces: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Streams each conversation's rows past its audits, sorted by Spark. make() gives put(conv, role, text, letter), end(conv) and the list of output rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = [*ORDER, "tag", "words", "times"]
    parts = pieces.select(*ORDER, F.lit(0).alias("tag"), F.col("audit").alias("words"), F.lit(0).cast("long").alias("times"))
    both = parts.unionByName(rows.select(*ORDER, F.lit(1).alias("tag"), F.col("text").alias("words"), "times")).select(*columns)
    dealt = both.repartition("conv").sortWithinPartitions(*ORDER, "tag").select("conv", "role", "tag", "words", "times")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put, end, out = make()
        now = _Repair(lambda role, text, letter: put(now.conv, role, text, letter))
        for pdf in batches:
            for conv, role, tag, words, times in pdf.itertuples(index=False, name=None):
                if not tag:
                    now.flush()
                    if now.conv is not None and conv != now.conv:
                        end(now.conv)
                    now.begin(conv, words)
                for _ in range(times):
                    now.row(role, words)
            yield pd.DataFrame(out, columns=names)
            out.clear()
        now.flush()
        if now.conv is not None:
            end(now.conv)
        yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(work, schema)


def _back(kind: str):
    """The id that conv spells."""
    return F.when(F.col("conv") != "null", F.substr("conv", F.lit(2)).cast(kind)).alias("conv_id")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text and edit (K, R or I) of the repaired conversations; rows has conv_id, turn, role and text."""

    def make():
        out, place = [], [0]

        def put(conv: str, role: str, text: str, letter: str) -> None:
            out.append((conv, place[0], role, text, letter))
            place[0] += 1

        return put, lambda conv: place.__setitem__(0, 0), out

    kept = ordered(rows)
    done = _streamed(kept, audits(kept), make, "conv string, place long, role string, text string, edit string")
    return done.select(_back(rows.schema["conv_id"].dataType.simpleString()), "place", "role", "text", "edit")


def _digests():
    out, state = [], [None]

    def put(conv: str, role: str, text: str, letter: str) -> None:
        first = state[0] is None
        state[0] = state[0] or hashlib.sha256()
        state[0].update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())

    def end(conv: str) -> None:
        out.append((conv, (state[0] or hashlib.sha256()).hexdigest()))
        state[0] = None

    return put, end, out


def repair_report(rows: DataFrame, every: DataFrame | None = None, most: int = PIECE) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, audit and digest of every conversation of rows, and of every conv_id of ``every``, which may have no rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    kept = ordered(rows)
    pieces = audits(kept, most)
    turns = kept.groupBy("conv", "some", "turn").agg(F.lit(1).alias("one"))
    known = F.when(F.col("some") == 1, F.col("turn"))
    gaps = turns.groupBy("conv").agg(F.coalesce(F.max(known) - F.min(known) + 1 - F.count(known), F.lit(0)).alias("gaps"))
    found = [gaps, pieces.select("conv", *COUNTS, F.struct("piece", "audit").alias("part")), _streamed(kept, pieces, _digests, "conv string, sha string")]
    if every is not None:
        found.append(every.select(F.expr(_CONV).alias("conv")).distinct())
    table = found[0]
    for other in found[1:]:
        table = table.unionByName(other, allowMissingColumns=True)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["audit"]), "")
    rows = table.groupBy("conv").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS)], whole.alias("audit"), F.max("sha").alias("sha"))
    sha = F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return rows.select(_back(kind), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(rows), rows)
