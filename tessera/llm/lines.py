"""Operator 4 [native]: fuzzy line dedup by MinHash.

A line's set holds its character shingles: every ``SHINGLE`` characters in a row of the lower-cased line, from each position on; a
shorter line is one shingle. The line is taken as code points of four bytes each, so that a shingle is cut out by its place, and a
shingle carries its hash; a minimum over the hash xor-ed with a constant picks a random member of the set, so
equal minima have the Jaccard similarity as their probability. Twelve of them, in six bands of two, bring lines together (at
similarity 0.75 a pair meets with probability 0.993, above it more often). In a band each line is paired first with the band's first
line and with the one before it; exact Jaccard on the sets decides, and distributed union-find gives components. Bands whose
lines still differ in component go on until no pair that may be similar is left untested across components: short ones pair by pair,
the lines of long ones by inverted lists over their rare shingles, which lose no similar pair. A pair leaves such a join only if sizes and
bitmaps allow it: a bitmap has the parity of the shingles at each bit, so two of them differ in no more bits than the sets in shingles, however full they are. Of each component, exact repeats included, only the first line in order of
(doc_id, line number) stays.

All column functions and joins. Minima come from a partial aggregate beside the scan; only lines that share a band travel as text,
and their sets are made where two of them meet. The first line of a component is a minimum, so no component is gathered.

Defined cases: null text has no line; lines without a word are never removed and never pair; repeated rows (id and text equal)
are one document, each row gets its result; rows with equal id and other text are ordered by a hash of the text; null ids stand first; a very
long line costs in proportion to its length; ids may be of any type that has an order; an empty table gives an empty result; a
document may end up empty; columns of the input keep their values, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_words, components, forget, free, marked, parts_for, stash

SHINGLE = 12
BANDS = 6
THRESHOLD = 0.75
#: Bands of up to so many lines have all pairs across components compared by bitmap; longer ones go by inverted lists.
SHORT = 64
#: Words of 64 bits in a line's bitmap.
SIGNS = 16
#: Pairs whose texts meet in one task, about: such rows are small but dear, so their bytes alone would put them in too few tasks.
MET = 10_000
#: Shingles of its line before it that a row of an inverted list holds, so that a pair comes from few of the lists that it shares.
BEFORE = 8
#: Shingles that one row of the signature pass takes: it bounds the length of an expression, not the work.
STEP = 8
# Constants that the shingle hashes are xor-ed with.
MASKS = [-7046029254386353131, 4354685564936845355, -4417276706812531889, 1609587929392839161, -2960836687068489003, 5545529020109919103, -49064778989728563, 8387220255154660723, -1800455987208640293, 2891336453234455763, -6562520338478146393, 3935559000370003845]


def points(line: Column) -> Column:
    """The lower-cased line as code points of four bytes."""
    return F.encode(F.lower(line), "UTF-32")


def last_start(data: Column) -> Column:
    """Where the last shingle of points starts, counted in characters."""
    return F.greatest(F.lit(0), F.shiftright(F.octet_length(data), 2) - SHINGLE)


def shingle(data: Column, start: Column) -> Column:
    return F.substring(data, start * 4 + 1, F.lit(4 * SHINGLE))


def shingles(line: Column) -> Column:
    """Hashes of a line's shingles in their order, repeats included."""
    whole = lambda data: F.transform(F.sequence(F.lit(1), 4 * last_start(data) + 1, F.lit(4)), lambda at: F.xxhash64(F.substring(data, at, F.lit(4 * SHINGLE))))
    return F.get(F.transform(F.array(points(line)), whole), 0)  # over an array of one, so that the points are made once


def shingle_set(line: Column) -> Column:
    """Hashes of a line's distinct shingles."""
    return F.array_distinct(shingles(line))


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, tie, i, line, h): the lines of each document that hold a word."""
    cut = F.posexplode(F.split(text, "\n")).alias("i", "line")
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("tie"), cut)
    # most lines tell by their first character, without a regular expression
    return rows.where((F.ascii("line") > 32) | F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def shingle_rows(lines: DataFrame, step: int, *keys: str) -> DataFrame:
    """(keys, x0, x1, ...): the hashes of step shingles a row; behind a line's last shingle that one comes again."""
    rows = lines.select(*keys, points(F.col("line")).alias("data")).withColumn("last", last_start(F.col("data")))
    rows = rows.select(*keys, "data", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(step))).alias("at"))
    return rows.select(*keys, *[F.xxhash64(shingle(F.col("data"), F.least(F.col("at") + i, F.col("last")))).alias(f"x{i}") for i in range(step)])


def line_signs(texts: DataFrame) -> DataFrame:
    """(h, size, s0, s1, ...): sizes and parity bitmaps of the shingle sets of lines (h, line)."""
    x = F.col("x")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    word = F.shiftright(x, 6).bitwiseAND(SIGNS - 1)
    own = [F.bit_xor(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{j}") for j in range(SIGNS)]
    rows = texts.select("h", F.explode(shingle_set(F.col("line"))).alias("x")).select("h", bit.alias("bit"), word.cast("int").alias("word"))
    return rows.groupBy("h").agg(F.count("*").alias("size"), *own)


def _partner(signs: DataFrame) -> DataFrame:
    """signs as the other side of a pair: b, m, t0, t1, ..."""
    return signs.withColumnsRenamed({"h": "b", "size": "m"} | {f"s{j}": f"t{j}" for j in range(SIGNS)})


def _may(threshold: float) -> Column:
    """Whether sizes and bitmaps of a row with signs and a partner's allow the threshold."""
    n, m = F.col("size"), F.col("m")
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"s{j}").bitwiseXOR(F.col(f"t{j}"))) for j in range(SIGNS)])
    return (m >= threshold * n) & (n >= threshold * m) & (apart <= (1 - threshold) / (1 + threshold) * (n + m) + 1e-6)


def line_bands(lines: DataFrame) -> DataFrame:
    """(h, band): the bands of distinct lines, six each."""
    rows = shingle_rows(lines, STEP, "h")
    mixed = [F.least(*[F.shiftright(F.col(f"x{i}").bitwiseXOR(F.lit(m)), 32).cast("int") for i in range(STEP)]) for m in MASKS]
    least = rows.groupBy("h").agg(*[F.min(x).alias(f"m{i}") for i, x in enumerate(mixed)])
    return least.select("h", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col(f"m{2 * i}"), F.col(f"m{2 * i + 1}")) for i in range(BANDS)])).alias("band"))


def similar_lines(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, comp): components of distinct lines (by hash) under verified similarity."""
    rows = line_bands(lines)
    rows = stash(_beside(rows.withColumn("k", F.count("*").over(Window.partitionBy("band"))), "band").where("k > 1"), "line-bands")
    pairs = stash(_offered(rows), "line-pairs")
    wanted = rows.select("h").distinct()
    texts = marked(lines.select("h", "line"), F.col("h"), bit_words(wanted, "h")).where("__hit").select("h", "line")
    texts = stash(texts.join(wanted, "h", "left_semi").dropDuplicates(["h"]), "line-texts")
    signs = stash(line_signs(texts), "line-signs")
    comps = components(_linked(_near(pairs, signs, threshold), texts, threshold))
    bands = stash(_mixed(rows.select("band", "h", "k"), comps, "band"), "mixed-bands")
    forget(rows)
    if bands.isEmpty():
        forget(pairs, texts, signs, bands)
        return comps
    short = bands.where(F.col("k") <= SHORT).select("band", "h", F.array().cast("array<bigint>").alias("before"))
    lists = stash(_head_lists(bands.where(F.col("k") > SHORT).select("h").distinct(), texts, threshold), "line-lists")
    if not lists.isEmpty():
        fresh = stash(_apart(_offered(_beside(lists, "band")), comps).join(pairs, ["a", "b"], "left_anti"), "line-pairs")
        known = marked(signs, F.col("h"), _end_words(fresh)).where("__hit").drop("__hit")
        comps = _joined(comps, _linked(_near(fresh, known, threshold), texts, threshold))
        pairs = pairs.unionByName(fresh)
    left = stash(_mixed(short.unionByName(lists), comps, "band").select("band", "h", "c", "before"), "mixed-lists")
    if left.isEmpty():
        return comps
    near = stash(_met(left.join(signs, "h"), threshold).distinct().join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    return _joined(comps, _linked(near, texts, threshold))


def _met(left: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): the pairs of lists (band, h, c, before, and signs) across components that sizes and bitmaps allow. Lines that share several
    inverted lists meet in the first of them, at least: in a later one the shingles before it show that they have met."""
    other = _partner(left).withColumnsRenamed({"band": "other", "c": "cb", "before": "past"})
    new = ~F.arrays_overlap("before", "past")
    # all in the join's condition, so that no other pair ever is a row
    both = left.join(other, (F.col("band") == F.col("other")) & (F.col("h") < F.col("b")) & (F.col("c") != F.col("cb")) & _may(threshold) & new)
    return both.select(F.col("h").alias("a"), "b", (F.col("size") + F.col("m")).alias("n"))


def _beside(lists: DataFrame, key: str) -> DataFrame:
    """lists (key, h) with the list's first line and the line before, by hash."""
    order = Window.partitionBy(key).orderBy("h")
    return lists.withColumns({"first": F.first("h").over(order.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag("h").over(order)})


def _offered(lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of each line with its list's first and with the one before."""
    pairs = lists.where("before is not null").select("h", F.explode(F.array_distinct(F.array("first", "before"))).alias("o"))
    return pairs.select(F.col("o").alias("a"), F.col("h").alias("b")).distinct()


def _end_words(pairs: DataFrame) -> DataFrame:
    """``bit_words`` of the lines in pairs."""
    return bit_words(pairs.select(F.explode(F.array("a", "b")).alias("h")), "h")


def _near(pairs: DataFrame, signs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): the pairs that sizes and bitmaps allow, with the sum of sizes."""
    near = pairs.join(signs.withColumnRenamed("h", "a"), "a").join(_partner(signs), "b").where(_may(threshold))
    return stash(near.select("a", "b", (F.col("size") + F.col("m")).alias("n")), "near-pairs")


def _linked(near: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, n) whose sets reach the threshold; only texts of such pairs are shuffled."""
    tasks = parts_for(near.count(), MET, most=100_000)
    texts = marked(texts, F.col("h"), _end_words(near)).where("__hit")
    own = texts.select(F.col("h").alias("a"), F.col("line").alias("x")).repartition(tasks, "a")
    both = near.repartition(tasks, "b").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b").join(own, "a")
    shared = F.size(F.array_intersect(shingles(F.col("x")), shingles(F.col("y"))))  # distinct ones; their number is computed once
    reach = F.exists(F.array(shared), lambda k: k >= threshold * (F.col("n") - k))
    return both.where(reach).select("a", "b")


def _in(rows: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the component of a node; a node without links is its own."""
    return rows.join(comps.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _mixed(lists: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """The lists whose lines differ in component, which is c."""
    rows = _in(lists.drop("c"), comps, "h", "c")
    return rows.join(rows.groupBy(key).agg((F.min("c") < F.max("c")).alias("mixed")).where("mixed").select(key), key, "left_semi")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs across components."""
    return _in(_in(pairs, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b")


def _head_lists(hashes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(band, h, before): inverted lists of the lines of long bands, by shingle. Rare shingles come first; a line misses at most n - ceil(threshold n) of
    a similar line's shingles, so both have one of their first n - ceil(threshold n) + 1 in common, and no similar pair is lost. before: the last
    of the line's own shingles in that order that have a list and stand before this one, BEFORE at most."""
    rows = texts.join(hashes, "h", "left_semi").select("h", F.explode(shingle_set(F.col("line"))).alias("x"))
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("x")))
    heads = rows.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("s"))
    n = F.size("s")
    heads = heads.select("h", F.filter(F.slice("s", F.lit(1), n - F.ceil(threshold * n).cast("int") + 1), lambda x: x["df"] > 1)["x"].alias("s"))
    heads = heads.select("h", "s", F.posexplode("s").alias("i", "band"))
    return heads.select("band", "h", F.slice("s", F.greatest(F.lit(1), F.col("i") - BEFORE + 1), F.least(F.col("i"), F.lit(BEFORE))).alias("before"))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after further links; union-find runs over the components that these name only."""
    links = stash(_in(_in(links, comps, "a", "ca"), comps, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
    more = components(links)
    new = more.join(comps, "node", "left_anti")
    to = more.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = comps.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stash(old.unionByName(new), "comps")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(d, tie, gone): numbers of the lines that each document loses; documents that lose none are absent."""
    lines = line_rows(docs, doc_id, text)
    comps = similar_lines(lines, threshold)
    place = F.struct("d", "tie", "i")
    own = lines.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    own = own.join(comps.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or comp is not null")
    own = stash(own.select("h", "first", F.coalesce("comp", "h").alias("c")), "line-kinds")
    first = own.groupBy("c").agg(F.min("first").alias("first"))
    known = own.select("h", "c").join(first, "c").select("h", "first")
    rows = marked(lines.select("d", "tie", "i", "h"), F.col("h"), bit_words(own, "h")).where("__hit")
    gone = rows.join(known, "h").where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("d", "tie").agg(F.array_sort(F.collect_set("i")).alias("gone"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the removed lines cut out of text (and n_chars, if there is one, brought up to date)."""
    gone = stash(removed_lines(docs.select("doc_id", "text"), threshold=threshold), "gone")
    hit, key, lost = free(docs, "__hit"), free(docs, "__key"), free(docs, "__gone")
    rows = docs.withColumn(key, F.xxhash64("text"))
    rows = marked(rows, F.xxhash64(F.col("doc_id"), F.col(key)), bit_words(gone.select(F.xxhash64(F.col("d"), F.col("tie")).alias("k")), "k"), hit)
    left = rows.where(F.col(hit))
    of = gone.select(F.struct(F.col("d").alias("d"), F.col("tie").alias("tie")).alias(lost + "of"), F.col("gone").alias(lost))
    cut = left.join(of, left["doc_id"].eqNullSafe(of[lost + "of"]["d"]) & (left[key] == of[lost + "of"]["tie"]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    cut = cut.withColumn("text", F.when(F.col(lost).isNotNull(), kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(lost).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return cut.select(names).unionByName(rows.where(~F.col(hit)).select(names))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = removed_lines(docs).withColumnRenamed("tie", "gone_tie")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n"))
    both = sizes.join(gone, sizes["doc_id"].eqNullSafe(gone["d"]) & (sizes["tie"] == gone["gone_tie"]), "left")
    lost = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    n = F.greatest(F.col("n"), F.lit(0)).cast("long")
    return both.select("doc_id", n.alias("n_lines"), lost.alias("n_removed"), (n - lost).alias("n_kept"), F.concat_ws(",", F.col("gone").cast("array<string>")).alias("removed"))
