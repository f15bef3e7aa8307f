"""Operator 1: mixing sources to target weights by systematic sampling.

Targets come from water filling: weights share the whole size, a source stops at max_epochs times its own size and what it
cannot take is shared again by weight. Within a source every document then has the same expected number of copies, the rate
target / source size. Documents stand in order of size, the prefix sum of expected copies is position * rate, one offset per
source is added, and a document is emitted once for each integer that its step crosses. The order by size makes the words
taken differ from the target by less than the source's longest document.

Positions come from counts by (source, size), then by id bucket, then from a row number within a bucket, so no window holds a
source. Defined cases: null text or no word has size 0; null source is one source, last in order; repeated rows are rows of
their own; rows that share size and id stand in order of a hash of all their columns, so that reruns agree; ids may have any type, null ids stand
last; very long texts are counted whole; a source of size 0 has target 0 and emits nothing; an empty table gives an empty result; the columns of
``mix_documents`` keep their values, whatever their names (``mix_copies`` adds columns that start with two underscores).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, word_count

#: Documents for each id bucket of a (source, size) group, on average over all rows.
PER_BUCKET = 20_000


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(__source, source_size, target, __u): water filling in closed form over one row a source."""
    own = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    own = own.withColumn("__i", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__i") - 1) % len(weights) + 1).cast("int"))
    own = own.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("__t", F.sum("source_size").over(everything))
    level = (F.col("__t") - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__w").over(rest)
    own = own.withColumn("__level", level).withColumn("__full", F.col("__cap") / F.col("__w") <= F.col("__level"))
    # the first source that is not full sets the level; later ones would set lower ones
    own = own.withColumn("__top", F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything))
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__top"))
    offset = (F.col("__i") * 40503 + 12345) % 65536 / F.lit(65536.0)
    return own.select("__source", "source_size", target.alias("target"), offset.alias("__u"))


def mix_copies(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", size: Column | None = None, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, n_rows: int | None = None) -> DataFrame:
    """docs with __size, __source_size, __target and __copies, the number of times that the mix emits the row."""
    n_rows = docs.count() if n_rows is None else n_rows
    buckets = parts_for(n_rows, PER_BUCKET, 16)
    number = F.col(doc_id) if docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long") else F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id))
    rows = docs.withColumns({"__size": word_count(F.col(text)) if size is None else size, "__source": F.col(source), "__b": F.coalesce(F.pmod(number, F.lit(buckets)), F.lit(0)).cast("long")})
    counts = rows.groupBy("__source", "__size", "__b").agg(F.count("*").alias("__n"))
    by_size = counts.groupBy("__source", "__size").agg(F.sum("__n").alias("__n"))
    upto = Window.partitionBy("__source").orderBy("__size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("__source", "__size", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__p"))
    targets = source_targets(counts.select("__source", (F.col("__size") * F.col("__n")).alias("__size")), weights, max_epochs)
    within = Window.partitionBy("__source", "__size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__q", F.coalesce(F.sum("__n").over(within), F.lit(0)))

    def same(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
        right = right.withColumnsRenamed({n: n + "r" for n in names})
        on = [left[n].eqNullSafe(right[n + "r"]) for n in names]
        return left.join(right, on).drop(*[n + "r" for n in names])

    starts = same(same(counts, by_size, "__source", "__size"), targets, "__source")
    starts = starts.select("__source", "__size", "__b", (F.col("__p") + F.col("__q")).alias("__start"), "source_size", "target", "__u")
    starts = starts.withColumnsRenamed({"source_size": "__source_size", "target": "__target"})
    # rows of one id are told apart by all their columns, so that reruns agree
    place = Window.partitionBy("__source", "__size", "__b").orderBy(F.col(doc_id).asc_nulls_last(), F.xxhash64(*[f"`{c}`" for c in docs.columns]))
    rows = rows.withColumn("__k", F.row_number().over(place))
    rows = same(rows, starts, "__source", "__size", "__b")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    k = F.col("__start") + F.col("__k")
    copies = F.floor(F.col("__u") + k * rate) - F.floor(F.col("__u") + (k - 1) * rate)
    return rows.withColumn("__copies", F.when(F.col("__size") > 0, copies).otherwise(F.when(rate > 0, copies).otherwise(F.lit(0))).cast("long")).drop("__b", "__k", "__start", "__u", "__source")


def mix_documents(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"))
    mixed = mix_copies(packed, size=F.col("size"), **options).where("__copies > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_copies(sized, size=F.col("size"))
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
n AS (SELECT greatest(16, CAST(ceil(count(*) / 20000.0) AS BIGINT)) AS b FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, ((i - 1) % 3 + 1)::DOUBLE AS w, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS t FROM s),
l AS (SELECT *, (t - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
   / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, CASE WHEN cap / w <= level THEN cap::DOUBLE ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER () END AS target,
   ((i * 40503 + 12345) % 65536) / 65536.0::DOUBLE AS u FROM l),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id % b, doc_id) AS k FROM d, n),
r AS (SELECT k.*, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS r
   FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(floor(u + k * r) - floor(u + (k - 1) * r) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
