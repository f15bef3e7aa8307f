"""Shared pieces: shared-folder tables, word rules, bounded id bitmaps, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a maximal run of anything but the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of texts that stand in a worker as a frame at once.
FRAME = 512
#: Bytes of an Arrow batch, about, where the session has Spark's default of 64 MB: 10,000 texts in one would take twice their size outside the heap as the batch grows.
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"

#: Temporary folders by application, for local sessions without a shared folder; the setting itself is fixed once a session runs.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without it gets a temporary one; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, True)
        _LOCAL[app] = "file://" + folder
    return _LOCAL[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``stash`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_stashed", None):
            jvm = df.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(n: int, per: int, least: int = 1, most: int = 1 << 20) -> int:
    return int(max(least, min(most, -(-n // per))))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroups batches that are sorted by key, so that no key is cut between two frames."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        if rest and k[0] == rest[0][key].iat[0] == k[-1]:
            rest.append(pdf)
            continue
        cut = int(np.searchsorted(k == k[-1], True)) if k[0] != k[-1] else 0
        if cut or rest:
            head = rest + ([pdf.iloc[:cut]] if cut else [])
            if cut or rest[0][key].iat[0] != k[0]:
                yield pd.concat(head, ignore_index=True)
                rest = []
        rest.append(pdf.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def small_frames(batches: Iterator[pa.RecordBatch], rows: int = FRAME) -> Iterator[pd.DataFrame]:
    """The batches as frames of so many rows at most, made one at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pandas(integer_object_nulls=True)


def map_texts(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = FRAME) -> DataFrame:
    """mapInPandas for rows with whole texts: Spark's batches, of 10,000 rows each, never stand in a worker as Python strings at once."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == BATCH_DEFAULT:  # a session's own value stays
        conf.set(BATCH_KEY, BATCH)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in work(small_frames(batches, rows)):
            yield from pa.Table.from_pandas(pdf, schema=kind, preserve_index=False).combine_chunks().to_batches()

    return df.mapInArrow(mapped, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, comp) with comp the smallest reachable node, for every node of an edge.

    Alternates large-star and small-star steps: every node hooks its neighbours to the smallest one it knows. DataFrame
    operations only; each round is a table in the shared folder and replaces the one before. A hub's neighbours are never
    gathered: the minimum comes from a partial aggregate and is joined back, so that Spark can split a hub's rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = stash(now, "edges")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stash(now, "edges")
        forget(last)
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count():
            break  # every node hangs on one root: nothing but stars is left
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def bit_words(ids: DataFrame, name: str) -> DataFrame:
    """(__w, __bits): a bitmap of 2**22 bits over hashed ids as at most 65,536 rows, built with column functions; that bound is why it may be broadcast.

    It only saves shuffling: where it holds so many ids that most rows hit, the join behind it does the work.
    """
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(name), 42).bitwiseAND(63).cast("int"))
    return ids.select(F.shiftrightunsigned(F.xxhash64(name), 48).alias("__w"), one.alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__bits"))


def marked(df: DataFrame, key: Column, words: DataFrame, hit: str = "__hit") -> DataFrame:
    """df with the column hit: false only where key is surely not among the ids of words."""
    w, own, bits = free(df, "__w"), free(df, "__bit"), free(df, "__bits")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key), 42).bitwiseAND(63).cast("int"))
    rows = df.withColumns({w: F.shiftrightunsigned(F.xxhash64(key), 48), own: bit}).join(F.broadcast(words.withColumnsRenamed({"__w": w, "__bits": bits})), w, "left")
    return rows.withColumn(hit, F.coalesce(F.col(bits).bitwiseAND(F.col(own)) != 0, F.lit(False))).drop(w, own, bits)
