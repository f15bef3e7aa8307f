"""A corpus pipeline over documents: quality rules, line dedup, n-gram Jaccard join, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result as Parquet to the
shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, lines, mixing, pieces, quality
from tessera.llm.common import stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose content share is too small go."""
    return quality.keep_good(docs, quality.fit_line_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines all but the first are cut out of the texts."""
    return lines.dedup_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row: counts, digest of the ids and the round trip."""
    table = pieces.PieceTable()
    return pieces.encode_with(docs, table, pieces.digest(table), pieces.DIGEST)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("mixing sources", mix_sources), ("SentencePiece encoding", encode_pieces)]
#: Line dedup, the trained line field and the lattice have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
