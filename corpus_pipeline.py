"""From raw documents to packed training sequences, in five stages that each keep their predecessor's decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, mixing, ngram_join, packing, quality
from ledgerloom.llm.queries import table, tokenizer_path
from ledgerloom.llm.storage import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in one; documents left without any text go."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS)).where((F.col("n_dropped") == 0) | (F.length("text") > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.8 over five-word shingles connect."""
    return ngram_join.one_of_each(docs.select(COLUMNS), n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight, dealt to shards and shuffled there; a text taken several times is as many rows, one cut by a block's end a row more."""
    return mixing.mixed_texts(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Trees and byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again, and goes once the next one is written."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
