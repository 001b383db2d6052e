"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import Scratch

BLANKS = b" \t\n\x0b\x0c\r"
MIN_POINTS = 20
MIN_DOCS = 3


def line_key(line: bytes, min_points: int) -> bytes | None:
    """128-bit hash of the stripped, lower-cased (A-Z) line; None if it has fewer code points than ``min_points``."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_points or len(key.decode("utf-8", "replace")) < min_points:
        return None
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """A growing set of line keys, held as sorted runs in levels.

    ``add`` takes a batch (key, doc_id), anti-joins it with the runs so far, and writes one more sorted run: keys that are new with
    their holder, known keys with their further number of documents. ``fanout`` runs of a level are merged into one of the next,
    so that a key is rewritten a logarithmic number of times, and the merged ones are dropped.
    """

    def __init__(self, scratch: Scratch, fanout: int = 2) -> None:
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame | None:
        """key, n_docs, holder over all runs; the holder is the largest doc_id of those that brought the key in."""
        return self._merge(self.runs()) if self.levels else None

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def _sorted_run(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.write(df.repartitionByRange("key").sortWithinPartitions("key"), name)

    def clear(self) -> None:
        self.scratch.drop(*self.runs())
        self.levels = []

    def add(self, batch: DataFrame) -> None:
        own = batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        known = self.merged()
        if known is not None:
            fresh = own.join(known, "key", "left_anti")
            again = own.join(known.select("key"), "key", "left_semi").withColumn("holder", F.lit(None).cast("long"))
            own = fresh.unionByName(again)
        level, run = 0, self._sorted_run(own, "line-run")
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._sorted_run(self._merge(self.levels[level]), f"line-run-level{level + 1}")
            self.scratch.drop(*self.levels[level])
            self.levels[level] = []
            level += 1


def _keys(min_points: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {k for line in (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n") if (k := line_key(line, min_points))}
                ids += [doc] * len(own)
                keys += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], schema=schema)

    return run


def _without(min_points: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, before, gone = [], [], []
            for text, drop in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
                kept = lines
                if drop:
                    drop = set(drop)
                    kept = [x for x in lines if line_key(x, min_points) not in drop]
                texts.append(b"\n".join(kept))
                before.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], schema, strict=True)], schema=schema)

    return run


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and n_lines (before) and n_dropped.

    A line's key (stripped of blanks, A-Z lower-cased) of at least ``min_points`` code points that stands in at least ``min_docs``
    documents stays only in the largest doc_id. Batches arrive by descending doc_id, so a key's holder is in the first batch that has it.
    Null or empty text is one empty line (text becomes empty). Rows with a null doc_id count for nothing and stay whole; rows that
    repeat a doc_id are one document, each treated alike. Own columns n_lines and n_dropped replace input columns of these names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    docs = docs.drop("n_lines", "n_dropped")
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.02)
    where = sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_keys(min_points), "doc_id long, key binary")
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.write(lines.withColumn("batch", where), "line-keys")
    store = LineRuns(scratch, fanout)
    for b in range(len(set(cuts)) + 1):
        store.add(lines.where(F.col("batch") == b).select("key", "doc_id").distinct())
    # Both sides of the join are tables as written, so that the rows of a very common line can be split over tasks.
    repeated = scratch.write(store.merged().where(F.col("n_docs") >= min_docs).select("key", "holder"), "repeated")
    store.clear()
    drop = "drop"
    while drop in docs.columns:
        drop += "_"
    drops = lines.select("doc_id", "key").join(repeated, "key").where("doc_id <> holder").groupBy("doc_id").agg(F.collect_set("key").alias(drop))
    drops = scratch.write(drops, "drops")
    scratch.drop(lines, repeated)
    schema = StructType([*docs.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType())
    # One document's keys are bounded by its text, so the small side can be hashed and the long texts need no sort.
    return docs.join(drops.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, drop).mapInArrow(_without(min_points, to_arrow_schema(schema)), schema)
