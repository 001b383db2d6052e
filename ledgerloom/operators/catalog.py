"""Catalogue of objects, blobs and paths: which row wins, what is live, and how it is looked up.

Winners are taken with ``max``/``min`` over structs, so rows of one key are combined before the shuffle and a hot key is no hot task.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

LIVE, DELETED = 1, 3


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the largest by ``order``, ties by the other columns; nulls are smallest."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("w")).select(*keys, "w.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, ties by the other columns."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("w")).select(*keys, "w.*")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """``table`` with the rows of ``batch`` put in: a key that both have takes the batch's row, its last by ``arrival`` (a column of the batch alone) if it has several."""
    last = last_wins(batch, keys, [arrival]).select(*table.columns)
    return table.join(last.select(*keys), keys, "left_anti").select(*table.columns).unionByName(last)


def insert_or_ignore(table: DataFrame, batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """``table`` with those rows of ``batch`` whose key it doesn't have; of several with one key the first by ``arrival``, a column of the batch alone."""
    return table.unionByName(first_wins(batch, keys, [arrival]).join(table.select(*keys).distinct(), keys, "left_anti").select(*table.columns))


def apply_log(deltas: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries of deltas that the ledger doesn't hold yet; a delta in the ledger is skipped as a whole."""
    return deltas.join(ledger.select("writer_id", "sequence").distinct(), ["writer_id", "sequence"], "left_anti")


def _is_live(state: str = "state") -> Column:
    return F.coalesce(F.col(state), F.lit(LIVE)) != DELETED


def index_winners(locations: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each object's location: highest generation, then writer, sequence and arrival, among blobs that aren't deleted.

    superseded: the winner over all rows stands in a deleted blob. An object with deleted blobs alone keeps null columns (unresolved).
    A blob without a state is live.
    """
    rank = F.struct("generation", "writer_id", "sequence", "arrival", "blob_id", "physical_offset", "stored_length")
    # Only deleted blobs matter, so these alone are joined; the winners are then one shuffle of partial maxima.
    deleted = blobs.where(F.col("state") == DELETED).select("blob_id", F.lit(False).alias("alive"))
    rows = locations.join(deleted, "blob_id", "left").withColumn("live", F.col("alive").isNull())
    best = rows.groupBy("object_id").agg(F.max(F.when(F.col("live"), rank)).alias("w"), F.max_by("live", rank).alias("ok"))
    return best.select("object_id", "w.blob_id", "w.generation", "w.writer_id", "w.sequence", "w.physical_offset", "w.stored_length", (~F.col("ok")).alias("superseded"))


def footer_winners(locations: DataFrame) -> DataFrame:
    """Each object's first place in blob order: the rule of readers that see footers and no index."""
    return first_wins(locations.select("object_id", "blob_id", "physical_offset", "stored_length"), ["object_id"], ["blob_id", "physical_offset"])


def live_locations(locations: DataFrame, blobs: DataFrame) -> DataFrame:
    """Locations whose blob isn't known to be deleted; a blob without a row is live."""
    return locations.join(blobs.where(F.col("state") == DELETED).select("blob_id"), "blob_id", "left_anti")


def merged_checkpoints(checkpoints: DataFrame, deltas: DataFrame) -> DataFrame:
    """Checkpoint entries and the deltas above each writer's watermark (its largest checkpointed sequence), in any arrival order."""
    marks = checkpoints.groupBy("writer_id").agg(F.max("sequence").alias("watermark"))
    late = deltas.join(marks, "writer_id", "left").where("watermark IS NULL OR sequence > watermark").drop("watermark")
    return checkpoints.unionByName(late)


def sequence_gaps(seen: DataFrame, watermarks: DataFrame, accounted: DataFrame | None = None, ages: DataFrame | None = None, patience: int = 3, run: int = 1 << 16) -> DataFrame:
    """Runs of sequence numbers between a writer's watermark and its highest delta that nothing accounts for: writer_id, low, high, verdict.

    seen: the deltas; accounted: other numbers that are explained (checkpoint counters, voids), which fill gaps but don't raise the highest.
    ages: writer_id and age in generations since the writer was last heard; a gap is ``damage`` from ``patience`` on, else ``unresolved``
    (age 0 where unknown). Numbers are put in order within runs of ``run`` of them, and runs by what they begin and end with, so one
    writer's numbers are many tasks, and a wide gap costs one row.
    """
    numbers = seen.select("writer_id", "sequence")
    known = numbers if accounted is None else numbers.unionByName(accounted.select("writer_id", "sequence"))
    above = known.distinct().join(watermarks, "writer_id", "left").where("watermark IS NULL OR sequence > watermark").withColumn("run", F.floor(F.col("sequence") / run))
    ends = above.groupBy("writer_id", "run").agg(F.max("sequence").alias("last"))
    ends = ends.withColumn("carry", F.lag("last").over(Window.partitionBy("writer_id").orderBy("run"))).drop("last")
    before = F.lag("sequence").over(Window.partitionBy("writer_id", "run").orderBy("sequence"))
    gaps = above.withColumn("near", before).join(ends, ["writer_id", "run"]).withColumn("before", F.coalesce("near", "carry", "watermark", F.lit(0))).where("sequence > before + 1")
    highest = numbers.groupBy("writer_id").agg(F.max("sequence").alias("highest"))
    gaps = gaps.join(highest, "writer_id").where("before < highest").select("writer_id", (F.col("before") + 1).alias("low"), (F.col("sequence") - 1).alias("high"))
    gaps = gaps if ages is None else gaps.join(ages.select("writer_id", "age"), "writer_id", "left")
    age = F.lit(0) if ages is None else F.coalesce("age", F.lit(0))
    return gaps.select("writer_id", "low", "high", F.when(age >= patience, "damage").otherwise("unresolved").alias("verdict"))


def blob_states(known: DataFrame, inventory: DataFrame, complete: bool) -> DataFrame:
    """blob_id and state 3 of blobs that a complete inventory doesn't list; an incomplete one proves nothing, so all stay live."""
    if not complete:
        return known.select("blob_id").where(F.lit(False)).withColumn("state", F.lit(DELETED))
    return known.select("blob_id").distinct().join(inventory.select("blob_id"), "blob_id", "left_anti").withColumn("state", F.lit(DELETED))


def shard(object_hex: Column) -> Column:
    """The first 16 bits of an id given in hex."""
    return F.conv(F.substring(object_hex, 1, 4), 16, 10).cast("long")


def packed_profile(compression: Column, encryption: Column) -> Column:
    return F.shiftleft(compression.cast("long"), 16).bitwiseOR(encryption.cast("long"))


def unpacked_profile(packed: Column) -> tuple[Column, Column]:
    """(compression, encryption) of a packed profile."""
    return F.shiftrightunsigned(packed, 16), packed.bitwiseAND(F.lit(0xFFFF))


def shard_digests(files: DataFrame, n_hex: int = 2) -> DataFrame:
    """shard, n_entries and digest: SHA-256 over the ids of a shard in byte order, one a line.

    Ids are first combined within sub-shards of four more bits, so that one shard's ids are digested in sixteen tasks.
    """
    ids = files.select("content_id").distinct()
    sub = ids.groupBy(F.substring("content_id", 1, n_hex + 1).alias("sub")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("content_id")), "\n"), 256).alias("d"))
    return sub.groupBy(F.substring("sub", 1, n_hex).alias("shard")).agg(F.sum("n").alias("n_entries"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


# Lookups


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    """Texts in normal form C. Most are plain ASCII, which a batch tells at once."""
    if pa.compute.all(pa.compute.string_is_ascii(text)).as_py() is not False:
        return text
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def casefold(path: Column) -> Column:
    """Composed (NFC), then in small letters."""
    return F.lower(_composed(path))


def lookup_paths(tree: DataFrame, asked: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Each asked path with its entry's columns (null if there is none). Ignoring case, an exact match comes first, then path order."""
    if not ignore_case:
        return asked.join(tree.withColumnRenamed("path", "asked"), "asked", "left")
    hits = asked.withColumn("fold", casefold(F.col("asked"))).join(tree.withColumn("fold", casefold(F.col("path"))), "fold", "left").drop("fold")
    best = F.min(F.struct((F.col("path") != F.col("asked")).alias("differs"), *tree.columns)).alias("w")
    return hits.groupBy("asked").agg(best).select("asked", *[f"w.{c}" for c in tree.columns])


def lookup_identity(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """(device, inode) to the first entry in path order; null identities match nothing."""
    return asked.join(first_wins(tree.where("device IS NOT NULL AND inode IS NOT NULL"), ["device", "inode"], ["path"]), ["device", "inode"])


def list_directory(tree: DataFrame, versions: DataFrame, parent: str) -> DataFrame:
    """Entries of a directory in path order, with their versions where known."""
    return tree.where(F.col("parent") == parent).join(versions, "file_id", "left").orderBy("path")


def lookup_content(objects: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked content_id with the first object (by id) that holds it; null if none does."""
    return asked.select("content_id").distinct().join(first_wins(objects.where("content_id IS NOT NULL"), ["content_id"], ["object_id"]), "content_id", "left")


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def case_collisions(tree: DataFrame) -> DataFrame:
    """Paths that are equal but for case, each with the number of its peers."""
    folded = tree.select("path", casefold(F.col("path")).alias("fold"))
    groups = folded.groupBy("fold").agg(F.count("*").alias("n")).where("n > 1")
    return folded.join(groups, "fold").select("path", "fold", (F.col("n") - 1).alias("peers"))


def candidates_with_proof(objects: DataFrame, verified: DataFrame) -> DataFrame:
    """Objects with a flag that tells whether they were verified."""
    return objects.join(verified.select("object_id").distinct().withColumn("verified", F.lit(True)), "object_id", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def unique_sources(rows: DataFrame) -> DataFrame:
    """source_key and object of keys seen with one object only; keys seen with two are ambiguous and left out for good."""
    return rows.groupBy("source_key").agg(F.min("object").alias("object"), F.max("object").alias("most")).where("object = most").drop("most")


def as_of(facts: DataFrame, bounds: DataFrame) -> DataFrame:
    """For each bound (key, at), the latest fact of its key with captured_ms <= at; ties to the larger id.

    Facts and bounds are put in one order per key and time slice; what earlier slices end with is carried over, so that a hot key's rows
    are spread over its slices.
    """
    slice_ms = 1000 * 86400 * 30
    fact = F.struct(F.col("captured_ms"), F.col("snapshot_id"))
    both = facts.select("key", F.col("captured_ms").alias("t"), fact.alias("fact"), F.lit(None).cast("long").alias("bound_id")).unionByName(
        bounds.select("key", F.col("at").alias("t"), F.lit(None).cast("struct<captured_ms:bigint,snapshot_id:bigint>").alias("fact"), "bound_id")
    )
    both = both.withColumn("slice", F.floor(F.col("t") / slice_ms))
    carried = both.groupBy("key", "slice").agg(F.max("fact").alias("last"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("key", "slice", F.max("last").over(before).alias("carry"))
    inside = Window.partitionBy("key", "slice").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("near", F.max("fact").over(inside)).where("bound_id IS NOT NULL").join(carried, ["key", "slice"], "left")
    best = F.coalesce("near", "carry")
    return found.select("bound_id", "key", F.col("t").alias("at"), best["snapshot_id"].alias("snapshot_id"), best["captured_ms"].alias("captured_ms"))
