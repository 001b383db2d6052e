"""Change detection, segmentation and deduplication of byte streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ledgerloom.sources.shared import Scratch

KIB = 1024
WINDOW = 64
PIECES = 64
DEFAULT_THRESHOLD = 50


def changes(current: DataFrame, prior: DataFrame) -> DataFrame:
    """path, prior_path, matched_by, content, metadata of each scanned file against the prior snapshot.

    A file's prior version is the one of its path, else that of its identity (device, inode; the first path), else the one at the path that
    current's column ``hint`` names, if there is such a column. Content counts as unchanged if time, length and identity are equal and none
    is null; metadata only if there is a prior version of equal digest (access times aren't part of it; nulls are values of their own).
    """
    hinted = "hint" in current.columns
    current = current if hinted else current.withColumn("hint", F.lit(None).cast("string"))
    p = prior.select(*[F.col(c).alias(f"p_{c}") for c in ("path", "device", "inode", "length", "modified", "mode", "content_id")])
    by_path = current.join(p, current["path"] == p["p_path"], "left")
    found, missing = by_path.where("p_path IS NOT NULL"), by_path.where("p_path IS NULL").select(*current.columns)
    best = p.where("p_device IS NOT NULL AND p_inode IS NOT NULL").groupBy("p_device", "p_inode").agg(F.min(F.struct("p_path", "p_length", "p_modified", "p_mode", "p_content_id")).alias("w"))
    best = best.select("p_device", "p_inode", "w.*")
    moved = missing.join(best, (F.col("device") == F.col("p_device")) & (F.col("inode") == F.col("p_inode")), "left")
    rows = found.withColumn("matched_by", F.lit("path")).unionByName(moved.where("p_path IS NOT NULL").withColumn("matched_by", F.lit("identity")))
    lost = moved.where("p_path IS NULL").select(*current.columns)
    if hinted:
        lost = lost.join(p, F.col("hint") == F.col("p_path"), "left").withColumn("matched_by", F.when(F.col("p_path").isNotNull(), "hint").otherwise("none"))
    else:
        lost = lost.select("*", *[F.lit(None).cast(p.schema[c].dataType).alias(c) for c in p.columns], F.lit("none").alias("matched_by"))
    rows = rows.unionByName(lost)
    same = (F.col("modified") == F.col("p_modified")) & (F.col("length") == F.col("p_length")) & (F.col("device") == F.col("p_device")) & (F.col("inode") == F.col("p_inode"))
    unchanged = F.col("p_path").isNotNull() & (metadata_digest("mode", "modified") == metadata_digest("p_mode", "p_modified"))
    return rows.select("path", F.col("p_path").alias("prior_path"), "matched_by", F.coalesce(same, F.lit(False)).alias("content_unchanged"), unchanged.alias("metadata_unchanged"))


def metadata_digest(*columns: str) -> Column:
    """First 16 bytes, in hex, of SHA-256 over the named values, a line each: ``-`` for null, else ``=`` and the value."""
    values = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("\n", *values), 256), 1, 32)


def stores_compressed(compressed: Column, logical: Column, threshold: int = DEFAULT_THRESHOLD) -> Column:
    """Whether compression saves enough, in thousandths; whole numbers alone."""
    return compressed * 1000 <= logical * (1000 - threshold)


def fixed_segments(files: DataFrame, segment_size: int, strict: bool = True) -> DataFrame:
    """file_id, index, offset, length, content_id of each whole segment and the rest; an empty file has none. Sizes are powers of two from 64 KiB to 64 MiB."""
    if strict and (segment_size & (segment_size - 1) or not 64 * KIB <= segment_size <= 64 * KIB * KIB):
        raise ValueError(f"illegal segment size {segment_size}")
    at = F.when(F.octet_length("data") > 0, F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / segment_size).cast("int")))
    # Digests are made before rows are, so that no segment's row carries its whole file.
    piece = lambda i: F.substring(F.col("data"), i * segment_size + 1, F.lit(segment_size))
    parts = F.transform(at, lambda i: F.struct(i.alias("index"), (i.cast("long") * segment_size).alias("offset"), F.octet_length(piece(i)).cast("long").alias("length"), F.sha2(piece(i), 256).alias("content_id")))
    return files.select("file_id", parts.alias("parts")).select("file_id", F.explode("parts").alias("p")).select("file_id", "p.*")


def reused_by_position(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Fixed segments with reused: the prior file has the same content and length at the same index."""
    p = prior.select("file_id", "index", "length", "content_id", F.lit(True).alias("reused"))
    return current.join(p, ["file_id", "index", "length", "content_id"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def reused_by_content(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Segments with the prior place of their content (its first occurrence), if the length is the same."""
    p = prior.groupBy("content_id").agg(F.min(F.struct("file_id", "offset", "length")).alias("p"))
    p = p.select("content_id", F.col("p.file_id").alias("prior_file"), F.col("p.offset").alias("prior_offset"), F.col("p.length").alias("length"))
    return current.join(p, ["content_id", "length"], "left")


def first_occurrences(segments: DataFrame, order: list[str]) -> DataFrame:
    """``segments`` with stored: whether the row is the first of its content in capture order."""
    first = segments.groupBy("content_id").agg(F.min(F.struct(*order)).alias("first"))
    return segments.join(first, "content_id").withColumn("stored", F.struct(*order) == F.col("first")).drop("first")


def dedup_ratio(segments: DataFrame, by: str, order: list[str], version: str | None = None) -> DataFrame:
    """Bytes seen and stored per ``by``: a content is stored where it first occurs over all, in ``order``.

    With a ``version`` column, which must lead the order, later_logical and later_kept leave out each ``by``'s first version.
    """
    rows = first_occurrences(segments, order)
    stored = F.when(F.col("stored"), F.col("length")).otherwise(0)
    sums = [F.sum("length").alias("logical"), F.sum(stored).alias("kept")]
    if version is not None:
        rows = rows.join(segments.groupBy(by).agg(F.min(version).alias("_first")), by)
        later = F.col(version) > F.col("_first")
        sums += [F.coalesce(F.sum(F.when(later, F.col("length"))), F.lit(0)).alias("later_logical"), F.coalesce(F.sum(F.when(later, stored)), F.lit(0)).alias("later_kept")]
    return rows.groupBy(by).agg(*sums)


def file_digests(parts: DataFrame) -> DataFrame:
    """file_id, length, content_id of files given as segments (offset, length, data) and holes (data null, read as zeros), in any order.

    Rows of a file are put in order and stream through the digest, so a file of any size takes no more room than one segment; the digest
    itself is sequential. Parts must tile the file (see ``tiling_defects``).
    """
    kind = parts.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, size, first = None, hashlib.sha256(), 0, True
        done: list[tuple] = []
        for batch in batches:
            for file, length, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if first or file != at:
                    if not first:
                        done.append((at, size, digest.hexdigest()))
                    at, digest, size, first = file, hashlib.sha256(), 0, False
                if data is not None:
                    digest.update(data)
                else:
                    for low in range(0, length, 1 << 20):
                        digest.update(bytes(min(1 << 20, length - low)))
                size += length
        if not first:
            done.append((at, size, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((id_type, pa.int64(), pa.string()))], ["file_id", "length", "content_id"])

    id_type = to_arrow_type(parts.schema["file_id"].dataType)
    rows = parts.select("file_id", F.col("offset").cast("long"), F.col("length").cast("long"), F.col("data").cast("binary")).where("length > 0")
    return rows.repartition("file_id").sortWithinPartitions("file_id", "offset").mapInArrow(run, f"file_id {kind}, length long, content_id string")


def tiling_defects(parts: DataFrame) -> DataFrame:
    """file_id, offset, want: where segments and holes in order of offset don't tile their file."""
    w = Window.partitionBy("file_id").orderBy("offset", "length")
    end = F.lag(F.col("offset") + F.col("length"), 1, 0).over(w)
    return parts.withColumn("want", end).where("offset <> want").select("file_id", "offset", "want")


def hard_links(files: DataFrame) -> DataFrame:
    """file_id and group_id (the smallest file of its identity) of files that share device and inode."""
    groups = files.where("device IS NOT NULL AND inode IS NOT NULL").groupBy("device", "inode").agg(F.count("*").alias("links"), F.min("file_id").alias("group_id")).where("links > 1")
    return files.join(groups, ["device", "inode"]).select("file_id", "group_id", "links")


def stream_pieces(docs: DataFrame, rows_per_piece: int = 64) -> DataFrame:
    """stream_id, seq, data: texts of a source in doc_id order, as pieces of a bounded number of documents."""
    rows = docs.where("text IS NOT NULL").select(F.coalesce("source", F.lit("none")).alias("stream_id"), F.floor(F.col("doc_id") / rows_per_piece).alias("seq"), "doc_id", "text")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    return rows.groupBy("stream_id", "seq").agg(F.array_join(texts, "").cast("binary").alias("data"))


# Content-defined segments: a cut stands where the Rabin fingerprint of the last 64 bytes has zeros in its low bits.


def _times(h: np.ndarray, squarings: int) -> np.ndarray:
    """Products with x^(64 * 2^squarings): x^64 is x^4 + x^3 + x + 1, and squaring doubles its exponents."""
    places = [np.uint64(e << squarings) for e in (1, 3, 4)]
    out, over = h ^ (h << places[0]), h >> (np.uint64(64) - places[0])
    for e in places[1:]:
        out ^= h << e
        over ^= h >> (np.uint64(64) - e)
    out ^= over
    for e in (1, 3, 4):
        out ^= over << np.uint64(e)
    return out


def rabin(data: np.ndarray, block: int = 8192) -> np.ndarray:
    """Fingerprints of the 64 bytes ending at each place, modulo x^64 + x^4 + x^3 + x + 1; bytes before the start count as zero.

    Eight bytes are a word as they stand; two neighbours of 8, 16 and 32 bytes make one of twice the length. Blocks stay in a core's cache.
    """
    n = len(data)
    padded, out = np.concatenate((np.zeros(WINDOW, np.uint8), data)), np.empty(n, np.uint64)
    for low in range(0, n, block):
        raw = padded[low + 1 : min(low + block, n) + WINDOW]
        f = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(">u8").ravel().astype(np.uint64)
        for k, length in enumerate((8, 16, 32)):
            f = _times(f[:-length], k) ^ f[length:]
        out[low : low + block] = f
    return out


def greedy_cuts(candidates: np.ndarray, length: int, least: int, most: int) -> list[int]:
    """Ends of segments: the first candidate at ``least`` bytes or more, or ``most`` bytes; the rest is the last segment."""
    out, start = [], 0
    while length - start > 0:
        i = int(np.searchsorted(candidates, start + least))
        end = min(start + most, int(candidates[i]) if i < len(candidates) else start + most)
        if end >= length:
            break
        out.append(end)
        start = end
    return [*out, length] if length else []


def check_cdc(target: int, least: int, most: int) -> None:
    if target & (target - 1) or target < 64 * KIB or not 0 < least <= target <= most:
        raise ValueError(f"illegal profile: target {target}, least {least}, most {most}")


def cdc_segments(pieces: DataFrame, target: int = 64 * KIB, least: int = 8 * KIB, most: int = 512 * KIB, strict: bool = True) -> DataFrame:
    """stream_id, index, offset, length of content-defined segments of streams given as pieces (stream_id, seq, data).

    Each piece is fingerprinted where it stands, and only its first and last 63 bytes go on, with the places that may be cuts, one in
    ``target`` bytes: windows that reach over pieces are fingerprinted from these. Offsets are added up by runs of pieces first. The
    choice among a stream's places is sequential. Python gets ``PIECES`` pieces at a time, however many a task has, and what it finds is
    written to the shared folder. Empty or null pieces add nothing; an empty stream has no segments.
    """
    if strict:
        check_cdc(target, least, most)
    mask = np.uint64(target - 1)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ends = [], []
            for data in batch.column(2):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                found = np.flatnonzero((rabin(raw) & mask) == 0) + 1
                places.append(found[found >= WINDOW])
                ends.append((raw[: WINDOW - 1].tobytes().hex(), raw[-(WINDOW - 1) :].tobytes().hex(), len(raw)))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32)
            flat = pa.array(np.concatenate(places) if places else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), flat), *(pa.array([e[i] for e in ends], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64())))], ["stream_id", "seq", "places", "head", "tail", "n"])

    found = pieces.where("octet_length(data) > 0").select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "data")
    rows = found.mapInArrow(inner, "stream_id string, seq long, places array<long>, head string, tail string, n long")
    rows = Scratch(pieces.sparkSession, "pieces").write(rows, "pieces", PIECES).withColumn("run", F.floor(F.col("seq") / 1024))
    last = lambda c: F.expr(f"substring({c}, greatest(1, length({c}) - 125), 126)")
    inside = Window.partitionBy("stream_id", "run").orderBy("seq")
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("before", F.array_join(F.collect_list("tail").over(inside.rowsBetween(-63, -1)), "")).withColumn("before", last("before"))
    ends = rows.groupBy("stream_id", "run").agg(F.sum("n").alias("n"), F.max_by(F.concat("before", "tail"), "seq").alias("tail"))
    order = Window.partitionBy("stream_id").orderBy("run")
    ends = ends.select("stream_id", "run", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.array_join(F.collect_list("tail").over(order.rowsBetween(-63, -1)), "").alias("head_tail"))
    rows = rows.join(ends, ["stream_id", "run"]).withColumn("context", last("concat(head_tail, before)"))
    rows = rows.select("stream_id", (F.col("first") + F.col("at")).alias("offset"), F.unhex("context").alias("context"), F.unhex("head").alias("head"), "places", "n")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, kinds = [], [], []
            for stream, offset, context, head, own, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                h = rabin(np.frombuffer(context + head, np.uint8))[len(context) :]
                places = [offset + k for k in (np.flatnonzero((h & mask) == 0) + 1).tolist() + own]
                ids += [stream] * (len(places) + 1)
                at += [*places, offset + n]
                kinds += [False] * len(places) + [True]  # the largest end is the stream's length
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int64()), pa.array(kinds)], ["stream_id", "place", "is_end"])

    def cut(key: tuple, t: pa.Table) -> pa.Table:
        place, is_end = t["place"].to_numpy(), t["is_end"].to_numpy(zero_copy_only=False)
        ends = greedy_cuts(np.sort(place[~is_end]), int(place.max()), least, most)
        starts = [0, *ends[:-1]]
        return pa.table({"stream_id": pa.array([key[0].as_py()] * len(ends), pa.string()), "index": pa.array(range(len(ends)), pa.int64()), "offset": pa.array(starts, pa.int64()), "length": pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64())})

    return rows.mapInArrow(marks, "stream_id string, place long, is_end boolean").groupBy("stream_id").applyInArrow(cut, "stream_id string, index long, offset long, length long")


def bin_packs(records: DataFrame, most: int, target: int, max_records: int, header: int = 64, footer: int = 96) -> DataFrame:
    """stream_id, seq, bin: records appended in order; a bin closes before it would pass ``most`` (footer room included), or once it reaches ``target`` or its record limit.

    A sequential fold: each stream is one writer's session, and its rows are numbers alone. A record too large for an empty bin has one of its own.
    """

    def fold(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        bins, number, used, n = [], 0, header, 0
        for size in t["size"].to_pylist():
            if n and used + size + footer * (n + 2) > most:
                number, used, n = number + 1, header, 0
            bins.append(number)
            used, n = used + size, n + 1
            if used >= target or n >= max_records:
                number, used, n = number + 1, header, 0
        return pa.table({"stream_id": t["stream_id"], "seq": t["seq"], "bin": pa.array(bins, pa.int64())})

    kind = records.schema["stream_id"].dataType.simpleString()
    return records.select("stream_id", F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size")).groupBy("stream_id").applyInArrow(fold, f"stream_id {kind}, seq long, bin long")


def tree_shards(entries: DataFrame, budget: int = 15 * KIB * KIB, overhead: int = 48) -> DataFrame:
    """directory, seq, bin: entries in order, a shard closing before its estimated size (name and ``overhead``) passes the budget."""
    rows = entries.select(F.col("directory").alias("stream_id"), "seq", (F.octet_length("name") + overhead).alias("size"))
    return bin_packs(rows, budget, 1 << 62, 1 << 62, header=0, footer=0).withColumnRenamed("stream_id", "directory")
