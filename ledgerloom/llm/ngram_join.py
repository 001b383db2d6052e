"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters; each pair is verified once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.components import components
from ledgerloom.llm.storage import Scratch
from ledgerloom.llm.textkit import Words, shingles, slices, text_bytes

#: Shingle frequencies are counted in so many buckets (of the hash's top bits); this bounds what goes to each task.
BUCKET_BITS = 18
#: Cells of the histogram that the suffix filter compares.
CELLS = 64
#: Prefix groups of up to so many texts meet all with all at once; larger ones by stars first, then in blocks.
SMALL_GROUP, BLOCK = 16, 1024
#: Neighbours in a large group are looked for in runs of about so many texts.
STAR_RUN = 4096


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(column)
    for low, high in slices(offsets):
        words = Words(data, offsets, low, high)
        yield from shingles(words.hashes(), words.first, n)


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _summaries(n: int):
    """Per text its set's size and digest; per task the frequency of each bucket of shingles."""
    names = ["doc_id", "h", "n_shingles", "cls", "bucket", "freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            size, digest = [], []
            for s in _sets(batch.column(2), n):
                total += np.bincount((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total)) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(total, (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
                size.append(len(s))
                digest.append(_digest(s))
            k = len(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names)
        full = np.flatnonzero(total)
        for part in np.array_split(full, max(1, len(full) // 16384)):
            k = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(part.astype(np.int32)), pa.array(total[part])], names)

    return run


def _prefixes(n: int, num: int, den: int, rarity: np.ndarray):
    """The rarest shingles of each text, as many as must hold one of any partner's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            tokens, digests, sizes, lengths = [], [], [], []
            for s in _sets(batch.column(0), n):
                if not len(s) or (digest := _digest(s)) in seen:  # copies have the same entries
                    continue
                if len(seen) < 200_000:
                    seen.add(digest)
                tokens.append(_rarest(s, num, den, rarity))
                digests.append(digest)
                sizes.append(len(s))
                lengths.append(len(tokens[-1]))
            if not tokens:
                continue
            of = np.repeat(np.arange(len(lengths)), lengths)
            position = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            for low in range(0, len(of), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)[part]), pa.array(digests, pa.binary()).take(pa.array(of[part])), pa.array(np.array(sizes, np.int32)[of[part]]), pa.array(position[part].astype(np.int32))],
                    ["token", "cls", "size", "pos"],
                )

    return run


def _rarest(s: np.ndarray, num: int, den: int, rarity: np.ndarray) -> np.ndarray:
    """The prefix of a set: its rarest shingles, ties by hash, as many as must hold one of any partner's."""
    return s[np.argsort(rarity[s >> np.uint64(64 - BUCKET_BITS)], kind="stable")[: len(s) - -(-num * len(s) // den) + 1]]


def _cells(n: int, num: int, den: int, rarity: np.ndarray):
    """Each set's histogram over ``CELLS`` cells, in bytes or, where one is too full, in 32-bit numbers; and the cells of its prefix in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, cells, prefix = [], [], []
            for s in _sets(batch.column(0), n):
                if not len(s) or (digest := _digest(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(digest)
                counts = np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                digests.append(digest)
                cells.append(counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes())
                prefix.append((_rarest(s, num, den, rarity) & np.uint64(CELLS - 1)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (digests, cells, prefix)], ["cls", "cells", "prefix"])

    return run


def _suffix_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each prefix entry, the histogram of its text's suffix: the shingles that come after the entry's in the order. Counts stop at 255, which only makes histograms more alike."""
    for batch in batches:
        whole = np.array([np.frombuffer(x, np.uint8 if len(x) == CELLS else "<u4") for x in batch["cells"].to_pylist()], np.int64).reshape(-1, CELLS)
        pos, prefix = batch["pos"].to_numpy(), batch["prefix"].to_pylist()
        row = np.repeat(np.arange(len(pos)), pos + 1)
        done = np.frombuffer(b"".join(x[: k + 1] for x, k in zip(prefix, pos.tolist(), strict=True)), np.uint8)
        left = whole - np.bincount(row * CELLS + done, minlength=whole.size).reshape(whole.shape) if len(pos) else whole
        cells = np.minimum(left, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("token", "cls", "size", "pos", "members", "node")), pa.array([c.tobytes() for c in cells], pa.binary())], ["token", "cls", "size", "pos", "members", "node", "cells"])


def _cell_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


class _Filters:
    """Length, positional and suffix filters for pairs of prefix entries."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def near(self, size_a, pos_a, size_b, pos_b) -> np.ndarray:
        size_a, size_b = size_a.astype(np.int64), size_b.astype(np.int64)
        need = -(-self.num * (size_a + size_b) // (self.num + self.den))
        fits = np.minimum(size_a, size_b) * self.den >= self.num * np.maximum(size_a, size_b)
        # At the first shingle that two texts share, nothing before it is shared.
        return fits & (np.minimum(size_a - pos_a, size_b - pos_b) >= need)

    def alike(self, cells_a: np.ndarray, a: np.ndarray, size_a, pos_a, cells_b: np.ndarray, b: np.ndarray, size_b, pos_b) -> np.ndarray:
        """Suffixes whose histograms differ by d differ in at least d shingles; what they can share, with the one before them, must be enough."""
        out = np.zeros(len(a), bool)
        size_a, size_b = size_a.astype(np.int64), size_b.astype(np.int64)
        need = -(-self.num * (size_a + size_b) // (self.num + self.den))
        rest = size_a - pos_a - 1 + size_b - pos_b - 1
        for low in range(0, len(a), 16384):
            part = slice(low, low + 16384)
            differ = np.abs(cells_a[a[part]].astype(np.int16) - cells_b[b[part]]).sum(1, dtype=np.int64)
            out[part] = 1 + (rest[part] - differ) // 2 >= need[part]
        return out


_PAIR = "a binary, b binary"


def _pairs(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    x, y = a.to_pylist(), b.to_pylist()
    pairs = sorted({(min(p), max(p)) for p in zip(x, y, strict=True) if p[0] != p[1]})
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def _small_groups(filters: _Filters):
    """All pairs within groups of at most ``SMALL_GROUP`` rows, which come sorted by token."""

    def found(t: pa.Table) -> pa.RecordBatch:
        token, size, pos = (t[c].to_numpy() for c in ("token", "size", "pos"))
        cells = _cell_matrix(t["cells"].combine_chunks()) if t.num_rows else np.empty((0, CELLS), np.uint8)
        left, right = [], []
        for d in range(1, min(SMALL_GROUP, t.num_rows)):
            at = np.flatnonzero(token[d:] == token[:-d])
            if not len(at):
                break
            at = at[filters.near(size[at], pos[at], size[at + d], pos[at + d])]
            at = at[filters.alike(cells, at, size[at], pos[at], cells, at + d, size[at + d], pos[at + d])]
            left.append(at)
            right.append(at + d)
        cls = t["cls"].combine_chunks()
        pick = lambda x: cls.take(pa.array(np.concatenate(x) if x else [], pa.int64()))
        return _pairs(pick(left), pick(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            token = t["token"].to_numpy()
            last = int(np.searchsorted(token, token[-1]))
            yield found(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield found(held)

    return run


def _star_pairs(filters: _Filters):
    """Each row with its group's centre and with its neighbour in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cell_matrix(batch["cells"]) if batch.num_rows else np.empty((0, CELLS), np.uint8)
            for other in ("centre", "neighbour"):
                s = batch[other]
                some = np.flatnonzero(s.is_valid().to_numpy(zero_copy_only=False))
                o = {k: s.take(pa.array(some)).field(k) for k in ("cls", "size", "pos", "cells")}
                size, pos = batch["size"].to_numpy()[some], batch["pos"].to_numpy()[some]
                their, at = o["size"].to_numpy(), o["pos"].to_numpy()
                ok = np.flatnonzero(filters.near(size, pos, their, at))
                if len(ok):
                    ok = ok[filters.alike(cells, some[ok], size[ok], pos[ok], _cell_matrix(o["cells"]), ok, their[ok], at[ok])]
                yield _pairs(batch["cls"].take(pa.array(some[ok])), o["cls"].take(pa.array(ok)))

    return run


def _block_pairs(filters: _Filters):
    """Pairs of different components within (token, block, block) groups, which come sorted and are bounded."""

    def found(t: pa.Table) -> pa.RecordBatch:
        size, pos, component, block = (t[c].to_numpy() for c in ("size", "pos", "component", "block"))
        cells, cls = _cell_matrix(t["cells"].combine_chunks()), t["cls"].combine_chunks()
        own, other = t["x"][0].as_py(), t["y"][0].as_py()
        rows, columns = np.flatnonzero(block == own), np.flatnonzero(block == other)
        left, right = [], []
        for i in rows.tolist():
            j = columns[(component[columns] != component[i]) & ((columns > i) if own == other else True)]
            j = j[filters.near(size[i : i + 1], pos[i : i + 1], size[j], pos[j])] if len(j) else j
            if len(j):
                j = j[filters.alike(cells, np.full(len(j), i), np.full(len(j), size[i]), pos[i], cells, j, size[j], pos[j])]
                left.append(np.full(len(j), i))
                right.append(j)
        pick = lambda x: cls.take(pa.array(np.concatenate(x) if x else [], pa.int64()))
        return _pairs(pick(left), pick(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            keys = [t[c].to_numpy() for c in ("token", "x", "y")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = np.concatenate(([0], new))
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield found(t.slice(low, high - low))
            held = t.slice(int(starts[-1]))
        if held is not None:
            yield found(held)

    return run


def _verify(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                hits = []
                for x, y in zip(_sets(part["a_text"], n), _sets(part["b_text"], n), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    hits.append(den * both >= num * (len(x) + len(y) - both))
                ok = pa.array(hits, pa.bool_())
                yield pa.RecordBatch.from_arrays([part["a_id"].filter(ok), part["b_id"].filter(ok)], ["a", "b"])

    return run


def join_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of each row: texts link when den * |A & B| >= num * |A | B| over n-word shingles.

    Equal sets form a class first (class_id: its smallest doc_id), so copies are never paired. Shingles are ordered rarest first by a count
    over all texts in hash buckets, ties by hash; each class sends its prefix. Classes that share a prefix shingle are candidates, under
    length, positional and suffix filters; groups of more than ``SMALL_GROUP`` classes are linked by stars first, and only classes that this
    leaves in different components meet all with all, in blocks of bounded size, so no link between components is lost.
    Each candidate pair is verified once, on its texts. component_id is the smallest doc_id reachable by links.
    Null or wordless text: no shingles, component of its own. Null ids: the row takes part by its text, and has its component's doc_id if
    one of these is not null. Repeated rows are equal rows; rows that repeat a doc_id with other text stand for one node. Other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    scanned = scratch.write(rows.mapInArrow(_summaries(n), "doc_id long, h long, n_shingles long, cls binary, bucket int, freq long"), "summaries")
    texts = scanned.where("bucket IS NULL").select("doc_id", "h", "n_shingles", "cls")
    counted = scanned.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("freq").alias("n")).toPandas()
    rarity = np.zeros(1 << BUCKET_BITS, np.uint32)
    rarity[counted["bucket"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**32 - 1)

    # Distinct entries are dealt by token and class, so that a frequent token is no hot task; tokens of one class link nothing.
    distinct = docs.select("text").mapInArrow(_prefixes(n, num, den, rarity), "token long, cls binary, size int, pos int").dropDuplicates(["token", "cls"])
    distinct = scratch.write(distinct, "prefixes")
    members = distinct.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    entries = scratch.write(distinct.join(members, "token"), "shared-prefixes")
    scratch.drop(distinct)
    classes = texts.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")).select("cls", F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("h"))
    # A class is the node of its smallest doc_id; one without any is a node of its own, after all others.
    nameless = F.col("class_id").isNull()
    node = F.struct(nameless.alias("nameless"), F.col("class_id").alias("id"), F.when(nameless, F.col("cls")).alias("cls"))
    node_type = "struct<nameless:boolean,id:bigint,cls:binary>"
    classes = classes.withColumn("node", node)
    sets = docs.select("text").mapInArrow(_cells(n, num, den, rarity), "cls binary, cells binary, prefix binary").dropDuplicates(["cls"]).join(classes.select("cls", "node"), "cls")
    with_cells = entries.join(sets, "cls").mapInArrow(_suffix_cells, f"token long, cls binary, size int, pos int, members long, node {node_type}, cells binary")
    filled = scratch.write(with_cells, "suffix-cells")
    scratch.drop(entries)

    filters = _Filters(num, den)

    def linked(pairs: DataFrame) -> DataFrame:
        """Candidate pairs whose texts link; only the texts of candidates are fetched."""
        pairs = scratch.write(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            return scratch.write(docs.sparkSession.createDataFrame([], f"a {node_type}, b {node_type}"), "verified")
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        wanted = classes.join(ends, "cls", "left_semi").hint("shuffle_hash")
        bodies = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["class_id"]) & (rows["h"] == wanted["h"])).select("cls", "node", "text")
        bodies = scratch.write(bodies.dropDuplicates(["cls"]), "bodies")
        side = lambda s: bodies.select(F.col("cls").alias(s), F.col("node").alias(f"{s}_id"), F.col("text").alias(f"{s}_text"))
        whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a_id", "b_id", "a_text", "b_text")
        out = scratch.write(whole.mapInArrow(_verify(n, num, den), f"a {node_type}, b {node_type}"), "verified")
        scratch.drop(pairs, bodies)
        return out

    small = filled.where(F.col("members") <= SMALL_GROUP).repartition("token").sortWithinPartitions("token").select("token", "cls", "size", "pos", "cells").mapInArrow(_small_groups(filters), _PAIR)
    # The centre of a star is the text that has fewest shingles rarer than this one: near copies add rare ones of their own.
    large = filled.where(F.col("members") > SMALL_GROUP)
    centres = large.groupBy("token").agg(F.min(F.struct("pos", "size", "cls", "cells")).alias("centre"))
    run = F.pmod(F.xxhash64("cls"), F.ceil(F.col("members") / STAR_RUN))
    entry = F.struct("pos", "size", "cls", "cells")
    starred = large.withColumn("neighbour", F.lag(entry).over(Window.partitionBy("token", run).orderBy("pos", "size", "cls"))).join(centres, "token")
    links = linked(small.unionByName(starred.select("cls", "size", "pos", "cells", "centre", "neighbour").mapInArrow(_star_pairs(filters), _PAIR)))
    found = scratch.write(components(links), "components")

    placed = large.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("component", "node")).drop("of")
    placed = scratch.write(placed.select("token", "cls", "size", "pos", "cells", "members", F.xxhash64("component").alias("component")), "placed")
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    crossed = placed.join(open_tokens, "token").withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    crossed = crossed.select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "size", "pos", "cells", "component")
    more = linked(crossed.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(_block_pairs(filters), _PAIR))
    scratch.drop(filled, placed)
    if more.limit(1).count():
        found = scratch.write(components(links.unionByName(more)), "components")
    scratch.drop(links, more)

    labels = classes.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("cls", "class_id", F.coalesce(F.col("component.id"), "class_id").alias("component"))
    out = texts.join(labels, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their group; rows without a doc_id stay."""
    kept = join_components(docs, n, num, den).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id IS NOT NULL").join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
