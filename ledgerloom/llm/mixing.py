"""Mixing sources to target weights with a splitting tree of multivariate-hypergeometric draws."""

from __future__ import annotations

import struct
from math import ceil

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType
from pyspark.sql.window import Window

from ledgerloom.llm.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
BLOCK_WORDS = 32768
SHARDS = 16
ROWS_PER_BUCKET = 4096
#: A shard of more words is written in several parts.
PART_WORDS = 1 << 22


def source_targets(sizes: list[int], weights: list[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Share sum(sizes) by weight; a target stops at ``repeats`` times its source, and the excess is reshared by weight."""
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact block quotas per (source, shard): each node of a binary tree draws its left half from a multivariate hypergeometric."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = counts
            return
        middle, total = (low + high) // 2, int(counts.sum())
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(counts, total * (middle - low) // (high - low), method="marginals") if total else counts
        node(left, low, middle)
        node(counts - left, middle, high)

    if quotas:
        node(np.array(quotas, np.int64), 0, shards)
    return out


ROUNDS = 6


def radix(blocks: int) -> tuple[int, int]:
    """Two numbers near each other whose product is ``blocks`` or a little more."""
    a = max(1, ceil(blocks**0.5))
    return a, max(1, -(-blocks // a))


def _hash(*values: int) -> int:
    """Spark's xxhash64 of longs."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def block_place(block: int, blocks: int, key: int, turn: int) -> int:
    """Where a block stands in the order of drawing: a keyed permutation of the numbers below ``blocks``, in alternating rounds over a mixed-radix pair, gone through again while the result isn't below ``blocks``."""
    a, b = radix(blocks)
    while True:
        left, right = block // b, block % b
        for i in range(ROUNDS):
            if i % 2:
                right = (right + _hash(key, turn, i, left)) % b
            else:
                left = (left + _hash(key, turn, i, right)) % a
        block = left * b + right
        if block < blocks:
            return block


#: ``block_place`` in SQL, of b in turn t.
_PLACE = f"""aggregate(sequence(1, 64), named_struct('x', b, 'ok', false), (w, nth_try) -> if(w.ok, w, element_at(transform(array(
    aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', w.x div high, 'r', w.x % high), (p, i) -> if(i % 2 = 1,
      named_struct('l', p.l, 'r', pmod(p.r + pmod(xxhash64(block_key, t, cast(i as bigint), p.l), high), high)),
      named_struct('l', pmod(p.l + pmod(xxhash64(block_key, t, cast(i as bigint), p.r), wide), wide), 'r', p.r)), p -> p.l * high + p.r)),
    x -> named_struct('x', x, 'ok', x < blocks)), 1)), w -> w.x)"""


def draws(source_words: int, quota: int, block_words: int) -> tuple[int, int, int, int]:
    """(blocks of one reading, whole readings, blocks drawn from the next reading, words of the last of these) that make up a source's quota.

    The last block of a reading may be short; where the drawn blocks' order puts it is up to ``last_words``.
    """
    blocks = -(-source_words // block_words)
    whole = quota // source_words if source_words else 0
    return blocks, whole, -(-(quota - whole * source_words) // block_words), quota - whole * source_words


def last_words(rest: int, drawn: int, blocks: int, source_words: int, block_words: int, short_at: int) -> tuple[int, int]:
    """(blocks drawn, words of the last one) for ``rest`` words, if the short block comes ``short_at``-th (from 0) in the order of drawing."""
    short = block_words * blocks - source_words
    before = (drawn - 1) * block_words - (short if short_at < drawn - 1 else 0)
    room = block_words - (short if short_at == drawn - 1 else 0)
    if rest - before <= room:
        return drawn, rest - before
    return drawn + 1, rest - before - room


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with size, source_size, target, taken and pieces: what the mix takes of each row, and where it goes.

    Each source's rows stand in a keyed random order and form a line of words, cut into blocks; the source's quota is its target in words.
    The line is read up to three times: whole while the quota lasts, then by blocks in the order of a keyed permutation, the last one in
    part. The tree shares all these blocks among ``shards``, and the order makes the shards' draws disjoint. pieces: array of (shard, block,
    turn, start_word, n_words, at), words counted within the row, and at within the block. ``shard_rows`` deals them out.
    Null texts have size 0; null sources are a source of their own, last; rows with equal ids and texts are rows like any other.
    Only one row per source reaches the driver. Own columns replace input columns of these names.
    """
    return _mix(docs, weights, shards, block_words, seed, keep)[0]


def _mix(docs: DataFrame, weights: tuple[float, ...], shards: int, block_words: int, seed: int, keep: list[str] | None = None) -> tuple[DataFrame, int]:
    """``mix`` and the number of words it takes in all."""
    own = ["size", "source_size", "target", "taken", "pieces"]
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # The rows' own columns travel in a struct, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct(*kept).alias("row"), "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    if "text" in kept:
        narrow = scratch.write(rows.select("source", "size", "key"), "sizes")
    else:
        narrow = rows = scratch.write(rows, "sizes")
    per = narrow.groupBy("source").agg(F.sum("size").alias("z"), F.count("*").alias("n")).collect()
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["z"] for r in per]
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(per))])
    quotas = [min(round(t), MAX_REPEATS * z) for t, z in zip(targets, sizes, strict=True)]
    plan, drawn_blocks = [], []
    for i, r in enumerate(per):
        blocks, whole, drawn, last = draws(sizes[i], quotas[i], block_words)
        key = _hash(seed, i)
        if drawn:
            drawn, last = last_words(last, drawn, blocks, sizes[i], block_words, block_place(blocks - 1, blocks, key, whole))
        plan.append([i, r["source"], sizes[i], targets[i], blocks, whole, drawn, last, key, *radix(blocks)])
        drawn_blocks.append(whole * blocks + drawn)
    cuts = np.cumsum(split_quotas(drawn_blocks, shards, seed), axis=1)
    names = ("nth", "of", "source_size", "target", "blocks", "whole", "drawn", "last", "block_key", "wide", "high")
    schema = StructType()
    for name, kind in zip(names, (LongType(), StringType(), LongType(), DoubleType(), *[LongType()] * 7), strict=True):
        schema = schema.add(name, kind)
    sources = spark.createDataFrame([(*p, c.tolist()) for p, c in zip(plan, cuts, strict=True)], schema.add("cuts", ArrayType(LongType())))
    bits = max(6, int(np.ceil(np.log2(max(1, sum(r["n"] for r in per)) / ROWS_PER_BUCKET + 1))))
    bucket = F.shiftrightunsigned("key", 64 - bits)
    same = lambda df: df.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket)
    # Positions in a source's line: sums of whole buckets first, then a window within a bucket, so that no task sees a whole source.
    heads = same(narrow).groupBy("nth", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("nth", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("head"))
    inside = Window.partitionBy("nth", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = same(rows).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(heads, ["nth", "bucket"]).withColumn("start", F.col("within") + F.col("head"))
    block = f"{block_words}L"
    room = f"case when t < whole then {block} when t > whole then 0L when o < drawn - 1 then {block} when o = drawn - 1 then last else 0L end"
    piece = f"""named_struct('shard', cast(size(filter(cuts, c -> c <= t * blocks + o)) as int), 'block', t * blocks + b, 'turn', cast(t as int),
        'start_word', greatest(0L, b * {block} - start), 'n_words', least(start + size, b * {block} + {room}) - greatest(start, b * {block}), 'at', greatest(0L, start - b * {block}))"""
    piece = f"element_at(transform(array({_PLACE}), o -> {piece}), 1)"
    pieces = f"""flatten(transform(array(0L, 1L, 2L), t -> if(size > 0 and (t < whole or t = whole and drawn > 0), filter(transform(sequence(start div {block}, (start + size - 1) div {block}), b -> {piece}), p -> p.n_words > 0),
        cast(array() as array<struct<shard:int,block:bigint,turn:int,start_word:bigint,n_words:bigint,at:bigint>>))))"""
    placed = placed.withColumn("pieces", F.expr(pieces)).withColumn("taken", F.expr("aggregate(pieces, 0L, (a, p) -> a + p.n_words)"))
    return placed.select("row.*", *own) if kept else placed.select(*own), sum(quotas)


def shard_rows(mixed: DataFrame, shards: int = SHARDS, seed: int = 17, parts: int = 1) -> DataFrame:
    """One row per piece, dealt to its shard and shuffled there; shard k is partitions k * parts to (k + 1) * parts - 1."""
    out = mixed.select("*", F.explode("pieces").alias("piece")).drop("pieces")
    # Source, block and place in the block are a piece's own, whatever the ids.
    out = out.withColumn("_order", F.xxhash64(F.lit(seed), F.col("source").isNull(), "source", "piece.block", "piece.at"))
    part = F.expr(f"cast(piece.shard * {parts}L + (shiftrightunsigned(_order, 40) * {parts}L) div {1 << 24}L as int)")
    return out.repartitionById(shards * parts, part).sortWithinPartitions("_order").drop("_order")


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The columns of ``docs``, a row for each piece of ``mix``, dealt and shuffled by ``shard_rows``.

    A piece that isn't its whole text holds the text's own bytes from its first word to the next piece's, so the pieces of a turn make up
    the text; where a source's quota ends within a text, the text's first words stay as they stand. Rows without words, null texts among
    them, are taken by no shard; null sources and ids, and repeated rows, are as in ``mix``. An empty table gives an empty one.
    """
    m, words = _mix(docs, weights, shards, block_words, seed)
    out = shard_rows(m, shards, seed, max(1, ceil(words / shards / PART_WORDS)))
    # A word with the blanks after it, the first one also with those before it: nothing of the text is between.
    words_and_blanks = F.regexp_extract_all("text", F.lit(r"(?:\A[\x20\x09-\x0D]+)?" + WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(words_and_blanks, F.col("piece.start_word").cast("int") + 1, F.col("piece.n_words").cast("int")), "")
    return out.withColumn("text", F.when(F.col("piece.n_words") < F.col("size"), cut).otherwise(F.col("text"))).select(*[c for c in docs.columns if c in out.columns])
