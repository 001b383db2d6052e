"""Approximate nearest neighbours by randomly rotated one-bit codes, in lists of near vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.storage import Scratch

#: At most so many rows fit the lists and the number of lists to probe; all rows are indexed.
FIT_ROWS = 16384
#: Rows to a list, and the most lists of one dimension.
LIST_ROWS, MAX_LISTS = 1024, 4096
#: Lists are probed until they hold this share of the true neighbours among the fitted rows.
LIST_RECALL = 0.98
#: Half the width of the error bound, in standard deviations of the estimate.
ERROR_SCALE = 1.9
#: Bits to which a query's rotated components are rounded.
QUERY_BITS = 6
#: At most so many distinct vectors and queries meet in one task.
ROW_BLOCK, QUERY_BLOCK = 32768, 4096


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    b = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(b, ((0, 0), (0, -b.shape[1] % 8)))).view("<u8")


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, their lengths, and the inner product of each unit residual with its code."""
    length = np.linalg.norm(residual, axis=1)
    turned = (residual / np.where(length > 0, length, 1)[:, None]) @ turn.T
    fit = np.abs(turned).sum(1) / np.sqrt(residual.shape[1])
    return packed(turned > 0), length, np.where(length > 0, fit, 1)


class Planes:
    """Rotated queries, rounded to ``QUERY_BITS`` bits and laid out by bit, to be met by packed codes."""

    def __init__(self, queries: np.ndarray, turn: np.ndarray) -> None:
        q = queries @ turn.T
        self.low, levels = q.min(1), (1 << QUERY_BITS) - 1
        self.step = np.maximum((q.max(1) - self.low) / levels, 1e-300)
        rounded = np.clip(np.rint((q - self.low[:, None]) / self.step[:, None]), 0, levels).astype(np.uint8)
        self.words = np.stack([packed(rounded >> j & 1 > 0) for j in range(QUERY_BITS)])
        # The sum of the rounded components themselves, so that signs of +1 and -1 come from bits alone.
        self.total = self.low * q.shape[1] + self.step * rounded.sum(1)
        self.root = np.sqrt(q.shape[1])

    def products(self, which: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of the queries ``which`` with codes taken as vectors of +-1/sqrt(dim)."""
        out = np.zeros((len(which), len(codes)), np.uint32)
        ones = np.zeros(len(codes), np.uint32)
        for w in range(codes.shape[1]):
            word = codes[:, w]
            ones += np.bitwise_count(word)
            for j in range(QUERY_BITS):
                out += np.bitwise_count(self.words[j, which, w][:, None] & word).astype(np.uint32) << np.uint32(j)
        inner = self.low[which, None] * ones + self.step[which, None] * out
        return (2 * inner - self.total[which, None]) / self.root


@dataclass
class Lists:
    """Centres of the lists of one dimension, the spread of each around its centre, and how many lists a query probes."""

    centres: np.ndarray
    spread: np.ndarray
    sample: np.ndarray
    probes: int

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre."""
        half = (self.centres**2).sum(1) / 2
        return np.concatenate([np.argmax(x[i : i + 4096] @ self.centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists by the inner product that their best rows may have with each query."""
        return np.argsort(-(q @ self.centres.T + 2 * np.linalg.norm(q, axis=1)[:, None] * self.spread), axis=1, kind="stable")


def fit_lists(sample: np.ndarray, rows: int, k: int, seed: int, list_rows: int = LIST_ROWS, recall: float = LIST_RECALL, rounds: int = 8, tried: int = 512) -> Lists:
    """Lists for ``rows`` vectors by k-means over a sample; as many are probed as hold ``recall`` of the neighbours that brute force finds within the sample."""
    x, rng = np.unique(sample, axis=0), np.random.default_rng(seed)
    n = int(min(MAX_LISTS, max(1, rows // list_rows), len(x)))
    lists = Lists(x[rng.choice(len(x), n, replace=False)].copy(), np.zeros(n), sample, n)
    for _ in range(rounds):
        at = lists.home(x)
        many = np.bincount(at, minlength=n)
        sums = np.zeros_like(lists.centres)
        np.add.at(sums, at, x)
        lists.centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], lists.centres)
    at = lists.home(x)
    far = np.bincount(at, ((x - lists.centres[at]) ** 2).sum(1), n) / np.maximum(np.bincount(at, minlength=n), 1)
    lists.spread = np.sqrt(far / x.shape[1])
    some = rng.choice(len(x), min(tried, len(x)), replace=False)
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    k = min(k, len(x) - 1)
    if k > 0 and n > 1:
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = lists.order(x[some])
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[None, :].repeat(len(some), 0), 1)
        found = np.cumsum(np.bincount(np.take_along_axis(rank, at[near], 1).ravel(), minlength=n)) / near.size
        lists.probes = int(np.searchsorted(found, recall)) + 1
    return lists


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _digests(x: np.ndarray) -> list[bytes]:
    """Equal vectors have equal digests; minus zero is zero."""
    return [xxhash.xxh3_128_digest(v.tobytes()) for v in x + 0.0]


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _coder(models: dict[int, Lists], seed: int):
    """Adds each vector's digest, list, code and correction scalars."""
    names = ["vec_id", "vector", "dim", "digest", "list", "code", "length", "fit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {dim: rotation(dim, seed) for dim in models}
        for batch in batches:
            for dim, part in _by_dim(batch):
                x, lists = _matrix(part.column(1), dim), models[dim]
                home = lists.home(x)
                code, length, fit = encode(x - lists.centres[home], turns[dim])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_digests(x), pa.binary()), pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(fit)], names)

    return run


def _add_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part in _by_dim(batch):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_digests(_matrix(part.column(1), dim)), pa.binary())], ["vec_id", "vector", "dim", "digest"])


def _prober(models: dict[int, Lists], ids: dict[int, np.ndarray], blocks: dict[int, list[list[int]]], k: int):
    """The lists that each query probes (more where these hold too few ids), the blocks they lie in, and a score that its k best reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                q, lists = _matrix(part.column(2), dim), models[dim]
                order = lists.order(q)
                held = np.cumsum(ids[dim][order], axis=1)
                probes = np.maximum(lists.probes, (held < k + 1).sum(1) + 1)
                floor = np.full(len(q), -np.inf)
                if len(lists.sample) > k:  # the query itself may be among the sample, so one more
                    for low in range(0, len(q), 256):
                        floor[low : low + 256] = np.partition(q[low : low + 256] @ lists.sample.T, -k - 1, axis=1)[:, -k - 1]
                chosen = [o[:p].tolist() for o, p in zip(order, probes.tolist(), strict=True)]
                where = [sorted({b for i in c for b in blocks[dim][i]}) for c in chosen]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor), pa.array(chosen, pa.list_(pa.int32())), pa.array(where, pa.list_(pa.int32()))], ["dim", "digest", "vector", "floor", "probes", "blocks"])

    return run


def _searcher(models: dict[int, tuple[np.ndarray, int]], k: int, seed: int, error_scale: float):
    """Of a block's queries and rows: each query's k + 1 nearest ids in the lists that it probes."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        out: list[list] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            centres, n_lists = models[dim]
            rows = rows.sort_by("list")
            q, x = _matrix(queries["vector"], dim), _matrix(rows["vector"], dim)
            turn = rotation(dim, seed)
            planes, size = Planes(q, turn), np.linalg.norm(q, axis=1)
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), "<u8").reshape(len(x), -1)
            home, length, fit = (rows[c].to_numpy() for c in ("list", "length", "fit"))
            scale = length / fit
            # <q, x> is <q, centre> plus about length / fit times the code's product; the error falls off with the dimension.
            slack = error_scale * length * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / max(dim - 1, 1))
            wanted = np.zeros((len(q), n_lists), bool)
            probes = queries["probes"].combine_chunks()
            wanted[np.repeat(np.arange(len(q)), np.diff(probes.offsets.to_numpy())), probes.flatten().to_numpy()] = True
            floor = queries["floor"].to_numpy().copy()
            ids = rows["ids"].combine_chunks()
            many, all_ids = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            begin = np.cumsum(many) - many
            best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(q))]
            top = np.full((len(q), k + 1), -np.inf)
            starts = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
                asking = np.flatnonzero(wanted[:, home[low]])
                middle = q[asking] @ centres[home[low]]
                for first in range(0, len(asking), 64):
                    which = asking[first : first + 64]
                    estimate = middle[first : first + 64, None] + planes.products(which, codes[low:high]) * scale[low:high]
                    error = size[which, None] * slack[low:high] + (error_scale / np.sqrt(12)) * planes.step[which, None] * scale[low:high]
                    near = estimate + error >= floor[which, None]
                    for row, i in zip(near, which.tolist(), strict=True):
                        at = np.flatnonzero(row)
                        if not len(at):
                            continue
                        exact = x[low + at] @ q[i]
                        if len(at) > k + 1:  # equal scores go on to where ids tell them apart
                            keep = exact >= np.partition(exact, -k - 1)[-k - 1]
                            at, exact = at[keep], exact[keep]
                        best[i].append((at + low, exact))
                        got = np.concatenate((top[i], exact))
                        top[i] = np.partition(got, -k - 1)[-k - 1 :] if len(got) > k + 1 else got
                        floor[i] = max(floor[i], top[i].min())
            for i, parts in enumerate(best):
                if not parts:
                    continue
                at, exact = np.concatenate([a for a, _ in parts]), np.concatenate([s for _, s in parts])
                good = exact >= top[i].min()
                at, exact = at[good], exact[good]
                exact = np.array([float((q[i] * x[a]).sum()) for a in at]) if len(at) else exact
                n = many[at]
                vec = all_ids[np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                score = np.repeat(exact, n)
                order = np.lexsort((vec, -score))[: k + 1]
                out[0].append(np.full(len(order), i))
                out[1].append(vec[order])
                out[2].append(score[order])
        at, vec, score = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
        return pa.table([pa.array(np.full(len(at), dim), pa.int32()), queries["digest"].combine_chunks().take(pa.array(at, pa.int64())), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["dim", "digest", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 20, query_step: int = 20, seed: int = 5, error_scale: float = ERROR_SCALE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``query_step``, the ``k`` other rows of largest inner product.

    Rows go to the list of their nearest centre, and a one-bit code of the rotated rest. Centres, and how many lists a query probes, are
    fitted on at most about ``fit_rows`` rows, so that the lists hold nearly all true neighbours found within these; every row is indexed.
    Within a list the packed codes and correction scalars bound each inner product; rows whose upper bound reaches the k-th best score known
    so far are scored exactly, in double precision, ties to the smaller vec_id. Equal vectors stand in the index once, with the k + 1
    smallest of their ids, of which no query can name more, so a common vector is no hot list; lists and queries meet in bounded blocks.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null vec_ids; vectors of different
    dimensions don't meet; rows that repeat a vec_id are rows of their own, except that a row never meets one of its own vec_id. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector")).where(F.col("vec_id").isNotNull() & fine).withColumn("dim", F.size("vector"))
    per = {r["dim"]: r["n"] for r in v.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not per:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scratch = Scratch(spark, "nearest")
    hashed = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(sum(per.values())))
    sample = v.where(hashed < fit_rows).orderBy(hashed, "vec_id").limit(2 * fit_rows).toArrow()
    models = {dim: fit_lists(_matrix(sample.filter(pa.compute.equal(sample["dim"], dim))["vector"], dim), n, k, seed) if dim in set(sample["dim"].to_pylist()) else Lists(np.zeros((1, dim)), np.zeros(1), np.zeros((0, dim)), 1) for dim, n in per.items()}

    coded = v.mapInArrow(_coder(models, seed), f"vec_id long, vector array<{kind}>, dim int, digest binary, list int, code binary, length double, fit double")
    same = Window.partitionBy("dim", "digest").orderBy("vec_id")
    first = coded.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    classes = first.groupBy("dim", "digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first(F.struct("vector", "list", "code", "length", "fit")).alias("c")).select("dim", "digest", "ids", "c.*")
    classes = scratch.write(classes, "classes")

    # Small lists share a block, large ones are parted; a row per list reaches the driver.
    held: dict[int, np.ndarray] = {dim: np.zeros(len(m.centres), np.int64) for dim, m in models.items()}
    blocks: dict[int, list[list[int]]] = {dim: [[] for _ in m.centres] for dim, m in models.items()}
    counts = classes.groupBy("dim", "list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).orderBy("dim", "list").collect()
    placed, total = [], sum(r["n"] for r in counts)
    room = int(min(ROW_BLOCK, max(4096, total // 8)))
    block, used, last = -1, room, None
    for r in counts:
        held[r["dim"]][r["list"]] = r["ids"]
        parts = -(-r["n"] // room)
        if parts > 1 or used + r["n"] > room or r["dim"] != last:
            block, used = block + 1, 0
        blocks[r["dim"]][r["list"]] = list(range(block, block + parts))
        placed.append((r["dim"], r["list"], block, parts))
        block, used, last = block + parts - 1, (room if parts > 1 else used + r["n"]), r["dim"]
    places = spark.createDataFrame(placed, "dim int, list int, block int, parts int")
    rows = classes.join(F.broadcast(places), ["dim", "list"]).withColumn("block", F.col("block") + F.pmod(F.xxhash64("digest"), "parts").cast("int"))

    asked = scratch.write(v.where(F.col("vec_id") % query_step == 0).mapInArrow(_add_digest, f"vec_id long, vector array<{kind}>, dim int, digest binary"), "asked")
    distinct = asked.groupBy("dim", "digest").agg(F.first("vector").alias("vector"))
    probing = distinct.mapInArrow(_prober(models, held, blocks, k), f"dim int, digest binary, vector array<{kind}>, floor double, probes array<int>, blocks array<int>")
    probing = scratch.write(probing, "probing").select("dim", "digest", "vector", "floor", "probes", F.explode("blocks").alias("block"))
    parts = probing.groupBy("dim", "block").agg(F.ceil(F.count("*") / F.lit(int(min(QUERY_BLOCK, max(512, total // 80))))).cast("int").alias("parts"))
    queries = probing.join(parts, ["dim", "block"]).withColumn("part", F.pmod(F.xxhash64("digest"), "parts").cast("int")).drop("parts")
    rows = rows.drop("parts").join(parts, ["dim", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["dim", "block", "part"]
    centres = {dim: (m.centres, len(m.centres)) for dim, m in models.items()}
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_searcher(centres, k, seed, error_scale), "dim int, digest binary, vec_id long, score double")
    by = Window.partitionBy("dim", "digest").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    best = best.groupBy("dim", "digest").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = asked.select("dim", "digest", F.col("vec_id").alias("query_id")).join(best, ["dim", "digest"]).select("query_id", F.posexplode(others).alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")
