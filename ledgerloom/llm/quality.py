"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import written
from ledgerloom.llm.textkit import Words, class_table, slices, text_bytes

#: At most about so many labelled rows are fitted; the rest of a larger set is left out by a hash of doc_id.
FIT_ROWS = 20_000
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "blank", "newline", "stop", "symbol", "high", "control", "log_words", "word_bytes", "word_spread", "longest_word",
    "distinct_words", "top_word", "same_as_last", "same_as_last_but_one", "distinct_pairs", "ends_in_symbol", "ends_in_stop", "starts_upper", "words_per_line", "entropy",
)

_CLASSES = [class_table(range(97, 123)), class_table(range(65, 91)), class_table(range(48, 58)), class_table([32]), class_table([10]), class_table(b".,;:?'\"()-"), class_table(b"!#$%&*+/<=>@[\\]^_`{|}~"), class_table(range(128, 256))]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _t in enumerate(_CLASSES):
    _CLASS_OF[_t] = _i
_N = len(_CLASSES) + 1


def _runs(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the largest count of one value, of each row."""
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    owner, count = (key[start] >> np.uint64(44)).astype(np.int64), np.diff(np.append(start, len(key)))
    top = np.zeros(rows)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=rows), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; null and empty texts get zeros throughout."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for low, high in slices(offsets):
        rows, size = high - low, np.diff(offsets[low : high + 1])
        raw, row = data[offsets[low] : offsets[high]], np.repeat(np.arange(rows), size)
        n = np.maximum(size, 1)
        kinds = np.bincount(row * _N + _CLASS_OF[raw], minlength=rows * _N).reshape(rows, _N)
        counts = np.bincount(row * 256 + raw, minlength=rows * 256).reshape(rows, 256) / n[:, None]
        entropy = -(counts * np.log2(np.where(counts > 0, counts, 1))).sum(1)
        words = Words(data, offsets, low, high)
        hashes, many = words.hashes(), words.counts
        m, of, length = np.maximum(many, 1), np.repeat(np.arange(rows), many), words.end - words.start
        mean = np.bincount(of, length, rows) / m
        spread = np.sqrt(np.maximum(np.bincount(of, length * length, rows) / m - mean**2, 0))
        longest = np.zeros(rows)
        np.maximum.at(longest, of, length)
        distinct, top = _runs(of, hashes, rows)
        near = [np.bincount(of[k:][(hashes[k:] == hashes[:-k]) & (of[k:] == of[:-k])], minlength=rows) / m for k in (1, 2)]
        inner = of[1:] == of[:-1]
        pairs, _ = _runs(of[1:][inner], (hashes[1:] * np.uint64(3) ^ hashes[:-1])[inner], rows)
        last, first = _CLASS_OF[raw[words.end - 1]], _CLASS_OF[raw[words.start]]
        share = lambda which: np.bincount(of[which], minlength=rows) / m  # noqa: E731, B023
        out[low:high] = np.column_stack((
            np.log1p(size), kinds / n[:, None], np.log1p(many), mean, spread, longest, distinct / m, top / m, *near, pairs / np.maximum(many - 1, 1),
            share(last == 6), share(last == 5), share(first == 1), many / (kinds[:, 4] + 1), entropy,
        ))
    return out


@dataclass
class Forest:
    """Boosted trees of one depth, flattened: node k of a tree has children 2k+1 and 2k+2; leaves are numbered from the left."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic boosting; each split is the best of the histogram of gradients over ``bins`` quantile bins. One class only: a constant score."""
    positive = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(positive / (1 - positive))), 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    margin = np.full(len(y), base)
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            head, many = 2**level - 1, 2**level
            best = np.zeros(many)
            local = node - head
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * bins + binned[:, j]
                g, h = (np.cumsum(np.bincount(key, v, many * bins).reshape(many, bins), axis=1) for v in (gradient, weight))
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < least) | (all_h - h < least)] = 0
                gain = gain[:, : len(e)]
                at = gain.argmax(1)
                better = gain[np.arange(many), at] > best + 1e-9
                best = np.where(better, gain[np.arange(many), at], best)
                forest.feature[t, head : head + many][better] = j
                forest.cut[t, head : head + many][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), forest.feature[t, node]] > forest.cut[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        forest.leaf[t] = -rate * g / (h + ridge)
        margin += forest.leaf[t, leaf]
    return forest


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "features"])


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def train(features: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Fit on labelled rows outside the held-out third, at most about ``fit_rows`` of them, chosen by a hash of doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    many = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(many, 1))) < fit_rows)
    got = features.join(known, "doc_id").select("features", "quality", "doc_id").toArrow().sort_by("doc_id")
    x = np.array(got["features"].to_pylist(), np.float32).reshape(got.num_rows, len(FEATURES))
    return fit(x, got["quality"].to_numpy().astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and features of every row.

    Scores see the text alone. Null and empty texts are scored by their (zero) statistics; null doc_ids are never fitted and are not held
    out; labels that are null or neither 0 nor 1 are left out, and a document labelled twice counts once, with its larger label. Without
    labels, or with one class only, all scores are the smoothed share of label 1. Other columns are ignored.
    """
    features = written(docs.select("doc_id", "text").mapInArrow(_featurise, "doc_id long, features array<float>"), "features")
    forest = train(features, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], ["doc_id", "features", "score"])

    scored = features.mapInArrow(run, "doc_id long, features array<float>, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "features")


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject; they are scored as they stream by, without a join.

    Each row is judged by its text alone, so repeated rows and null ids fare alike; null texts are scored as empty ones. Without labels, or
    with one class only, all rows have one score, 0.5 or more where no label is 0.
    """
    features = docs.select("doc_id", "text").join(labels.where(~held_out()).select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_featurise, "doc_id long, features array<float>")
    forest = train(features, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(forest.score(statistics(batch.column(batch.schema.get_field_index("text")))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
