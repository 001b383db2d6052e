"""License scans: which word windows of a text contain a license template, by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import Words, class_table, slices, text_bytes

#: A word is a run of digits, letters a-z (after lower-casing) and bytes of other scripts.
MEMBER = class_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
THRESHOLD = 0.8
#: Phrases that name a license where their words stand side by side.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Sentences by which works declare or quote a license, as sets of words; and their telling words, without which nothing is found.
TEMPLATES = (
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted associated"),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "commons noncommercial"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
)


class Vocabulary:
    """The words of phrases and templates, found in texts by hash and then held against their bytes."""

    def __init__(self, texts: list[str]) -> None:
        words = sorted({w for t in texts for w in t.split()})
        data, offsets = text_bytes(pa.array(words))
        hashes = Words(data, offsets, 0, len(words), MEMBER).hashes()
        order = np.argsort(hashes)
        self.words = [words[i].encode() for i in order]
        self.hashes, self.at = hashes[order], {w.decode(): i for i, w in enumerate(self.words)}

    def __len__(self) -> int:
        return len(self.words)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's word number, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def ids(self, text: str) -> list[int]:
        return [self.at[w] for w in text.split()]


def _vocabulary() -> Vocabulary:
    return Vocabulary([t for t, _ in PHRASES] + [t for _, t, _ in TEMPLATES])


def token_counts(docs: DataFrame) -> np.ndarray:
    """How often each vocabulary word stands in all texts; one row per word and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary()
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for low, high in slices(offsets):
                got = vocabulary.find(Words(data, offsets, low, high, MEMBER).hashes())
                total += np.bincount(got[got >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    got = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(_vocabulary()), np.int64)
    for r in got:
        out[r["word"]] = r["n"]
    return out


class _Template:
    """A template's words as ranks, rarest first; a window is its number of words over the threshold, so others may stand between."""

    def __init__(self, words: list[int], telling: set[int], threshold: float) -> None:
        self.tokens = sorted(set(words))
        self.telling = [t in telling for t in self.tokens]
        self.need = max(1, ceil(threshold * len(self.tokens) - 1e-9))
        self.window = max(len(words), ceil(len(words) / threshold - 1e-9)) if threshold > 0 else len(words)
        self.prefix = self.tokens[: len(self.tokens) - self.need + 1]

    def places(self, ranks: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first word, number of words, containment) of places in the rows' words that don't overlap, from left to right."""
        rare = np.flatnonzero(np.isin(ranks, self.prefix))
        if not len(rare):
            return
        hits = np.flatnonzero(np.isin(ranks, self.tokens))
        stop = np.minimum(hits + self.window, first[np.searchsorted(first, hits, "right")])
        # A window that holds enough starts at a hit and has a word of the prefix and enough hits, equal words counted each.
        near = np.append(rare, len(ranks))[np.searchsorted(rare, hits)] < stop
        at = near & (np.searchsorted(hits, stop) - np.arange(len(hits)) >= self.need)
        start, stop, in_hits = hits[at], stop[at], ranks[hits]
        overlap, end, telling = np.zeros(len(start), np.int64), start.copy(), np.ones(len(start), bool)
        for token, tells in zip(self.tokens, self.telling, strict=True):
            of = hits[in_hits == token]
            following = np.append(of, len(ranks))[np.searchsorted(of, start)]
            has = following < stop
            overlap += has
            end = np.where(has, np.maximum(end, following), end)
            if tells:
                telling &= has
        good = np.flatnonzero(telling & (overlap >= self.need))
        start, end, overlap = start[good], end[good] + 1, overlap[good]
        i = 0
        while i < len(start):
            # Of the windows that start within the first one: the fullest, then the first to end, then the shortest.
            among = range(i, int(np.searchsorted(start, end[i])))
            best = min(among, key=lambda k: (-overlap[k], end[k], -k))
            yield int(start[best]), int(end[best] - start[best]), int(overlap[best]) / len(self.tokens)
            i = int(np.searchsorted(start, end[best]))


def _scanner(counts: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary()
        rank = np.empty(len(vocabulary), np.int64)  # rarest first, ties by word
        rank[sorted(range(len(vocabulary)), key=lambda i: (counts[i], vocabulary.words[i]))] = np.arange(len(vocabulary))
        phrases = [(vocabulary.ids(t), label) for t, label in PHRASES]
        templates = [(label, _Template([int(rank[i]) for i in vocabulary.ids(t)], {int(rank[i]) for i in vocabulary.ids(telling)}, threshold)) for label, t, telling in TEMPLATES]

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = batch.num_rows
            n_words, n_base, first, last, score = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1), np.zeros(rows)
            base: list[set[str]] = [set() for _ in range(rows)]
            more: list[set[str]] = [set() for _ in range(rows)]
            found: list[list[dict]] = [[] for _ in range(rows)]
            for low, high in slices(offsets):
                words = Words(data, offsets, low, high, MEMBER)
                ids = vocabulary.find(words.hashes())
                n_words[low:high] = words.counts
                row_of = lambda i: int(np.searchsorted(words.first, i, "right")) - 1  # noqa: B023, E731
                for phrase, label in phrases:
                    k = len(phrase)
                    hit = np.ones(max(len(ids) - k + 1, 0), bool)
                    for j, w in enumerate(phrase):
                        hit &= ids[j : j + len(hit)] == w
                    for i in np.flatnonzero(hit).tolist():
                        r = row_of(i)
                        exact = all(words.data[words.start[i + j] : words.end[i + j]].tobytes() == vocabulary.words[w] for j, w in enumerate(phrase))
                        if i + k <= words.first[r + 1] and exact:
                            n_base[low + r] += 1
                            base[low + r].add(label)
                            at = i - int(words.first[r])
                            first[low + r] = at if first[low + r] < 0 else min(first[low + r], at)
                            last[low + r] = max(last[low + r], at)
                ranks = np.where(ids >= 0, rank[ids], len(vocabulary))
                for label, template in templates:
                    for start, n, share in template.places(ranks, words.first):
                        r = row_of(start)
                        more[low + r].add(label)
                        score[low + r] = max(score[low + r], share)
                        found[low + r].append({"label": label, "first_word": start - int(words.first[r]), "n_words": n, "containment": share})
            score[n_base > 0] = 1.0
            text = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            place = lambda a: pa.array(a, pa.int64(), mask=a < 0)
            blocks = pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), place(first), place(last), text(base), text([a | b for a, b in zip(base, more, strict=True)]), pa.array(score), blocks],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
            )

    return run


def scan_licences(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the matching blocks of every row.

    Base: places where a phrase's words stand side by side. Method: windows (blocks) of a template's length over ``threshold``, anywhere in
    a text whatever its line ends, whose set of words contains at least ``threshold`` of the template's and all of its telling words;
    template words stand in global frequency order, counted over all texts, and only windows with a word of a template's prefix and
    enough template words are looked at. Of overlapping windows of one template the fullest is the block, from its first to its last word. Templates are a short fixed list, so they go to each task. score: 1 where a
    phrase stands, else the largest containment that reaches the threshold, else 0. Null texts count as empty: no words, empty labels, null
    places. Rows are independent, so null or repeated ids are scanned like others; other columns are ignored.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first_word:bigint,n_words:bigint,containment:double>>"
    return docs.select("doc_id", "text").mapInArrow(_scanner(token_counts(docs), threshold), schema)
