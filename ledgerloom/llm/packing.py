"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructType

CAPACITY = 2048
END_ID = 1
WINDOW_TOKENS = 1 << 19


#: Fixed value: how a byte-level tokenizer file that says use_regex parts text before merging.
BYTE_LEVEL_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others by 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes and ids of a plain byte-level BPE file whose ids are the order of its merges; None for any other kind."""
    model, parts = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or not parts.get("use_regex", True):
        return None
    added, byte_of = {t["content"] for t in spec.get("added_tokens") or ()}, _byte_of()
    words = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if sorted(words.values()) != list(range(len(words))) or [words.get(m) for m in merged] != list(range(256, len(words))) or not all(c in byte_of for t in words for c in t):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in words.items()}


class Tokenizer:
    """Ids of texts as the library gives them for a tokenizer file.

    A plain byte-level BPE file is merged by rank, whole texts at a time, without the library's offsets; texts that hold an added token's
    string, and files of any other kind, go through the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        ranks = byte_level_ranks(spec)
        self.ranked = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PARTS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, text: str) -> np.ndarray:
        """The library's encode(text, add_special_tokens=False)."""
        if self.ranked is None or any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked.encode_ordinary(text), np.uint32)


@functools.lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    """One for all tasks of a worker process."""
    return Tokenizer(path)


def pack_window(pieces: list[tuple], capacity: int, linear: float, quadratic: float) -> tuple[list[list[tuple]], list[tuple]]:
    """Pack (row, start, ids) pieces shorter than ``capacity`` into as many full sequences as their tokens fill; return these and what is left.

    Pieces go by descending cost (linear plus quadratic in their length) to the cheapest sequence with room; those that fit nowhere are cut
    to fill what room remains.
    """
    n = sum(len(p[2]) for p in pieces) // capacity
    if not n:
        return [], pieces
    cost, room = np.zeros(n), np.full(n, capacity)
    price = lambda k: linear * k + quadratic * k * k
    bins: list[list[tuple]] = [[] for _ in range(n)]
    over = []
    for p in sorted(pieces, key=lambda p: -price(len(p[2]))):
        k = len(p[2])
        best = int(np.where(room >= k, cost, np.inf).argmin())
        if room[best] < k:
            over.append(p)
            continue
        bins[best].append(p)
        cost[best] += price(k)
        room[best] -= k
    rest, open_ = [], [int(i) for i in np.argsort(cost, kind="stable") if room[i]]
    for row, start, ids in over:
        while len(ids) and open_:
            k = min(len(ids), int(room[open_[0]]))
            bins[open_[0]].append((row, start, ids[:k]))
            room[open_[0]] -= k
            start, ids = start + k, ids[k:]
            if not room[open_[0]]:
                open_.pop(0)
        if len(ids):
            rest.append((row, start, ids))
    if open_:  # whole pieces that found room leave some: what is left over fills it
        raise AssertionError("sequences can't stay open while tokens are left")
    return bins, rest


def tail_sequences(pieces: list[tuple], capacity: int) -> Iterator[list[tuple]]:
    """Cut what is left at the end into sequences whose lengths are powers of two, largest first: these need no padding."""
    total, pieces = sum(len(p[2]) for p in pieces), pieces[::-1]
    while total:
        want, out = min(capacity, 1 << (total.bit_length() - 1)), []
        total -= want
        while want:
            row, start, ids = pieces.pop()
            k = min(want, len(ids))
            out.append((row, start, ids[:k]))
            if k < len(ids):
                pieces.append((row, start + k, ids[k:]))
            want -= k
        yield out


def _packer(path: str, capacity: int, linear: float, quadratic: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder, number = tokenizer(path), (task.partitionId() if task else 0) << 36

        def table(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in range(6)]
            for s in sequences:
                offset = 0
                for (doc, tokens), start, ids in s:
                    for c, v in zip(cols, (doc, start, ids.astype("<u4").tobytes(), tokens, number, offset), strict=True):
                        c.append(v)
                    offset += len(ids)
                number += 1
            lengths = [len(x) // 4 for x in cols[2]]
            arrays = [cols[0], cols[1], lengths, cols[2], *cols[3:]]
            return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(docs), 256):
                full = []
                for doc, text in zip(docs[low : low + 256], texts.slice(low, 256).to_pylist(), strict=True):
                    ids = np.append(encoder.encode(text or ""), np.uint32(END_ID))
                    whole = len(ids) // capacity * capacity
                    full += [[((doc, len(ids)), at, ids[at : at + capacity])] for at in range(0, whole, capacity)]
                    if whole < len(ids):
                        held.append(((doc, len(ids)), whole, ids[whole:]))
                        tokens += len(ids) - whole
                if full:
                    yield table(full)
                if tokens >= WINDOW_TOKENS:
                    packed, held = pack_window(held, capacity, linear, quadratic)
                    tokens = sum(len(p[2]) for p in held)
                    yield table(packed)
        packed, held = pack_window(held, capacity, linear, quadratic)
        yield table(packed)
        yield table(list(tail_sequences(held, capacity)))

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's plus an end id; null text counts as empty (the end id alone). Each input partition is packed in
    windows of bounded size as it streams by, so there is no shuffle, and a sequence holds pieces of one partition; what a window
    leaves over goes to the next one, and at the end into sequences of power-of-two lengths. Sequence ids hold the partition's number.
    Null ids and repeated rows are packed like any other row; other columns are ignored.
    """
    schema = StructType()
    for name in ("doc_id", "start", "length"):
        schema = schema.add(name, LongType())
    schema = schema.add("ids", BinaryType())
    for name in ("doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, LongType())
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer_path, capacity, linear, quadratic, to_arrow_schema(schema)), schema)
