"""Suffix-array dedup: bytes that repeat an earlier document's passage are removed.

Every 50-byte window is owned by one gram inside it (the least hash of its 24-byte grams), so equal windows have equal owners and can meet
by the owner's hash. The windows that a gram owns side by side are one segment. Suffix arrays over the distinct segments around a gram,
one after another, are built by linear grouping construction; neighbours in them that agree over 50 bytes are equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.storage import Scratch
from ledgerloom.llm.textkit import mixed, slices, text_bytes

SPAN, GRAM = 50, 24
GRAMS = SPAN - GRAM + 1
#: Up to so many distinct segments around a gram make one text for a suffix array; more are parted first.
SPLIT = 32
#: Symbols that are worked on side by side.
CELLS = 1 << 20
#: Rows of whole groups that are worked on together.
ROWS = 1 << 16
#: Windows to a part of a segment.
PART = 3
#: Symbols beyond bytes: the bytes that a part's texts share, and the end of a text, which sorts first.
SHARED, END = "\u0100", "\uffff"
#: Grams so frequent in one slice of texts needn't meet row by row.
OFTEN = 32
#: What a document knows of a gram: an earlier document has it; none has; it is shared, by which documents is yet to be seen.
LATER, FIRST, TOLD = 0, 1, 2
#: Bytes that a segment of a document takes while it is shuffled.
SEGMENT_BYTES = 26


def suffix_arrays(symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of many short texts side by side; row l of ``symbols`` holds ``size[l]`` small non-negative numbers,
    the last of which is the text's smallest.

    Grouping construction: suffixes are grouped by their Lyndon prefixes, first by one symbol. Groups are taken in descending order; each
    member points to the last suffix before it in a smaller group (its previous smaller one), whose Lyndon prefix the member's extends, so
    these move up into groups of their own, ordered by how many members point to them. Then suffixes are emitted in ascending order: the
    one before each emitted suffix, and those its pointers lead to, come next in their groups.
    """
    lanes, width = symbols.shape
    base = np.arange(lanes) * width  # places and ranks of all texts are numbered through
    inside = np.arange(width) < size[:, None]
    filled = np.where(inside, symbols, 1 << 14).astype(np.int16)
    order = np.argsort(filled, axis=1, kind="stable")
    ranked = np.take_along_axis(filled, order, 1)
    fresh = np.ones((lanes, width), bool)
    fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(width), 0), axis=1)
    group = np.full(lanes * width, -1, np.int16 if width <= 32000 else np.int32)  # the first rank of each suffix's group, within its text
    group[(order + base[:, None]).ravel()] = begin.ravel()
    group[~inside.ravel()] = -1
    end = np.zeros(lanes * width, np.int64)  # of a group, by its first rank
    end[(begin + base[:, None]).ravel()] = np.broadcast_to(np.arange(1, width + 1), begin.shape).ravel()
    end = np.minimum(end, np.repeat(size, width))
    start = np.zeros(lanes * width, np.int64)  # of a group, by its last rank
    last = np.roll(fresh, -1, axis=1)
    last[:, -1] = True
    start[last.ravel()] = begin[last]
    start[base + size - 1] = begin[np.arange(lanes), size - 1]
    before = np.full(lanes * width, -1, np.int64)
    order = (order + base[:, None]).ravel()  # the suffix at each rank; groups are runs of ranks
    rank = np.empty(lanes * width, np.int64)
    rank[order] = np.arange(lanes * width)
    moving = np.zeros(lanes * width, bool)

    top, live = size.astype(np.int64), np.arange(lanes)
    while len(live):
        now = start[base[live] + top[live] - 1]
        many = top[live] - now
        lane = np.repeat(live, many)
        member = order[np.repeat(base[live] + now - np.cumsum(many) + many, many) + np.arange(len(lane))]
        current = np.repeat(now, many)
        point = member - 1
        point[member == lane * width] = -1
        look = np.flatnonzero(point >= 0)
        look = look[group[point[look]] > current[look]]
        while len(look):  # over larger groups, whose pointers are known
            point[look] = to = before[point[look]]
            look = look[to >= 0]
            look = look[group[point[look]] > current[look]]
        before[member] = point
        look = np.flatnonzero(point >= 0)
        look = look[group[point[look]] == current[look]]
        if len(look):
            while len(look):  # members of one run share the pointer of its first
                point[look] = to = before[point[look]]
                look = look[to >= 0]
                look = look[group[point[look]] == current[look]]
            before[member] = point
        key = np.sort(point[point >= 0])
        if len(key):
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            many = np.diff(np.append(head, len(key)))
            key = key[head]
            old = group[key].astype(np.int64)
            of = key // width * width + old  # the group's first rank, numbered through
            by = np.argsort(of * (width + 1) + many)
            key, of, many, old = key[by], of[by], many[by], old[by]
            new = np.concatenate(([True], of[1:] != of[:-1]))
            block = np.flatnonzero(new)
            new[1:] |= many[1:] != many[:-1]
            part = np.flatnonzero(new)
            which, block_end, part_end = of[block], np.append(block[1:], len(key)), np.append(part[1:], len(key))
            stop = np.repeat(end[which] - block_end, block_end - block)[part]  # rank of entry k is stop + k
            low, high = part + stop, part_end + stop
            end[which] -= block_end - block
            tail = np.repeat(which // width * width + end[which], block_end - block)
            rest = which[end[which] > old[block]]
            home = rest // width * width
            start[home + end[rest] - 1] = rest - home
            home = of[part] // width * width
            end[home + low] = high
            start[home + high - 1] = low
            group[key] = np.repeat(low, part_end - part)
            # The moved ones take the last ranks of their old groups; who stood there takes the ranks that they leave.
            left = rank[key]
            left = left[left < tail]
            tail += np.arange(len(key)) - np.repeat(block, block_end - block)
            moving[key] = True
            there = order[tail]
            there = there[~moving[there]]
            order[left], rank[there], order[tail], rank[key] = there, left, key, tail
            moving[key] = False
        top[live] = now
        live = live[now > 0]

    out = np.full(lanes * width, -1, np.int64)
    free = np.tile(np.arange(width), lanes) + np.repeat(base, width)  # where a group's next suffix goes, by its first rank
    placed = np.zeros(lanes * width, bool)
    first = base + size - 1
    out[base] = first
    placed[first] = True
    free[base + group[first]] += 1
    turn, nxt, lane = base.copy(), np.where(size > 1, first - 1, -1), np.arange(lanes)
    stop = base + size
    while len(lane):
        ok = nxt >= 0
        ok[ok] = ~placed[nxt[ok]]
        go = nxt[ok]
        rank = base[lane[ok]] + group[go]
        slot = free[rank]
        out[slot] = go
        free[rank] = slot + 1
        placed[go] = True
        nxt[ok] = before[go]
        rest = np.flatnonzero(~ok)
        turn[rest] += 1
        on = np.ones(len(lane), bool)
        on[rest] = turn[rest] < stop[rest]
        rest = rest[on[rest]]
        at = out[turn[rest]]
        nxt[rest] = np.where(at > base[lane[rest]], at - 1, -1)
        if len(rest) < len(lane) and not on.all():
            lane, turn, nxt, stop = lane[on], turn[on], nxt[on], stop[on]
    out = out.reshape(lanes, width)
    return np.where(out >= 0, out - base[:, None], -1).astype(np.int32)


#: Texts are hashed in so many bytes at a time, so that arrays stay in a core's own cache.
OWNER_BYTES = 1 << 15
_LIKE = np.random.default_rng(50).integers(1 << 62, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Even 64-bit hashes of all 24-byte grams."""
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()
    n = len(raw) - GRAM + 1
    h = word[:n] * _LIKE[0]
    h += word[8 : 8 + n] * _LIKE[1]
    h += word[16 : 16 + n] * _LIKE[2]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h & ~np.uint64(1)


def owners(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first window, number of windows, place of the gram in the first window) of the grams that own windows of rows [low, high); places count from the row's start.

    A window's owner is its gram of least hash, by the upper half, the leftmost of equal ones: the same wherever the window stands.
    """
    base, total = int(offsets[low]), int(offsets[high] - offsets[low])
    bounds = offsets[low : high + 1] - base
    none = np.empty(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    # Windows that start in the last 49 bytes of a row don't lie within it.
    past = (bounds[1:, None] - np.arange(1, SPAN)).ravel()
    past = np.sort(past[past >= 0])
    for begin in range(0, total - SPAN + 1, OWNER_BYTES):
        windows = min(OWNER_BYTES, total - SPAN + 1 - begin)
        h = _gram_hashes(data[base + begin : base + begin + windows + SPAN - 1])
        m, s = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * s <= GRAMS:
            m, s = np.minimum(m[:-s], m[s:]), 2 * s
        m = np.minimum(m[: -(GRAMS - s)], m[GRAMS - s :])
        owner = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner[past[np.searchsorted(past, begin) : np.searchsorted(past, begin + windows)] - begin] = -1
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        many = np.diff(np.append(first, windows))
        own = owner[first]
        real = own >= 0
        first, many, own = first[real], many[real], own[real]
        found.append((h[own], first + begin, many, own + begin))
    if not found:
        return none, none.astype(np.uint64), none, none, none
    h, first, many, own = (np.concatenate(x) for x in zip(*found, strict=True))
    # A run of windows that goes on over the edge of two stretches is one.
    if len(own):
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (first[1:] != first[:-1] + many[:-1]))))
        h, first, many, own = h[new], first[new], np.add.reduceat(many, new), own[new]
    row = np.searchsorted(bounds, first, "right") - 1
    return row + low, h, first - bounds[row], many, own - first


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's length in four bytes and its bytes compressed, as it is shuffled; nothing for a null or empty one."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t).to_bytes(4, "little") + codec.compress(t, asbytes=True) if t else b"" for t in texts], pa.binary())], ["doc_id", "text"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of packed texts and the row offsets into them."""
    codec, packed = pa.Codec("zstd"), column.to_pylist()
    offsets = np.zeros(len(packed) + 1, np.int64)
    offsets[1:] = np.cumsum([int.from_bytes(x[:4], "little") for x in packed])
    data = np.empty(offsets[-1], np.uint8)
    for x, a, b in zip(packed, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if x:
            data[a:b] = np.frombuffer(codec.decompress(memoryview(x)[4:], b - a), np.uint8)
    return data, offsets


def _grams(often_from: int):
    """Rows (key, gram, doc_id) with a null gram for each gram of a document, under its hash. Grams found ``often_from`` times in a slice, in
    two documents at least, are known to be shared: two rows whose gram is their key tell the least and the largest document, and their
    documents' rows are under odd keys that spread them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for low, high in slices(offsets):
                row, h, *_ = owners(data, offsets, low, high)
                order = np.argsort(h, kind="stable")
                row, h = row[order], h[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
                row, h = row[new], h[new]
                gram, doc = h.view(np.int64), ids[row]
                key, where = gram, np.zeros(len(h), bool)
                begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
                many = np.diff(np.append(begin, len(h)))
                often = np.flatnonzero(many >= often_from)
                if len(often):
                    least, most = np.minimum.reduceat(doc, begin)[often], np.maximum.reduceat(doc, begin)[often]
                    often, least, most = often[least < most], least[least < most], most[least < most]
                if len(often):
                    told = gram[begin[often]]
                    hit = np.zeros(len(begin), bool)
                    hit[often] = True
                    where = np.repeat(hit, many)
                    key = gram.copy()
                    key[where] = (mixed(mixed(doc[where].astype(np.uint64)) ^ h[where]) | np.uint64(1)).view(np.int64)
                    key, gram, where = np.concatenate((key, told, told)), np.concatenate((gram, told, told)), np.concatenate((where, np.ones(2 * len(often), bool)))
                    doc = np.concatenate((doc, least, most))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(gram, mask=~where), pa.array(doc)], ["key", "gram", "doc_id"])

    return run


def _flat(lists: pa.Array, low: int, high: int, *fields: str) -> tuple[np.ndarray, ...]:
    """Row number and fields of every entry of the rows [low, high) of a column of lists of structs."""
    part = lists.slice(low, high - low)
    many = pa.compute.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
    values = part.flatten()
    return np.repeat(np.arange(low, high), many), *(values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _listed(lists: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every entry of the rows [low, high) of a column of lists."""
    part = lists.slice(low, high - low)
    many = pa.compute.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(low, high), many), part.flatten().to_numpy(zero_copy_only=False)


def _matched(rows: int, row: np.ndarray, value: np.ndarray, known_row: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each (row, value) its place among the known pairs, the first of equal ones; -1 where there is none."""
    if not len(known) or not len(row):
        return np.full(len(row), -1, np.int64)
    distinct, code = np.unique(known, return_inverse=True)
    order = np.argsort(key := code * rows + known_row, kind="stable")
    at = np.minimum(np.searchsorted(distinct, value), len(distinct) - 1)
    want = at * rows + row
    place = np.minimum(np.searchsorted(key[order], want), len(order) - 1)
    return np.where((distinct[at] == value) & (key[order][place] == want), order[place], -1)


class _Shared:
    """The segments of rows [low, high) whose grams other documents share, with what is known of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int, shared: pa.Array, told: pa.Array, wanted: tuple[int, ...]) -> None:
        row, h, first, many, _ = owners(data, offsets, low, high)
        h = h.view(np.int64)
        (told_row, told), (known_row, known) = _listed(told, low, high), _listed(shared, low, high)
        # A row that repeats a told gram's document may know it otherwise too.
        known_row, known, state = np.concatenate((told_row, known_row)), np.concatenate((told, known & ~1)), np.concatenate((np.full(len(told), TOLD), known & 1))
        at = _matched(high + 1, row, h, known_row, known)
        state = state[at] if len(known) else np.zeros(len(at), np.int8)
        keep = np.flatnonzero((at >= 0) & np.isin(state, wanted))
        self.row, self.h, self.first, self.many, self.state = row[keep], h[keep], first[keep], many[keep], state[keep]
        self.begin = offsets[self.row] + self.first - offsets[low]
        raw = data[offsets[low] : offsets[high]].tobytes() if len(keep) else b""
        texts = (raw[a:b] for a, b in zip(self.begin.tolist(), (self.begin + self.many + SPAN - 1).tolist(), strict=True))
        self.g = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(keep)).view(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of shared grams, each distinct one of a batch once: their least document, and where they stand in it."""
    for batch in batches:
        data, offsets = _unpacked(batch.column(1))
        ids = batch.column(0).to_numpy()
        parts = []
        for low, high in slices(offsets):
            s = _Shared(data, offsets, low, high, batch.column(2), batch.column(3), (LATER, FIRST, TOLD))
            parts.append((s.h, s.g, ids[s.row], s.first * (GRAMS + 1) + s.many, s.state == TOLD))
        if not parts:
            continue
        h, g, doc, place, told = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, g, h))
        h, g = h[order], g[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))) if len(h) else np.empty(0, np.int64)
        told = np.maximum.reduceat(told[order], new) if len(new) else np.empty(0, bool)
        one = order[new]
        yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(g[new]), pa.array(doc[one]), pa.array(place[one]), pa.array(told)], ["h", "g", "doc_id", "place", "told"])


def _texts_of_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a document's wanted segments, from where they stand; of rows that repeat an id, from the one that has them there."""
    for batch in batches:
        data, offsets = _unpacked(batch.column(1))
        for low, high in slices(offsets):
            row, h, g, place, told, n = _flat(batch.column(2), low, high, "h", "g", "place", "told", "n")
            begin = offsets[row] + place // (GRAMS + 1)
            stop = begin + place % (GRAMS + 1) + SPAN - 1
            inside = np.flatnonzero(stop <= offsets[row + 1])
            base = offsets[low]
            raw = data[base : offsets[high]].tobytes()
            texts = [raw[a:b] for a, b in zip((begin[inside] - base).tolist(), (stop[inside] - base).tolist(), strict=True)]
            found = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64) == g[inside]
            at = inside[found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at]), pa.array(g[at]), batch.column(0).take(pa.array(row[at])), pa.array([x for x, f in zip(texts, found.tolist(), strict=True) if f], pa.binary()), pa.array(told[at].astype(bool)), pa.array(n[at])],
                ["h", "g", "doc_id", "segment", "told", "n"],
            )


def earliest_windows(groups: list[tuple[list[str], np.ndarray]], span: int) -> list[np.ndarray | None]:
    """For each group of distinct texts of small symbols and the first document of each: a row per text, with the first document that has
    the window of ``span`` symbols at each place; None for a text that is alone. Suffix arrays find the equal windows."""
    out: list[np.ndarray | None] = []
    for texts, docs in groups:
        out.append(np.repeat(docs[:, None], max(map(len, texts)) - span + 1, 1) if len(texts) > 1 else None)
    several = [i for i, (texts, _) in enumerate(groups) if len(texts) > 1]
    length = {i: sum(map(len, groups[i][0])) + len(groups[i][0]) for i in several}
    several.sort(key=lambda i: length[i])
    low = 0
    while low < len(several):
        high = low + 1
        while high < len(several) and (high + 1 - low) * length[several[high]] <= CELLS:
            high += 1
        part = several[low:high]
        low = high
        size = np.array([length[i] for i in part])
        symbols = np.zeros((len(part), size.max()), np.int16)
        inside = np.arange(symbols.shape[1]) < size[:, None]
        symbols[inside] = (np.frombuffer("".join(END.join(groups[i][0]) + END for i in part).encode("utf-16-le"), "<u2") + np.uint16(1)).astype(np.int16)
        home = [(i, k, len(t) - span + 1) for i in part for k, t in enumerate(groups[i][0])]
        many = np.array([w for *_, w in home])
        lane = np.repeat(np.arange(len(part)), [len(groups[i][0]) for i in part])
        taken = np.cumsum(many + span) - many - span  # symbols of the texts before, with their ends
        begin = taken - (np.cumsum(size) - size)[lane]
        n = int(many.sum())
        valid = np.full(symbols.shape, -1, np.int64)  # number of the window that starts here
        valid[np.repeat(lane, many), np.repeat(begin - np.cumsum(many) + many, many) + np.arange(n)] = np.arange(n)
        order = suffix_arrays(symbols, size)
        row, rank = np.nonzero(order >= 0)
        place = order[row, rank]
        window = valid[row, place]
        row, place, window = row[window >= 0], place[window >= 0], window[window >= 0]
        views = np.lib.stride_tricks.sliding_window_view(symbols, span, axis=1)
        same = row[1:] == row[:-1]
        same[same] = (views[row[1:][same], place[1:][same]] == views[row[:-1][same], place[:-1][same]]).all(1)
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        doc = np.repeat(np.concatenate([groups[i][1][k : k + 1] for i, k, _ in home]), [w for *_, w in home])
        least = np.minimum.reduceat(doc[window], begin)
        got = np.empty(n, np.int64)
        got[window] = np.repeat(least, np.diff(np.append(begin, len(window))))
        at = 0
        for i, k, w in home:
            out[i][k, :w] = got[at : at + w]
            at += w
    return out


def _whole_groups(keys: list[str], found):
    """Runs ``found`` over tables of whole groups of rows, which come sorted by ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def groups(t: pa.Table) -> np.ndarray:
            return np.flatnonzero(np.any([(k := t[c].to_numpy())[1:] != k[:-1] for c in keys], axis=0)) + 1

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < ROWS:
                continue
            t = pa.concat_tables(held).combine_chunks()
            new = groups(t)
            held = [t]
            if len(new):
                yield found(t.slice(0, int(new[-1])), np.concatenate(([0], new[:-1])))
                held = [t.slice(int(new[-1]))]
        t = pa.concat_tables(held).combine_chunks() if held else None
        if t is not None and t.num_rows:
            yield found(t, np.concatenate(([0], groups(t))))

    return run


def _bits(first: list[np.ndarray | None], docs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The windows of each text that its own document is the first to have, as a bit mask."""
    out, at = (1 << windows) - 1, 0  # a text that is alone keeps all
    for m in first:
        if m is not None:
            part = slice(at, at + len(m))
            own = (m == docs[part, None]) & (np.arange(m.shape[1]) < windows[part, None])
            out[part] = (own.astype(np.int64) << np.arange(m.shape[1])).sum(1)
        at += 1 if m is None else len(m)
    return out


def _gram_places(column: pa.Array) -> np.ndarray:
    """Where the gram that owns a segment's windows stands in it."""
    data, offsets = text_bytes(column)
    row, *_, place = owners(data, offsets, 0, len(column))
    return place[np.searchsorted(row, np.arange(len(column)))]


def _kept_of_segments(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
    """Of distinct segments, what their first documents keep. A gram's first document keeps all that it has around it, which it knows by itself unless the gram is a told one.

    The segments around a gram stand one after another in one text; as every window holds the gram, one symbol stands for it.
    """
    docs, told, column = t["doc_id"].to_numpy(), t["told"].to_numpy(), t["segment"].combine_chunks()
    raw = column.to_pylist()
    texts = [x[:k].decode("latin-1") + SHARED + x[k + GRAM :].decode("latin-1") for x, k in zip(raw, _gram_places(column).tolist(), strict=True)]
    stops = [*begin[1:].tolist(), len(texts)]
    first = earliest_windows([(texts[a:b], docs[a:b]) for a, b in zip(begin.tolist(), stops, strict=True)], SPAN - GRAM + 1)
    bits = _bits(first, docs, np.array([len(x) - SPAN + 1 for x in raw]))
    least = np.repeat(np.minimum.reduceat(docs, begin), np.diff(np.append(begin, len(docs))))
    some = np.flatnonzero((bits > 0) & ((docs != least) | told))
    return pa.RecordBatch.from_arrays([pa.array(docs[some]), *(pa.array(t[c].to_numpy()[some]) for c in ("h", "g")), pa.array(bits[some].astype(np.int32))], ["doc_id", "h", "g", "kept"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in parts of ``PART`` neighbouring windows, by their places relative to the gram. Equal windows have equal places and hold the
    bytes that all windows of these places share, so they meet by the place class c and the hash s of these."""
    shared = SPAN - PART + 1
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for h, g, doc, text, gram in zip(*(batch.column(k).to_pylist() for k in range(4)), _gram_places(batch.column(3)).tolist(), strict=True):
            last = len(text) - SPAN
            for c in range((gram - last) // PART, gram // PART + 1):
                high = gram - PART * c
                low = max(0, high - PART + 1)
                part = text[low : min(last, high) + SPAN]
                row = (h, c, xxhash.xxh3_64_intdigest(text[high : high + shared]) - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), g, doc, low, high - low, part)
                for o, v in zip(out, row, strict=True):
                    o.append(v)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, types, strict=True)], ["h", "c", "s", "p", "g", "doc_id", "low", "before", "part"])


def _kept_of_parts(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
    """Of distinct parts, the windows that their first document keeps; in the suffix array one symbol stands for the bytes that all share."""
    shared, docs = SPAN - PART + 1, t["doc_id"].to_numpy()
    parts, before = t["part"].to_pylist(), t["before"].to_pylist()
    texts = [x[:k].decode("latin-1") + SHARED + x[k + shared :].decode("latin-1") for x, k in zip(parts, before, strict=True)]
    stops = [*begin[1:].tolist(), len(texts)]
    first = earliest_windows([(texts[a:b], docs[a:b]) for a, b in zip(begin.tolist(), stops, strict=True)], PART)
    bits = _bits(first, docs, np.array([len(x) - SPAN + 1 for x in parts]))
    some = np.flatnonzero(bits)
    return pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[some]) for c in ("h", "c", "s", "p", "doc_id")] + [pa.array(bits[some].astype(np.int32))], ["h", "c", "s", "p", "doc_id", "bits"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts what the windows cover that an earlier document has: all windows of shared grams, but for those kept."""
    span = pa.struct([("low", pa.int64()), ("high", pa.int64())])
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for low, high in slices(offsets):
            s = _Shared(data, offsets, low, high, batch.column(2), batch.column(3), (LATER, TOLD))
            known_row, known_h, known_g, bits = _flat(batch.column(4), low, high, "h", "g", "kept")
            h_codes = np.unique(known_h)
            of = lambda h: np.minimum(np.searchsorted(h_codes, h), len(h_codes) - 1) if len(h_codes) else np.zeros(len(h), np.int64)  # noqa: B023, E731
            code = of(s.h)
            there = h_codes[code] == s.h if len(h_codes) else np.zeros(len(s.h), bool)
            # A pair of row and gram as one number, met by the segment's digest.
            rows = (high + 1) * max(len(h_codes), 1)
            at = _matched(rows, code * (high + 1) + s.row, s.g, of(known_h) * (high + 1) + known_row, known_g)
            kept = np.where(there & (at >= 0), bits[at] if len(bits) else 0, 0).astype(np.int64)
            size = int(offsets[high] - offsets[low])
            edge = np.zeros(size + 1, np.int64)
            whole = kept == 0
            np.add.at(edge, s.begin[whole], 1)
            np.add.at(edge, s.begin[whole] + s.many[whole] + SPAN - 1, -1)
            for w in range(GRAMS):
                lost = s.begin[~whole & (w < s.many) & (kept >> w & 1 == 0)] + w
                np.add.at(edge, lost, 1)
                np.add.at(edge, lost + SPAN, -1)
            gone = np.cumsum(edge[:-1]) > 0
            bounds = offsets[low : high + 1] - offsets[low]
            ends = np.zeros(size + 1, bool)
            ends[bounds] = True
            padded = np.concatenate(([False], gone, [False]))
            begin = np.flatnonzero(padded[1:] & (~padded[:-1] | ends))
            stop = np.flatnonzero(padded[:-1] & (~padded[1:] | ends))
            start = np.searchsorted(begin, bounds)
            home = np.repeat(bounds[:-1], np.diff(start))
            left = np.concatenate(([0], np.cumsum(~gone)))[bounds]
            raw = data[offsets[low] : offsets[high]][~gone]
            texts = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            spans = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - home), pa.array(stop - home)], fields=list(span)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(bounds)), pa.array(np.diff(bounds) - np.diff(left)), spans, texts], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed byte runs) and kept (the other bytes) of each row.

    A byte goes if a 50-byte string that covers it also starts in a document of smaller doc_id, judged on the input; matches stay within
    documents. Null text counts as empty. Rows with a null doc_id neither lose nor cost bytes; rows that repeat a doc_id are one document:
    their texts don't count against each other, and each loses what its own text repeats. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    known = rows.where("doc_id IS NOT NULL")
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    # Grams that own windows in two documents at least: a row of a few numbers for every dozen bytes is all that is shuffled here.
    by = Window.partitionBy("key")
    grams = known.mapInArrow(_grams(OFTEN), "key long, gram long, doc_id long").repartition("key")
    grams = grams.select("key", "gram", "doc_id", F.min("doc_id").over(by).alias("least"), F.max("doc_id").over(by).alias("most")).where("key <> gram OR (gram IS NULL AND least < most)")
    # A document's grams are bounded by its own text. The lowest bit of a gram is free: it is set where the document is the first.
    code = F.when(F.col("gram").isNull(), F.col("key").bitwiseOR(F.when(F.col("doc_id") == F.col("least"), FIRST).otherwise(LATER).cast("long")))
    shared = scratch.write(grams.groupBy("doc_id").agg(F.collect_list(code).alias("shared"), F.collect_list("gram").alias("told")), "shared-grams")

    def with_text(lists: DataFrame) -> DataFrame:
        return known.mapInArrow(_packed, "doc_id long, text binary").join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "text", *lists.columns[1:])

    # Where so many grams are shared that segments would take more than the texts, they are shuffled some grams at a time.
    n_shared, n_bytes = shared.agg(F.sum(F.size("shared") + F.size("told"))).first()[0] or 0, known.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    batches, found = max(1, -(-n_shared * SEGMENT_BYTES // n_bytes)), []
    for batch in range(batches):
        some = lambda c: F.filter(c, lambda x: F.pmod(F.shiftright(x, 1), F.lit(batches)) == batch).alias(c)  # noqa: B023, E731
        lists = shared if batches == 1 else shared.select("doc_id", some("shared"), some("told")).where("size(shared) + size(told) > 0")
        # They are distinct already where they come from, so they are put together after the shuffle alone.
        segments = with_text(lists).mapInArrow(_segments, "h long, g long, doc_id long, place long, told boolean").repartition("h", "g")
        found.append(scratch.write(segments.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.min_by("place", "doc_id").alias("place"), F.max("told").alias("told")), "segments"))
    segments = reduce(DataFrame.unionByName, found)
    counts = scratch.write(segments.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    # A segment that is the only one around its gram needs no bytes: its first document keeps it, and all others lose it.
    alone = segments.where("told").join(counts, "h", "left_anti").select(F.col("first").alias("doc_id"), "h", "g", F.expr(f"cast(shiftleft(1L, cast(place % {GRAMS + 1} as int)) - 1 as int)").alias("kept"))
    wanted = segments.join(counts, "h").groupBy(F.col("first").alias("doc_id")).agg(F.collect_list(F.struct("h", "g", "place", "told", "n")).alias("wanted"))
    several = with_text(wanted).mapInArrow(_texts_of_segments, "h long, g long, doc_id long, segment binary, told boolean, n long")
    several = scratch.write(several, "segment-texts")
    few = several.where(F.col("n") <= SPLIT).repartition("h").sortWithinPartitions("h").select("h", "g", "doc_id", "segment", "told")
    few = few.mapInArrow(_whole_groups(["h"], _kept_of_segments), "doc_id long, h long, g long, kept int")
    kept = scratch.write(alone.unionByName(few), "kept-of-segments")
    scratch.drop(*found, counts)
    # Around a gram with many distinct segments, parts of these meet by more of their bytes.
    parts = several.where(F.col("n") > SPLIT).select("h", "g", "doc_id", "segment").mapInArrow(_parts, "h long, c int, s long, p long, g long, doc_id long, low int, before int, part binary")
    parts = scratch.write(parts, "parts")
    scratch.drop(several)
    place = ["h", "c", "s"]
    least = parts.groupBy(*place, "p").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("part", "before")).alias("x")).select(*place, "p", "doc_id", "x.*")
    least = least.repartition(*place).sortWithinPartitions(*place).mapInArrow(_whole_groups(place, _kept_of_parts), "h long, c int, s long, p long, doc_id long, bits int")
    least = scratch.write(least, "kept-of-parts")
    of_parts = parts.select(*place, "p", "g", "doc_id", "low").join(least, [*place, "p", "doc_id"]).groupBy("doc_id", "h", "g").agg(F.bit_or(F.expr("shiftleft(bits, low)")).alias("kept"))
    known_rows = scratch.write(kept.unionByName(of_parts).groupBy("doc_id").agg(F.collect_list(F.struct("h", "g", "kept")).alias("kept")), "kept")
    scratch.drop(kept, parts, least)

    # Both lists of a document come before its text does, so that texts are shuffled once.
    both = shared.join(known_rows, "doc_id", "left")
    return rows.join(both.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "shared", "told", "kept").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<low:bigint,high:bigint>>, kept binary")
