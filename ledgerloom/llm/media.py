"""Media columns: AVI motion-JPEG written, indexed, decoded and cut into shots."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import slices, text_bytes

#: A frame of text payload is 24 x 24 grey pixels: nine blocks of 64 coefficients, one byte in each.
SIDE, UNIT, FPS = 24, 576, 25
BATCH_BYTES = 3 << 19
HISTOGRAM_BINS, WINDOW, SPREADS, LEAST_CHANGE = 16, 8, 2.0, 0.3
#: Code lengths by symbol. DC: categories 0-8. AC: no zero run, categories by how often text needs them; 0 ends a block.
DC_LENGTHS = {k: 4 for k in range(9)}
AC_LENGTHS = {5: 1, 4: 2, 7: 3, 6: 4, 3: 5, 2: 6, 1: 7, 8: 8, 0: 9}


def canonical(lengths: dict[int, int]) -> tuple[bytes, list[int], dict[int, tuple[int, int]]]:
    """JPEG's form of a Huffman table: the number of codes of each length, the symbols by length, and each symbol's (code, length)."""
    symbols = sorted(lengths, key=lambda s: lengths[s])
    code, last, codes = 0, 0, {}
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), symbols, codes


def zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in coding order: along antidiagonals, turning at the edges."""
    return np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


@cache
def _inverse_dct() -> np.ndarray:
    """Maps 64 coefficients in coding order to 64 pixels."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[zigzag()].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def _frame_head() -> bytes:
    dc, ac = canonical(DC_LENGTHS), canonical(AC_LENGTHS)
    tables = b"\x00" + dc[0] + bytes(dc[1]) + b"\x10" + ac[0] + bytes(ac[1])
    return b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xC4, tables) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


@cache
def _coded(low: int, high: int, lengths: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each value from ``low`` to ``high``: its code and own bits, as the top bits of 16, and their number."""
    values = np.arange(low, high + 1)
    category = np.array([int(v).bit_length() for v in np.abs(values)])
    codes = canonical(dict(lengths))[2]
    code, length = (np.array([codes.get(int(k), (0, 0))[i] for k in category]) for i in (0, 1))
    bits, length = code << category | np.where(values >= 0, values, values + (1 << category) - 1), length + category
    return (bits << (16 - length)).astype(np.uint16), length.astype(np.uint8)


def encode_frames(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data of frames of 576 bytes each, and the offsets of the frames in it. A byte is a quantised coefficient: DC is b - 128; AC skips 0, so that no zero runs occur."""
    b = payload.reshape(-1, 9, 64)
    dc_bits, dc_length = _coded(-255, 255, tuple(DC_LENGTHS.items()))
    ac_bits, ac_length = (np.delete(t, 128) for t in _coded(-128, 128, tuple(AC_LENGTHS.items())))
    bits, length = np.empty((len(b), 577), np.uint16), np.empty((len(b), 577), np.uint8)
    inner_b, inner_n = bits[:, :576].reshape(-1, 9, 64), length[:, :576].reshape(-1, 9, 64)
    inner_b[:], inner_n[:] = ac_bits[b], ac_length[b]
    dc = np.diff(b[:, :, 0].astype(np.int64) - 128, axis=1, prepend=0) + 255
    inner_b[:, :, 0], inner_n[:, :, 0] = dc_bits[dc], dc_length[dc]
    bits[:, :576], length[:, :576] = inner_b.reshape(-1, 576), inner_n.reshape(-1, 576)
    size = length[:, :576].sum(1, dtype=np.int64)
    length[:, 576] = -size % 8  # frames end on whole bytes, filled with ones
    bits[:, 576] = 0xFF << (16 - length[:, 576].astype(np.int64)) & 0xFFFF
    # Each code starts in one 32-bit word and may reach into the next; codes don't overlap, so sums put the words together.
    length = length.ravel().astype(np.int64)
    end = np.cumsum(length)
    start = end - length
    placed = bits.ravel().astype(np.uint64) << (48 - (start & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(start >> 5, prepend=-1))
    sums = np.add.reduceat(placed, first)
    words = np.zeros(len(first) + 1, np.uint64)
    words[:-1] = sums >> np.uint64(32)
    words[1:] += sums & np.uint64(0xFFFFFFFF)
    packed = words.astype(">u4").view(np.uint8)[: end[-1] // 8]
    ends = np.cumsum((size + 7) // 8)
    full = np.flatnonzero(packed == 255)
    ends += np.searchsorted(full, ends, "left")
    return np.insert(packed, full + 1, 0), np.concatenate(([0], ends))


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of one motion-JPEG stream with an index."""
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Seconds per frame and the video frames, by the index where there is one, else by walking the movie list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    seconds, movie, index, stack = 1 / FPS, None, None, [(12, len(data))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movie = (at + 8, min(at + 8 + size, end))
            elif tag == b"LIST":
                stack.append((at + 12, min(at + 8 + size, end)))
            elif tag == b"avih":
                seconds = int.from_bytes(data[at + 8 : at + 12], "little") / 1e6
            elif tag == b"idx1":
                index = data[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
    if movie is None:
        raise ValueError("no movie list")
    start, end = movie
    if index:
        entries = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) // 16 * 16, 16)]
        base = start if entries and data[start + entries[0][2] : start + entries[0][2] + 4] == entries[0][0] else 0
        return seconds, [data[base + o + 8 : base + o + 8 + n] for tag, _, o, n in entries if tag[2:] in (b"dc", b"db")]
    frames, at = [], start + 4
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return seconds, frames


@dataclass
class Head:
    """What a baseline frame's segments say: size, components (sampling, quantiser, tables) and code tables as 16-bit lookups."""

    width: int
    height: int
    parts: list[tuple[int, int, np.ndarray, tuple, tuple]]
    size: int


def _direct(symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the next 16 bits say where they hold a code with its value and no zero run: value << 16 | bits used; else 0."""
    size, top = symbol & 15, np.arange(65536)
    value = (top >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1)
    value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
    return np.where((size > 0) & (symbol < 16) & (length + size <= 16), value << 16 | length + size, 0).astype(np.int32)


def parse_head(frame: bytes) -> Head:
    quant, codes, shape, at = {}, {}, None, 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("not a JPEG marker")
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisers are not baseline")
                quant[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.float32), body[65:]
        elif marker == 0xC0:
            height, width, n = struct.unpack(">HHB", body[1:6])
            shape = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif marker in (0xC1, 0xC2, 0xC3, 0xDD) and (marker != 0xDD or any(body)):
            raise ValueError("only baseline frames without restart intervals are read")
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                symbol, length = np.zeros(65536, np.int64), np.full(65536, 17)
                code, k = 0, 17
                for n in range(1, 17):
                    for _ in range(body[n]):
                        symbol[code << (16 - n) : (code + 1) << (16 - n)], length[code << (16 - n) : (code + 1) << (16 - n)] = body[k], n
                        code, k = code + 1, k + 1
                    code <<= 1
                codes[body[0]], body = (symbol, length, _direct(symbol, length)), body[17 + many :]
        elif marker == 0xDA:
            width, height, comps = shape
            order = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            return Head(width, height, [(h, v, quant[q], codes[order[c] >> 4], codes[16 + (order[c] & 15)]) for c, h, v, q in comps], at + 2 + size)
        at += 2 + size
    raise ValueError("no scan")


def decode_scans(scans: list[bytes], head: Head) -> list[np.ndarray]:
    """Quantised coefficients (frames, blocks, 64) of each component, all frames side by side, one symbol a step."""
    raw = np.frombuffer(b"".join(scans) + b"\0" * 16, np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in scans])))
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
    starts -= np.concatenate(([0], np.cumsum(stuffed)))[starts]
    raw = raw[~stuffed]
    raw = np.concatenate((raw, np.zeros(80, np.uint8)))
    quarter = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 4)).view(">u4").ravel().astype(np.uint32)
    word = np.lib.stride_tricks.sliding_window_view(raw, 8)
    word = np.ascontiguousarray(word).view(">u8").ravel().astype(np.uint64)
    lanes, pos, stop = len(scans), starts[:-1] * 8, starts[1:] * 8
    many = [max(h for h, *_ in head.parts), max(v for _, v, *_ in head.parts)]
    across, down = -(-head.width // (8 * many[0])), -(-head.height // (8 * many[1]))
    if len(head.parts) == 1:
        across, down, shapes = -(-head.width // 8), -(-head.height // 8), [1]
    else:
        shapes = [h * v for h, v, *_ in head.parts]
    out = [np.zeros((lanes, across * down * n, 64), np.int16) for n in shapes]
    level = [np.zeros(lanes, np.int64) for _ in shapes]

    def step(which: np.ndarray | slice, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        p = pos[which]
        bits = word[np.minimum(p >> 3, len(word) - 1)] << (p & 7).astype(np.uint64)
        top = (bits >> np.uint64(48)).astype(np.int64)
        symbol, length = table[0][top], table[1][top]
        if length.max(initial=0) > 16 or (p > stop[which]).any():
            raise ValueError("broken scan")
        size = symbol & 15
        value = ((bits << length.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) >> (16 - size)
        pos[which] = p + length + size
        return symbol, np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)

    everyone = np.arange(lanes)
    for mcu in range(across * down):
        for c, n in enumerate(shapes):
            _, _, _, dc, ac = head.parts[c]
            for block in range(mcu * n, mcu * n + n):
                _, value = step(slice(None), dc)
                level[c] += value
                out[c][:, block, 0] = level[c]
                column, done = np.zeros((64, lanes), np.int16), 1
                while done < 64:  # all frames at the same coefficient, as long as none has a zero run or ends its block
                    got = ac[2][(quarter[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(16)]
                    if not got.all():
                        break
                    column[done] = got >> 16
                    pos += got & 31
                    done += 1
                    if not done & 15:
                        np.minimum(pos, 8 * len(quarter) - 512, out=pos)
                out[c][:, block, 1:done] = column[1:done].T
                live, k = (everyone, np.full(lanes, done)) if done < 64 else (everyone[:0], everyone[:0])
                while len(live):
                    symbol, value = step(live if len(live) < lanes else slice(None), ac)
                    k = k + (symbol >> 4)
                    real = (symbol & 15) > 0
                    if real.all() and k.max() < 64:
                        out[c][live, block, k] = value
                        k = k + 1
                        if (k < 64).all():
                            continue
                        live, k = live[k < 64], k[k < 64]
                        continue
                    if (k[real] > 63).any():
                        raise ValueError("broken scan")
                    out[c][live[real], block, k[real]] = value[real]
                    on = (real | (symbol == 0xF0)) & (k + 1 < 64)
                    live, k = live[on], k[on] + 1
    if (pos > stop).any():
        raise ValueError("broken scan")
    return out


def histograms(luma: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Share of pixels by brightness of frames given as (frames, blocks, 64) coefficients."""
    frames = len(luma)
    pixels = (luma.reshape(-1, 64) * quant) @ _inverse_dct()
    which = (np.clip(pixels + 128, 0, 255) * np.float32(HISTOGRAM_BINS / 256)).astype(np.int32).reshape(frames, -1)
    flat = np.bincount((which + HISTOGRAM_BINS * np.arange(frames, dtype=np.int32)[:, None]).ravel(), minlength=frames * HISTOGRAM_BINS)
    return flat.reshape(frames, HISTOGRAM_BINS) / max(1, which.shape[1])


def cuts(shares: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which frames begin a shot. ``first``: offsets of the videos' frames. A cut changes more of the histogram than ``LEAST_CHANGE`` and than mean plus ``SPREADS`` deviations of up to ``WINDOW`` changes before it."""
    n = len(shares)
    begin = np.zeros(n, bool)
    begin[first[:-1][np.diff(first) > 0]] = True
    change = np.zeros(n)
    change[1:] = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    change[begin] = 0
    own = np.repeat(first[:-1], np.diff(first))
    at = np.arange(n)
    low = np.maximum(own + 1, at - WINDOW)
    many = np.maximum(at - low, 1)
    total, square = (np.concatenate(([0], np.cumsum(v))) for v in (change, change**2))
    mean = (total[at] - total[np.minimum(low, at)]) / many
    deviation = np.sqrt(np.maximum((square[at] - square[np.minimum(low, at)]) / many - mean**2, 0))
    return begin | ((change > LEAST_CHANGE) & (change > mean + SPREADS * deviation))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head = _frame_head()
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for low, high in slices(offsets, BATCH_BYTES):
            size = np.diff(offsets[low : high + 1])
            frames = np.maximum(1, -(-size // UNIT))
            first = np.concatenate(([0], np.cumsum(frames)))
            payload = np.full(first[-1] * UNIT, 255, np.uint8)
            to = np.repeat(first[:-1] * UNIT - (offsets[low:high] - offsets[low]), size) + np.arange(offsets[high] - offsets[low])
            payload[to] = data[offsets[low] : offsets[high]]
            coded, ends = encode_frames(payload)
            coded = coded.tobytes()
            whole = [head + coded[a:b] + b"\xff\xd9" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            media = [write_avi(whole[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(size), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


_CLIP = pa.struct([("shot", pa.int32()), ("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heads: dict[bytes, Head] = {}

    def head_of(frame: bytes) -> bytes:
        for prefix in heads:
            if frame.startswith(prefix):
                return prefix
        head = parse_head(frame)
        heads[frame[: head.size]] = head
        return frame[: head.size]

    def decoded(videos: list) -> tuple[list[bytes], list[list[dict]]]:
        """Payload and clips of videos whose frames share one head."""
        first = np.concatenate(([0], np.cumsum([len(v[1]) for v in videos])))
        frames = [f for _, fs in videos for f in fs]
        if not frames:
            return [b""] * len(videos), [[] for _ in videos]
        head = heads[head_of(frames[0])]
        luma = decode_scans([f[head.size :] for f in frames], head)[0]
        cut = np.flatnonzero(cuts(histograms(luma, head.parts[0][2]), first))
        stored = luma + 128 - (luma > 0)
        stored[:, :, 0] = luma[:, :, 0] + 128
        stored = stored.astype(np.uint8).reshape(len(frames), -1)
        at = np.searchsorted(cut, first)
        clips = []
        for i, (seconds, fs) in enumerate(videos):
            begins = (cut[at[i] : at[i + 1]] - first[i]).tolist()
            clips.append([{"shot": k, "first_frame": a, "n_frames": b - a, "start_s": a * seconds, "end_s": b * seconds} for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(fs)], strict=True))])
        return [stored[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], clips

    for batch in batches:
        at = batch.schema.get_field_index("media")
        data, offsets = text_bytes(batch.column(at).cast(pa.binary()).fill_null(b""))
        for low, high in slices(offsets, BATCH_BYTES):
            videos: list = []
            for i in range(low, high):
                try:
                    seconds, frames = read_avi(data[offsets[i] : offsets[i + 1]].tobytes())
                    own = {head_of(f) for f in frames}
                    videos.append((seconds, frames) if len(own) < 2 else None)
                except (ValueError, KeyError, IndexError, struct.error):
                    videos.append(None)
            payload: list = [None] * len(videos)
            clips: list = [None] * len(videos)
            groups: dict[bytes, list[int]] = {}
            for i, v in enumerate(videos):
                if v is not None:
                    groups.setdefault(head_of(v[1][0]) if v[1] else b"", []).append(i)
            for members in groups.values():
                try:
                    got = decoded([videos[i] for i in members])
                except (ValueError, IndexError):  # one broken scan: decode each video on its own
                    got = ([], [])
                    for i in members:
                        try:
                            p, c = decoded([videos[i]])
                        except (ValueError, IndexError):
                            p, c = [None], [None]
                        got[0].extend(p)
                        got[1].extend(c)
                for i, p, c in zip(members, *got, strict=True):
                    payload[i], clips[i] = p, c
            yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pa.array(payload, pa.binary()), pa.array(clips, pa.list_(_CLIP))], [*batch.schema.names, "payload", "clips"])


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled with bytes 255 to a positive multiple of 576, as frames of an AVI motion-JPEG file.

    Null texts count as empty (one frame of filling); other columns are ignored, and rows are independent of each other.
    """
    return docs.select("doc_id", "text").mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def read_media(files: DataFrame) -> DataFrame:
    """``files`` with payload (the coefficients' bytes of the first component) and clips of the AVI file in ``media``.

    The RIFF index finds the frames; baseline JPEG frames of one head are decoded side by side; a shot begins where the brightness histogram
    changes by more than an adaptive threshold. clips: (shot, first_frame, n_frames, start_s, end_s). Null, empty or broken files, and
    progressive, restart-marked or mixed frames, get null payload and clips. Own columns replace input columns of these names.
    """
    files = files.drop("payload", "clips")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(_read, f"{kept}, payload binary, clips array<struct<shot:int,first_frame:bigint,n_frames:bigint,start_s:double,end_s:double>>")


def clip_rows(files: DataFrame) -> DataFrame:
    """One row per clip of the AVI files in ``media``: doc_id, shot, first_frame, n_frames, start_s, end_s. Files that can't be read have none."""
    return read_media(files).select("doc_id", F.inline("clips"))
