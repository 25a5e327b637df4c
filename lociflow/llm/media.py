"""FLAC media columns: encode, verify, decode, and cut into seekable PCM blocks.

Streams are mono, fixed block size. The coder takes 8-bit samples; the decoder reads
constant, verbatim, fixed (orders 0-4) and linear-predictor subframes with partitioned
Rice residuals. All frames of a batch are coded side by side with numpy, sample by sample
over frames, so no Python loop runs over single samples.

Defined results: a null text is the empty text; an empty text gives one block of padding.
Corrupt streams raise ``ValueError`` naming what failed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import slices

#: Fixed values of the format.
BLOCK = 192
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608}
SAMPLE_RATE = 8000
FIXED_COEFFICIENTS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))

#: Working sizes: frames coded side by side, bytes of text taken into one slice of a batch.
FRAMES_AT_ONCE = 4096
SLICE_BYTES = 4 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    reg = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        reg = np.where(reg >> (bits - 1) & 1, reg << 1 ^ poly, reg << 1) & ((1 << bits) - 1)
    return reg.astype(np.uint16)


#: Zero bits before the first set one of a 16-bit number.
LEADING_ZEROS = (16 - np.ceil(np.log2(np.arange(1, (1 << 16) + 1)))).astype(np.uint32)
LEADING_ZEROS[0] = 32  # longer than the table sees
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc_rows(rows: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-8 or CRC-16 of each row's first ``length`` bytes."""
    crc = np.zeros(len(rows), np.uint16)
    shortest = int(lengths.min()) if len(rows) else 0
    columns = np.ascontiguousarray(rows.T)
    for i in range(int(lengths.max()) if len(rows) else 0):
        if table is CRC8:
            new = table[crc ^ columns[i]]
        else:
            new = (crc << 8) ^ table[(crc >> 8) ^ columns[i]]
        crc = new if i < shortest else np.where(i < lengths, new, crc)
    return crc


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat indices of all spans, one after another."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _coded_number(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the header's variable-length form: rows of 7 bytes, and lengths."""
    n = numbers.astype(np.int64)
    length = np.ones(len(n), np.int64)
    for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31):
        length += n >= limit
    out = np.zeros((len(n), 7), np.uint8)
    for size in np.unique(length):
        at = length == size
        v = n[at]
        if size == 1:
            out[at, 0] = v
            continue
        out[at, 0] = (0xFF << (8 - size) & 0xFF) | v >> 6 * (size - 1)
        for j in range(1, size):
            out[at, j] = 0x80 | v >> 6 * (size - 1 - j) & 0x3F
    return out, length


def _predictors(x: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
    """Candidates as (order, quantised coefficients or None for fixed, residual)."""
    yield 0, None, x
    d = np.diff(x, axis=1)
    yield 1, None, d
    yield 2, None, np.diff(d, axis=1)
    # Second-order linear prediction, solved in closed form for all frames.
    f = x.astype(np.float32)
    r0, r1, r2 = ((f[:, : f.shape[1] - lag] * f[:, lag:]).sum(1, dtype=np.float64) for lag in (0, 1, 2))
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 0, det, 1)
    a = np.stack([(r0 * r1 - r1 * r2) / safe, (r0 * r2 - r1 * r1) / safe], 1)
    q = np.clip(np.rint(np.where(det[:, None] > 0, a, 0) * 128), -512, 511).astype(np.int32)
    yield 2, q, x[:, 2:] - ((q[:, :1] * x[:, 1:-1] + q[:, 1:] * x[:, :-2]) >> 7)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code rows of ``BLOCK`` signed 8-bit samples; returns all bytes and each frame's length."""
    x = samples.astype(np.int32)
    n = len(x)
    best = np.full(n, 8 * BLOCK, np.int64)  # verbatim
    choice = np.full(n, -1)
    params, kept = np.zeros(n, np.int64), []
    for i, (order, q, residual) in enumerate(_predictors(x)):
        u = residual << 1 ^ residual >> 31
        mean = u.mean(1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 14).astype(np.int32)
        cost = (u >> k[:, None]).sum(1) + u.shape[1] * (1 + k) + 8 * order + 10 + (0 if q is None else 9 + 10 * order)
        better = cost < best
        best, choice, params = np.where(better, cost, best), np.where(better, i, choice), np.where(better, k, params)
        kept.append((order, q, u))
    length = (best + 8 + 7) // 8  # bytes of each subframe
    bits = np.zeros((n, int(length.max()) * 8), np.uint8)

    def put(rows: np.ndarray, at: np.ndarray | int, value: np.ndarray | int, width: int) -> None:
        for j in range(width):
            bits[rows, at + j] = np.asarray(value) >> (width - 1 - j) & 1

    rows = np.flatnonzero(choice == -1)
    if len(rows):
        put(rows, 0, 0b00000010, 8)
        bits[rows, 8 : 8 + 8 * BLOCK] = np.unpackbits(x[rows].astype(np.uint8), axis=1)
    for i, (order, q, u) in enumerate(kept):
        rows = np.flatnonzero(choice == i)
        if not len(rows):
            continue
        put(rows, 0, (0b001000 | order if q is None else 0b100000 | order - 1) << 1, 8)
        at = 8
        for j in range(order):
            put(rows, at, x[rows, j] & 0xFF, 8)
            at += 8
        if q is not None:
            put(rows, at, 9, 4)  # precision of ten bits
            put(rows, at + 4, 7, 5)  # shift
            for j in range(order):
                put(rows, at + 9 + 10 * j, q[rows, j] & 0x3FF, 10)
            at += 9 + 10 * order
        put(rows, at + 6, params[rows], 4)  # method 0, partition order 0, parameter
        at += 10
        k, v = params[rows][:, None], u[rows]
        quotient = v >> k
        end = at + np.cumsum(quotient + 1 + k, 1)
        line = np.arange(len(rows))[:, None] * 0 + rows[:, None]
        bits[line, end - k - 1] = 1
        for j in range(int(k.max())):
            some = np.flatnonzero(k[:, 0] > j)
            bits[line[some], end[some] - 1 - j] = v[some] >> j & 1
    body = np.packbits(bits, axis=1)
    coded, coded_len = _coded_number(numbers)
    head = np.zeros((n, 12), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x14, 0x02)
    head[:, 4:11] = coded
    head_len = 4 + coded_len
    head[np.arange(n), head_len] = crc_rows(head, head_len, CRC8)
    head_len += 1
    total = head_len + length + 2
    frame = np.zeros((n, int(total.max())), np.uint8)
    for size in np.unique(head_len):
        at = np.flatnonzero(head_len == size)
        frame[at, :size] = head[at, :size]
        frame[at, size : size + body.shape[1]] = body[at][:, : frame.shape[1] - size]
    crc = crc_rows(frame, total - 2, CRC16)
    frame[np.arange(n), total - 2] = crc >> 8
    frame[np.arange(n), total - 1] = crc & 0xFF
    return frame.ravel()[_spans(np.arange(n) * frame.shape[1], total)], total


def pad_payload(data: bytes) -> bytes:
    """Append bytes 32 up to a positive multiple of ``BLOCK``."""
    return data + b" " * (-len(data) % BLOCK if data else BLOCK)


def encode_streams(payloads: list[bytes], seek_every: int = 64) -> list[bytes]:
    """FLAC streams of payloads whose lengths are multiples of ``BLOCK``; one seek point each ``seek_every`` frames."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = _spans(np.zeros(len(counts), np.int64), counts)
    parts, sizes = [], []
    for at in range(0, len(flat), FRAMES_AT_ONCE):
        data, length = encode_frames((flat[at : at + FRAMES_AT_ONCE] ^ 0x80).view(np.int8), numbers[at : at + FRAMES_AT_ONCE])
        parts.append(data.tobytes())
        sizes.append(length)
    data, sizes = b"".join(parts), np.concatenate(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, first = [], 0
    for payload, count in zip(payloads, counts.tolist()):
        own = sizes[first : first + count]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offsets = ends[first : first + count] - ends[first]
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, count, seek_every))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[ends[first] : ends[first + count]])
        first += count
    return out


def parse_stream(media: bytes) -> dict:
    """Stream info, seek points and the offset of the first frame."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, found = 4, False, {"seek": []}
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            found |= {"block": int.from_bytes(body[:2], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            found["seek"] = [struct.unpack_from(">QQH", body, i) for i in range(0, size, 18)]
        at += 4 + size
    if found.get("channels") != 1 or found["bits"] != 8:
        raise ValueError("only mono streams of 8-bit samples are read")
    return found | {"at": at}


def frame_starts(data: np.ndarray, base: np.ndarray, first: np.ndarray, block: int, number_from: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the frames of streams that lie one after another in ``data``, and the stream of each.

    Stream i begins at ``base[i]`` and its first frame, number ``number_from``, at ``first[i]``. A frame
    starts at the sync word with a valid header checksum and the next frame number of its stream.
    """
    code = next((c for c, size in BLOCK_CODES.items() if size == block), None)
    if code is None:
        raise ValueError(f"block size {block} is not supported")
    hits = np.flatnonzero((data[:-2] == 0xFF) & (data[1:-1] == 0xF8))
    hits = hits[data[hits + 2] >> 4 == code]
    stream = np.searchsorted(base, hits, side="right") - 1
    after = hits >= first[stream]
    hits, stream = hits[after], stream[after]
    heads = data[np.minimum(hits[:, None] + np.arange(12), len(data) - 1)]
    lead = heads[:, 4].astype(np.int64)
    size = coded_size(lead)
    number = np.where(size == 1, lead, lead & (0x7F >> size))
    for j in range(1, int(size.max(initial=1))):
        number = np.where(size > j, number << 6 | heads[:, 4 + j] & 0x3F, number)
    good = crc_rows(heads, 4 + size, CRC8) == heads[np.arange(len(hits)), 4 + size]
    hits, stream, number = hits[good], stream[good], number[good] - number_from
    rank = np.arange(len(hits)) - np.searchsorted(stream, stream)
    if (number != rank).any():  # chance sync words: keep the numbers that follow on
        keep, want, own = [], 0, -1
        for i, (s, v) in enumerate(zip(stream.tolist(), number.tolist())):
            want, own = (want, own) if s == own else (0, s)
            if v == want:
                keep.append(i)
                want += 1
        hits, stream = hits[keep], stream[keep]
    return hits, stream


def coded_size(lead: np.ndarray) -> np.ndarray:
    """Bytes of a coded frame number by its first byte."""
    return np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)


class _Bits:
    """Reads bit fields at one cursor per frame."""

    def __init__(self, frames: np.ndarray, at: np.ndarray):
        self.bytes = np.pad(frames, ((0, 0), (0, 8)))
        self.width, self.flat = self.bytes.shape[1], self.bytes.ravel().astype(np.uint32)
        flat = self.flat
        self.words = np.zeros(len(flat), np.uint32)
        self.words[:-3] = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
        self.base = np.arange(len(frames)) * self.width * 8
        self.at = at * 8 + self.base

    def take(self, width: np.ndarray | int, rows: np.ndarray) -> np.ndarray:
        at = self.at[rows]
        value = (self.words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(1)  # 0 bits wide is then a shift of 31
        self.at[rows] = at + width
        return (value >> (31 - np.asarray(width)).astype(np.uint32)).astype(np.int64)

    def signed(self, width: int, rows: np.ndarray) -> np.ndarray:
        value = self.take(width, rows)
        return value - ((value >> (width - 1)) << width)

    def long_code(self, at: int, k: int) -> tuple[int, int]:
        """A Rice code that may be longer than a word: its end and its quotient with low bits."""
        one = at
        while one < 8 * len(self.flat) and not int(self.flat[one >> 3]) >> (7 - (one & 7)) & 1:
            one += 1
        low = 0
        for i in range(one + 1, one + 1 + k):
            low = low << 1 | int(self.flat[i >> 3]) >> (7 - (i & 7)) & 1
        return one + 1 + k, one - at << k | low


def _rice(bits: _Bits, rows: np.ndarray, k: np.ndarray, count: int) -> np.ndarray:
    """``count`` Rice codes of each row: the loop finds where codes end and their low bits, the rest is done at once."""
    cursor, words = bits.at[rows], bits.words
    u = np.empty((count, len(rows)), np.uint32)
    right, k32 = (31 - k).astype(np.uint32), k.astype(np.uint32)
    for i in range(count):
        w = words.take(cursor >> 3, mode="clip")
        w <<= (cursor & 7).astype(np.uint32)
        quotient = LEADING_ZEROS.take(w >> 16)
        used = quotient + k
        w <<= quotient + np.uint32(1)
        w >>= 1
        w >>= right
        np.left_shift(quotient, k32, out=u[i])
        u[i] |= w
        if used.max(initial=0) > 23:  # 25 bits of a word are sure
            for j in np.flatnonzero(used > 23).tolist():
                end, u[i, j] = bits.long_code(int(cursor[j]), int(k[j]))
                used[j] = end - 1 - cursor[j]
        cursor = cursor + used
        cursor += 1
    if len(cursor) and (cursor - bits.base[rows]).max() > 8 * bits.width:
        raise ValueError("a residual runs past its frame")
    bits.at[rows] = cursor
    x = u.view(np.int32).T
    return x >> 1 ^ -(x & 1)


def _residual(bits: _Bits, rows: np.ndarray, order: int, block: int) -> np.ndarray:
    """Partitioned Rice residuals of frames with one predictor order, by partition order."""
    out = np.zeros((len(rows), block), np.int32)
    method, parts = bits.take(2, rows), bits.take(4, rows)
    for m, p in {*zip(method.tolist(), parts.tolist())}:
        own = np.flatnonzero((method == m) & (parts == p))
        some, size = rows[own], block >> p
        for part in range(1 << p):
            wide = 4 + int(m)
            k = bits.take(wide, some)
            escape = k == (1 << wide) - 1
            raw = np.zeros(len(some), np.int64)
            if escape.any():
                raw[escape] = bits.take(5, some[escape])
            plain, odd = np.flatnonzero(~escape), np.flatnonzero(escape)
            span = range(order if part == 0 else part * size, (part + 1) * size)
            if len(plain):
                out[own[plain], span.start : span.stop] = _rice(bits, some[plain], k[plain], len(span))
            for i in span if len(odd) else ():
                width = raw[odd]
                v = bits.take(width, some[odd])
                out[own[odd], i] = np.where(width > 0, v - (v >> np.maximum(width - 1, 0) << width), 0)
    return out


def decode_frames(frames: np.ndarray, lengths: np.ndarray, block: int) -> np.ndarray:
    """Samples of frames given as zero-padded rows; checks the CRC-16 of each frame."""
    n = len(frames)
    stored = frames[np.arange(n), lengths - 2].astype(np.uint16) << 8 | frames[np.arange(n), lengths - 1]
    if (crc_rows(frames, lengths - 2, CRC16) != stored).any():
        raise ValueError("a frame's checksum does not match")
    bits = _Bits(frames, 5 + coded_size(frames[:, 4]))
    kind = bits.take(8, np.arange(n)) >> 1
    out = np.zeros((n, block), np.int8)
    for t in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == t)
        if t == 0:
            out[rows] = bits.signed(8, rows)[:, None]
        elif t == 1:
            for i in range(block):
                out[rows, i] = bits.signed(8, rows)
        elif 8 <= t <= 12 or t >= 32:
            order = t - 8 if t < 32 else t - 31
            x = np.zeros((block, len(rows)), np.int32)
            for i in range(order):
                x[i] = bits.signed(8, rows)
            shift = np.zeros(len(rows), np.int32)
            q = np.repeat(np.array(FIXED_COEFFICIENTS[order] if t < 32 else [0] * order, np.int32)[:, None], len(rows), 1)
            if t >= 32:
                precision, shift = bits.take(4, rows) + 1, bits.take(5, rows).astype(np.int32)
                for j in range(order):
                    v = bits.take(precision, rows)
                    q[j] = v - (v >> precision - 1 << precision)
            residual = np.ascontiguousarray(_residual(bits, rows, order, block).T)
            if order == 0:
                x = residual
            else:
                for i in range(order, block):
                    guess = q[0] * x[i - 1]
                    for j in range(1, order):
                        guess = guess + q[j] * x[i - 1 - j]
                    x[i] = residual[i] + (guess >> shift)
            out[rows] = x.T
        else:
            raise ValueError(f"subframe type {t} is reserved")
    return out


def _frame_rows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Frames as zero-padded rows."""
    rows = np.zeros((len(sizes), int(sizes.max(initial=1))), np.uint8)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = data[_spans(starts, sizes)]
    return rows


def read_samples(media: bytes, first: int, count: int) -> bytes:
    """``count`` samples from ``first`` on, as unsigned bytes; only frames from the nearest seek point on are decoded."""
    info = parse_stream(media)
    block, stop = info["block"], min(first + count, info["samples"])
    if not 0 <= first < stop:
        return b""
    at, offset, _ = max((p for p in info["seek"] if p[0] <= first), default=(0, 0, block))
    end = min((p[1] for p in info["seek"] if p[0] >= stop), default=len(media) - info["at"])
    data = np.frombuffer(media[info["at"] + offset : info["at"] + end], np.uint8)
    starts, _ = frame_starts(data, np.array([0]), np.array([0]), block, at // block)
    rows = _frame_rows(data, starts, np.append(starts[1:], len(data)) - starts)
    samples = (decode_frames(rows, np.append(starts[1:], len(data)) - starts, block).view(np.uint8) ^ 0x80).tobytes()
    return samples[first - at : stop - at]


def pcm_blocks(info: dict, payload: bytes, frames_per_block: int = 64) -> Iterator[tuple[int, int, bytes]]:
    """(block, sample offset, samples) of a decoded stream."""
    step = frames_per_block * info["block"]
    for b, at in enumerate(range(0, len(payload), step)):
        yield b, at, payload[at : at + step]


def decode_streams(media: list[bytes]) -> list[tuple[dict, bytes]]:
    """(stream info, unsigned 8-bit payload) of each stream; verifies headers, frames, sample counts and the MD5."""
    infos, groups = [], {}
    for i, m in enumerate(media):
        infos.append(parse_stream(m))
        groups.setdefault(infos[-1]["block"], []).append(i)
    out: list = [None] * len(media)
    for block, own in groups.items():
        data = np.frombuffer(b"".join(media[i] for i in own), np.uint8)
        base = np.cumsum([0] + [len(media[i]) for i in own])
        starts, stream = frame_starts(data, base[:-1], base[:-1] + [infos[i]["at"] for i in own], block)
        counts = np.bincount(stream, minlength=len(own))
        if (counts * block != [infos[i]["samples"] for i in own]).any():
            raise ValueError("frames are missing or damaged")
        last = np.append(stream[1:] != stream[:-1], True)
        sizes = np.where(last, base[stream + 1], np.append(starts[1:], 0)) - starts
        parts = []
        for at in range(0, len(starts), FRAMES_AT_ONCE):
            size = sizes[at : at + FRAMES_AT_ONCE]
            parts.append(decode_frames(_frame_rows(data, starts[at : at + FRAMES_AT_ONCE], size), size, block).view(np.uint8) ^ 0x80)
        flat, first = np.concatenate(parts).ravel().tobytes(), 0
        for i, count in zip(own, counts.tolist()):
            payload = flat[first : first + count * block]
            first += len(payload)
            if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != infos[i]["md5"]:
                raise ValueError("the samples do not match the stream's MD5")
            out[i] = (infos[i], payload)
    return out


def encode_flac(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seek_every: int = 64) -> DataFrame:
    """One row per input row, repeated rows too: (id, n_bytes, media), the padded UTF-8 text as a FLAC stream.

    Null and empty texts give one block of padding; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                texts = [(t or "").encode() for t in piece.column("text").to_pylist()]
                media = encode_streams([pad_payload(t) for t in texts], seek_every)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def decode_flac(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", frames_per_block: int = 64) -> DataFrame:
    """PCM blocks: (id, block, sample_offset, pcm), a seekable cut of every decoded stream.

    A reader that wants sample s takes the block with the largest ``sample_offset`` not above s.
    Null streams give no blocks; rows that repeat an id give their blocks each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "media", SLICE_BYTES):
                ids, rows = piece.column("id").to_pylist(), ([], [], [], [])
                for key, (info, payload) in zip(ids, decode_streams(piece.column("media").to_pylist())):
                    for row in pcm_blocks(info, payload, frames_per_block):
                        for to, v in zip(rows, (key, *row)):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], piece.schema.field("id").type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], names=["id", "block", "sample_offset", "pcm"])

    given = media.filter(F.col(media_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, block bigint, sample_offset bigint, pcm binary").withColumnRenamed("id", id_col)


def media_digest(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", frames_per_block: int = 64) -> DataFrame:
    """Decode each stream into PCM blocks and describe what was read back.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    pcm_offsets, last_block_crc32). ``payload_sha256`` runs over the blocks in order; ``feature``
    holds frames, mean level, root mean square and sign changes of the samples. ``pcm_offsets`` are
    the blocks' sample offsets. ``last_block_crc32`` is taken from the last block as a reader gets
    it who seeks to its offset in the stream. Rows that repeat an id are described each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "media", SLICE_BYTES):
                streams = piece.column("media").to_pylist()
                found = {name: [] for name in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_offsets", "last_block_crc32")}
                for m, (info, payload) in zip(streams, decode_streams(streams)):
                    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8)
                    level, power = int(x.sum(dtype=np.int64)), int((x.astype(np.int16) ** 2).sum(dtype=np.int64))
                    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                    feature = f"frames={len(payload) // info['block']};mean={level / len(x):.6f};rms={(power / len(x)) ** 0.5:.6f};crossings={changes}"
                    whole, offsets = hashlib.sha256(), []
                    for _, offset, pcm in pcm_blocks(info, payload, frames_per_block):
                        whole.update(pcm)
                        offsets.append(offset)
                    # A stream of one block was read from its only offset; of others the last block is sought.
                    last = pcm if len(offsets) == 1 else read_samples(m, offsets[-1], len(pcm))
                    for to, v in zip(found.values(), (len(payload), whole.hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, offsets, zlib.crc32(last))):
                        to.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("n_bytes"), *(pa.array(v, t) for v, t in zip(found.values(), kinds))], names=["id", "n_bytes", *found])

    given = media.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media"))
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm_offsets array<bigint>, last_block_crc32 bigint"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
