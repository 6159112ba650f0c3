"""FLAC in columns: encode 8-bit payloads, decode Rice residuals and linear predictors, verify checksums, write PCM blocks.

A stream is `fLaC`, STREAMINFO (with the MD5 of the samples), a SEEKTABLE with a point for
each frame, and frames of one channel of 8-bit samples (a sample is a byte less 128).
Frames have up to 1024 samples, a fixed predictor of order 0 to 2 or a quantised linear
predictor of order 2, and four Rice partitions. The decoder takes fixed predictors up to
order 4, linear ones up to order 4 and any partition order that divides the block; it
checks each header's CRC-8, each frame's CRC-16 and the MD5, and finds frames by the seek table.

numpy handles many frames at once: one step of a loop decodes the same sample of all frames.

Defined results: a null or empty text is a payload of 64 zero bytes; a stream that
breaks the format or a checksum, or is null, has an error and no blocks; an empty table gives an
empty one; a very long text is a slice of its own, of as many frames as it needs.
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

from .common import as_bytes, slices, table

BLOCK, RATE, UNIT = 1024, 8000, 64
#: Frames that are worked on at once.
LANES = 4096
#: Frames that are encoded at once: their arrays stay in the cache.
CACHED = 384
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
PRECISION, SHIFT = 12, 9


def _crc_table(bits: int, poly: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crcs(data: np.ndarray, first: np.ndarray, lens: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each stretch of data."""
    out = np.zeros(len(first), np.uint16)
    if not len(first):
        return out
    order = np.argsort(-lens, kind="stable")
    at, left = first[order], lens[order]
    live = np.searchsorted(-left, -np.arange(int(left[0])), side="left")
    crc = np.zeros(len(order), np.uint16)
    for t, n in enumerate(live):
        b = data[at[:n] + t]
        if bits == 8:
            crc[:n] = _CRC8[crc[:n] ^ b]
        else:
            crc[:n] = (crc[:n] << np.uint16(8)) ^ _CRC16[(crc[:n] >> np.uint16(8)) ^ b]
    out[order] = crc
    return out


def _residuals(x: np.ndarray, taps: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x less its prediction; taps: (frames, order)."""
    guess = np.zeros_like(x)
    for j in range(taps.shape[1]):
        guess[:, j + 1 :] += taps[:, j : j + 1] * x[:, : -j - 1]
    return x - (guess >> shift[:, None])


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as UTF-8 codes: (frames, 6) bytes and how many count."""
    out, size = np.zeros((len(n), 6), np.uint8), np.ones(len(n), np.int64)
    out[:, 0] = n
    for k, (low, lead) in enumerate(((0x80, 0xC0), (0x800, 0xE0), (0x10000, 0xF0), (0x200000, 0xF8), (0x4000000, 0xFC)), 2):
        some = n >= low
        size[some] = k
        out[some, 0] = lead | (n[some] >> (6 * (k - 1)))
        for j in range(1, k):
            out[some, j] = 0x80 | ((n[some] >> (6 * (k - 1 - j))) & 0x3F)
    return out, size


def encode_frames(samples: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of (frames, BLOCK) signed samples, of which n count: their bytes end to end, and the size of each."""
    f = len(n)
    x = samples.astype(np.int32)
    inside = np.arange(BLOCK) < n[:, None]
    x *= inside
    # candidates: the fixed predictors, and the best linear one of order 2
    r0, r1, r2 = ((x[:, : BLOCK - k] * x[:, k:]).sum(1).astype(float) for k in range(3))
    det = r0 * r0 - r1 * r1
    ok = det > 1e-9 * (r0 * r0 + 1)
    safe = np.where(ok, det, 1)
    taps = np.stack([np.where(ok, (r1 * r0 - r1 * r2) / safe, 0), np.where(ok, (r0 * r2 - r1 * r1) / safe, 0)], 1)
    taps = np.clip(np.round(taps * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)
    none = np.zeros(f, np.int32)
    options = [(k, np.tile(np.array(FIXED[k], np.int32), (f, 1)).reshape(f, k), none) for k in (0, 1, 2)] + [(2, taps, none + SHIFT)]
    best, residual, choice = None, None, np.zeros(f, np.int64)
    for k, (order, t, shift) in enumerate(options):
        r = _residuals(x, t, shift)
        r *= inside
        r[:, :order] = 0
        cost = np.abs(r).sum(1) + (8 * order + 33 * (k == 3))
        if best is None:
            best, residual = cost, r
        else:
            better = cost < best
            best, residual, choice = np.where(better, cost, best), np.where(better[:, None], r, residual), np.where(better, k, choice)
    order = np.array([0, 1, 2, 2])[choice]
    linear = choice == 3
    u = (residual << 1) ^ (residual >> 31)
    # four partitions of n / 4 samples
    quarter = n // 4
    part = np.minimum(np.arange(BLOCK) // np.maximum(quarter, 1)[:, None], 3)
    total = np.stack([(u * (part == p)).sum(1) for p in range(4)], 1)
    count = quarter[:, None] - np.where(np.arange(4) == 0, order[:, None], 0)
    mean = total / np.maximum(count, 1)
    k4 = np.clip(np.floor(np.log2(np.maximum(mean * 0.72, 1e-9))) + 1, 0, 14).astype(np.int32)
    k = np.take_along_axis(k4, part, 1)
    coded = inside & (np.arange(BLOCK) >= order[:, None])
    starts_part = np.zeros((f, BLOCK), bool)
    rows = np.arange(f)
    for p in range(4):
        starts_part[rows, np.where(p == 0, order, p * quarter)] = True
    q = u >> k
    bits = np.where(coded, q + 1 + k, 0) + 4 * starts_part
    head, head_size = _number(number)
    head_bytes = 4 + head_size + 2 + 1
    sub_bits = 8 + 8 * order + np.where(linear, 9 + PRECISION * 2, 0) + 6
    ends = np.cumsum(bits, 1)
    body = (sub_bits + ends[:, -1] + 7) // 8
    size = head_bytes + body + 2
    first = np.cumsum(size) - size
    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # start bit, value, bits (at most 16)
    bit0 = (first + head_bytes) * 8
    fields.append((bit0, np.where(linear, 0x40 | (1 << 1), (8 + order) << 1), np.full(f, 8)))
    for j in range(2):
        some = np.flatnonzero(order > j)
        fields.append((bit0[some] + 8 + 8 * j, x[some, j] & 255, np.full(len(some), 8)))
    some = np.flatnonzero(linear)
    at = bit0[some] + 8 + 16
    fields.append((at, np.full(len(some), (PRECISION - 1) << 5 | SHIFT), np.full(len(some), 9)))
    for j in range(2):
        fields.append((at + 9 + PRECISION * j, taps[some, j] & ((1 << PRECISION) - 1), np.full(len(some), PRECISION)))
    fields.append((bit0 + sub_bits - 6, np.full(f, 2), np.full(f, 6)))
    begin = (bit0 + sub_bits)[:, None] + ends - bits
    for p in range(4):
        col = np.where(p == 0, order, p * quarter)
        fields.append((begin[rows, col], k4[:, p], np.full(f, 4)))
    at = (begin + 4 * starts_part + q)[coded]
    kc = k[coded]
    fields.append((at, (1 << kc) | (u[coded] & ((1 << kc) - 1)), kc + 1))
    start, value, width = (np.concatenate(a) for a in zip(*fields, strict=True))
    byte, word = start >> 3, value.astype(np.int64) << (24 - width - (start & 7))
    data = np.zeros(int(size.sum()) + 8, np.uint8)
    for j in range(3):  # fields share bytes but no bits: sums are unions
        data += np.bincount(byte + j, (word >> (16 - 8 * j)) & 255, len(data)).astype(np.uint8)
    for j, b in enumerate((0xFF, 0xF8, 0x70, 0x02)):
        data[first + j] = b
    for j in range(6):
        some = head_size > j
        data[first[some] + 4 + j] = head[some, j]
    data[first + 4 + head_size] = (n - 1) >> 8
    data[first + 5 + head_size] = (n - 1) & 255
    data[first + 6 + head_size] = _crcs(data, first, head_bytes - 1, 8)
    crc = _crcs(data, first, size - 2, 16)
    data[first + size - 2], data[first + size - 1] = crc >> 8, crc & 255
    return data[: int(size.sum())], size


class _Bits:
    """Reads bits of many frames at once."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        self.words = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            self.words = (self.words << np.uint64(8)) | padded[j : j + len(self.words)]
        self.at = at.astype(np.int64) * 8

    def window(self, lanes) -> np.ndarray:
        at = self.at[lanes]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def take(self, lanes, width: int) -> np.ndarray:
        out = (self.window(lanes) >> np.uint64(64 - width)).astype(np.int64)
        self.at[lanes] += width
        return out


def _signed(v: np.ndarray, width) -> np.ndarray:
    return v - ((v >> (width - 1)) << width)


def decode_frames(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames at so many byte offsets: (frames, longest) signed samples, how many count, and the frame numbers."""
    f = len(first)

    def need(ok: np.ndarray, what: str) -> None:
        if not np.all(ok):
            raise ValueError(f"not a FLAC frame: {what}")

    need(size >= 10, "it is cut short")
    need((data[first] == 0xFF) & (data[first + 1] == 0xF8), "no sync code")
    need((data[first + 2] == 0x70) & (data[first + 3] == 0x02), "another kind of block than 8-bit mono with its size")
    lead = data[first + 4].astype(np.int64)
    extra = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, -1, 1, 2, 3, 4, 5], -1)
    need(extra >= 0, "its number")
    number = np.where(extra == 0, lead, lead & ((1 << np.maximum(6 - extra, 0)) - 1))
    for j in range(1, int(extra.max()) + 1 if f else 0):
        number = np.where(extra >= j, (number << 6) | (data[first + 4 + np.minimum(j, extra)] & 0x3F), number)
    head = 8 + extra
    n = (data[first + head - 3].astype(np.int64) << 8 | data[first + head - 2]) + 1
    need(_crcs(data, first, head - 1, 8) == data[first + head - 1], "its header's CRC-8")
    need(_crcs(data, first, size - 2, 16) == (data[first + size - 2].astype(np.uint16) << np.uint16(8) | data[first + size - 1]), "its CRC-16")
    rank = np.argsort(-n, kind="stable")
    n_, bits = n[rank], _Bits(data, (first + head)[rank])
    every = np.arange(f)
    kind = bits.take(every, 8) >> 1
    linear = kind >= 32
    order = np.where(linear, kind - 31, kind - 8)
    need((linear | ((kind >= 8) & (kind <= 12))) & (order <= 4) & (order <= n_), "its predictor")
    longest = int(n_.max()) if f else 0
    x = np.zeros((longest + 4, f), np.int32)  # four rows of zeros stand before the first sample
    for j in range(4):
        some = np.flatnonzero(order > j)
        x[4 + j, some] = _signed(bits.take(some, 8), 8)
    taps, shift = np.zeros((4, f), np.int32), np.zeros(f, np.int32)
    for k, t in FIXED.items():
        taps[:k, ~linear & (order == k)] = np.array(t, np.int32)[:, None] if k else 0
    some = np.flatnonzero(linear)
    precision = np.zeros(f, np.int64)
    precision[some] = bits.take(some, 4) + 1
    shift[some] = _signed(bits.take(some, 5), 5)
    need(shift >= 0, "its shift")
    for j in range(4):
        for width in np.unique(precision[some[order[some] > j]]):
            those = some[(order[some] > j) & (precision[some] == width)]
            taps[j, those] = _signed(bits.take(those, int(width)), int(width))
    need(bits.take(every, 2) == 0, "its residual coding")
    parts = 1 << bits.take(every, 4)
    need(n_ % parts == 0, "its partitions")
    length = n_ // parts
    k = np.zeros(f, np.int64)
    turns = {0} | {int(t) for a in np.unique(length) for t in range(int(a), longest, int(a))} if f else set()
    one, live = np.uint64(1), np.searchsorted(-n_, -np.arange(longest), side="left")
    for t in range(longest):
        m = int(live[t])
        if t in turns:
            some = np.flatnonzero(t % length[:m] == 0)
            k[some] = bits.take(some, 4)
            need(k[some] < 15, "an escape code")
        lanes = slice(0, m) if t >= 4 else np.flatnonzero(order[:m] <= t)
        at = bits.at[lanes]
        w = bits.words[at >> 3] << (at & 7).astype(np.uint64)
        zeros = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        if zeros.size and zeros.max() >= 40:  # a long run of zeros: step by step
            ids = np.arange(f)[lanes]
            for i in np.flatnonzero(zeros >= 40):
                p, z = int(at[i]), 0
                while not (ahead := (int(bits.words[(p + z) >> 3]) << ((p + z) & 7)) & ((1 << 64) - 1)):
                    z += 56
                    need(z < 1 << 20, "its residuals")
                zeros[i] = z + 64 - ahead.bit_length()
            kk = k[ids]
            begin = at + zeros + 1
            w = bits.words[begin >> 3] << (begin & 7).astype(np.uint64)
        else:
            kk = k[lanes]
            w = w << (zeros + 1).astype(np.uint64)
        low = ((w >> one) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        u = (zeros << kk) | low
        bits.at[lanes] = at + zeros + 1 + kk
        guess = taps[0, lanes] * x[t + 3, lanes] + taps[1, lanes] * x[t + 2, lanes]
        if (order > 2).any():
            guess += taps[2, lanes] * x[t + 1, lanes] + taps[3, lanes] * x[t, lanes]
        x[t + 4, lanes] = ((u >> 1) ^ -(u & 1)) + (guess >> shift[lanes])
    need((bits.at + 7) // 8 == (first + size)[rank] - 2, "its length")
    out = np.empty((f, longest), np.int32)
    out[rank] = x[4:].T
    return out, n, number


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (a positive multiple of 64 bytes)."""
    lens = np.fromiter(map(len, payloads), np.int64, len(payloads))
    frames = -(-lens // BLOCK)
    flat = np.frombuffer(b"".join(payloads) + bytes(BLOCK), np.uint8)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    first = (np.cumsum(lens) - lens)[owner] + number * BLOCK
    n = np.minimum(BLOCK, lens[owner] - number * BLOCK)
    body, sizes = [], []
    for at in range(0, len(owner), CACHED):
        some = slice(at, at + CACHED)
        x = flat[first[some, None] + np.arange(BLOCK)].astype(np.int16) - 128
        data, size = encode_frames(x, n[some], number[some])
        body.append(data.tobytes())
        sizes.append(size)
    body, size = b"".join(body), np.concatenate(sizes)
    ends = np.cumsum(size)
    out, f = [], 0
    for p, k in zip(payloads, frames.tolist(), strict=True):
        own = slice(f, f + k)
        begin, f = int(ends[f] - size[f]), f + k
        end = int(ends[f - 1])
        md5 = hashlib.md5(np.frombuffer(p, np.uint8).__sub__(np.uint8(128)).tobytes()).digest()
        least = min(BLOCK, len(p))
        info = struct.pack(">HH", least, least) + int(size[own].min()).to_bytes(3, "big") + int(size[own].max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        points = np.zeros(k, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        points["sample"], points["offset"], points["n"] = number[own] * BLOCK, ends[own] - size[own] - begin, n[own]
        out.append(b"fLaC" + (34).to_bytes(4, "big") + info + (0x83 << 24 | 18 * k).to_bytes(4, "big") + points.tobytes() + body[begin:end])
    return out


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Of each stream its payload and the sample offsets of its blocks."""
    first, size, owner, expect, md5s, totals = [], [], [], [], [], []
    at = 0
    for i, s in enumerate(streams):
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        p, points, last, info = 4, None, False, b""
        while not last:
            kind, length = s[p], int.from_bytes(s[p + 1 : p + 4], "big")
            last, block = bool(kind & 0x80), s[p + 4 : p + 4 + length]
            if kind & 0x7F == 0:
                info = block
            elif kind & 0x7F == 3:
                points = np.frombuffer(block, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            p += 4 + length
        if points is None or len(info) != 34:
            raise ValueError("a FLAC stream without STREAMINFO or SEEKTABLE")
        totals.append(int.from_bytes(info[10:18], "big") & ((1 << 36) - 1))
        md5s.append(info[18:])
        offset = points["offset"].astype(np.int64)
        first.append(at + p + offset)
        size.append(np.diff(np.append(offset, len(s) - p)))
        owner.append(np.full(len(offset), i))
        expect.append(points["sample"].astype(np.int64))
        at += len(s)
    first, size, expect, owner = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (first, size, expect, owner))
    data, parts, counts, numbers = np.frombuffer(b"".join(streams), np.uint8), [], [], []
    for a in range(0, len(first), LANES):
        lo, hi = int(first[a]), int((first + size)[min(a + LANES, len(first)) - 1])
        x, n, number = decode_frames(data[lo:hi], first[a : a + LANES] - lo, size[a : a + LANES])
        if (expect[a : a + LANES] != number * BLOCK).any():
            raise ValueError("the seek table and the frames differ")
        parts.append((x + 128).astype(np.uint8)[np.arange(x.shape[1]) < n[:, None]].tobytes())
        counts.append(n)
    flat, n = b"".join(parts), np.concatenate(counts) if counts else np.zeros(0, np.int64)
    lens = np.bincount(owner, n, len(streams)).astype(np.int64)
    out, at = [], 0
    begin = np.searchsorted(owner, np.arange(len(streams) + 1))
    for i, length in enumerate(lens.tolist()):
        payload = flat[at : at + length]
        at += length
        if length != totals[i] or hashlib.md5((np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()).digest() != md5s[i]:
            raise ValueError("the samples' number or MD5")
        out.append((payload, expect[begin[i] : begin[i + 1]]))
    return out


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (UNIT if not text else 0))


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each document row: its text's payload as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = as_bytes(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(len, texts), pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


BLOCKS = "array<struct<sample_offset:bigint,pcm:binary>>"


def _decoded(streams: list[bytes]) -> tuple[list[tuple[bytes, np.ndarray] | None], list[str | None]]:
    """Each stream's payload and offsets, or None and what is wrong with it: a damaged stream spoils no other."""
    try:
        return decode(streams), [None] * len(streams)
    except (ValueError, IndexError, struct.error):
        out, errors = [], []
        for s in streams:
            try:
                out += decode([s])
                errors.append(None)
            except (ValueError, IndexError, struct.error) as e:
                out.append(None)
                errors.append(str(e) or type(e).__name__)
        return out, errors


def decoded(streams: DataFrame) -> DataFrame:
    """streams (doc_id, media, perhaps n_bytes) with blocks, structs (sample_offset, pcm) of unsigned 8-bit samples, and error (null if the stream is sound)."""
    kept = [c for c in ("doc_id", "n_bytes", "media") if c in streams.columns]
    kinds = {"doc_id": "long", "n_bytes": "long", "media": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4 << 20):
            found, errors = _decoded([m or b"" for m in batch["media"].to_pylist()])
            at, pcm, ends = [], [], [0]
            for p, offsets in (f or (b"", np.zeros(0, np.int64)) for f in found):
                cuts = [*offsets.tolist(), len(p)]
                at += cuts[:-1]
                pcm += [p[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                ends.append(len(at))
            values = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(pcm, pa.binary())], names=["sample_offset", "pcm"])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(errors, pa.string())], names=[*kept, "blocks", "error"])

    return streams.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kept]).mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in kept], f"blocks {BLOCKS}", "error string"]))


def pcm_blocks(streams: DataFrame) -> DataFrame:
    """(doc_id, sample_offset, pcm, error): a row for each block of (doc_id, media), which can be read from any offset; one row with the error for a damaged stream, and for a null one."""
    rows = decoded(streams).select("doc_id", F.explode_outer("blocks").alias("b"), "error")
    return rows.select("doc_id", "b.sample_offset", "b.pcm", "error")


def feature(samples: bytes, blocks: int) -> str:
    """Whole numbers of the decoded signal: blocks, energy, zero crossings, peak and total variation."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    d = np.diff(x)
    return f"blocks={blocks};energy={int(x @ x)};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max())};variation={int(np.abs(d).sum())}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text, writes its PCM blocks and reads these back by their offsets; the digests are of what was read back."""
    return stream_digests(media(docs))


def stream_digests(streams: DataFrame) -> DataFrame:
    """DIGESTS of streams (doc_id, n_bytes, media); of a damaged stream the error, and no digests of its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4 << 20):
            rows = []
            for s, blocks, error in zip(batch["media"].to_pylist(), batch["blocks"].to_pylist(), batch["error"].to_pylist(), strict=True):
                s = s or b""
                if error is not None:
                    rows.append((None, None, None, len(s), hashlib.sha256(s).hexdigest(), None, error))
                    continue
                p = b"".join(b["pcm"] for b in sorted(blocks, key=lambda b: b["sample_offset"]))
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), feature(p, len(blocks)), None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return decoded(streams).select("doc_id", "n_bytes", "media", "blocks", "error").mapInArrow(run, DIGESTS)


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
