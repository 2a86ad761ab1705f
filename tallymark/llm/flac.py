"""FLAC streams of 8-bit mono samples: writing, reading and seeking, many frames at once.

A stream's seek table has every frame, so all frames of a group of streams decode side by side: sample i of every
frame in one step.  Readers take constant, verbatim, fixed-predictor and linear-predictor subframes with partitioned
Rice residuals (escapes included) in blocks of equal size; header CRC-8, frame CRC-16 and the stream's MD5 are verified.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_batch, id_and_text, to_arrow

BLOCK = 576
_SPLIT = 2  # Rice partitions per frame as a power of two
_RATE = 8000
_LPC_BITS = 7
GROUP = 4096  # frames that are written or read side by side


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        crc = b << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, dtype=np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of short stretches of bytes. Stretches are aligned at their ends: zeros in front leave a CRC at zero."""
    crc = np.zeros(len(start), dtype=np.uint32)
    end = start + length
    for back in range(int(length.max(initial=0)), 0, -1):
        byte = np.where(back <= length, data[np.maximum(end - back, 0)], 0).astype(np.uint32)
        crc = (crc << np.uint32(8) & np.uint32((1 << bits) - 1)) ^ table[(crc >> np.uint32(bits - 8)) ^ byte]
    return crc


_PAIRS = ((lambda c: (c << np.uint32(8) & np.uint32(0xFFFF)) ^ _CRC16[c >> np.uint32(8)])(
    (lambda c: (c << np.uint32(8) & np.uint32(0xFFFF)) ^ _CRC16[c >> np.uint32(8)])(np.arange(65536, dtype=np.uint32))
)).astype(np.uint16)


def _frame_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of frames, two bytes a step, aligned as above."""
    wide = data.astype(np.uint16)
    pairs = wide[:-1] << np.uint16(8) | wide[1:]
    crc = np.zeros(len(start), dtype=np.uint16)
    end = start + length
    least = int(length.min(initial=1 << 30))
    for back in range(2 * ((int(length.max(initial=0)) + 1) // 2), 0, -2):
        at = end - back
        pair = pairs[np.maximum(at, 0)]
        if back > least:
            first = np.where(at >= 0, pair, wide[0]) & np.uint16(0xFF)  # the pair's second byte is the stretch's first
            pair = np.where(back <= length, pair, np.where(back == length + 1, first, np.uint16(0)))
        crc = _PAIRS[crc ^ pair]
    return crc


def _number_bytes(n: int) -> bytes:
    """A frame's number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~lead << 1 & 0xFF) | n, *reversed(tail)])


# ---------------------------------------------------------------- writing


@lru_cache(maxsize=65_536)
def _head(number: int) -> bytes:
    """A frame's header: 576 samples, 8 kHz, mono, 8 bits."""
    head = b"\xff\xf8\x24\x02" + _number_bytes(number)
    crc = 0
    for b in head:
        crc = int(_CRC8[crc ^ b])
    return head + bytes([crc])


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 31)).astype(np.uint32)


def _rice_cost(u: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the best Rice code of each frame and its parameters by partition; the first ``order`` places are free."""
    parts = u.reshape(len(u), 1 << _SPLIT, -1)
    n = np.full(1 << _SPLIT, parts.shape[2], dtype=np.int64)
    n[0] -= order
    guess = np.log2(np.maximum(parts.sum(axis=2, dtype=np.int64) / n * 0.7, 1)).astype(np.int64)
    best = parameter = None
    for k in (guess - 1, guess, guess + 1):
        k = np.clip(k, 0, 14)
        bits = (parts >> k[:, :, None].astype(np.uint32)).sum(axis=2, dtype=np.int64) + n * (k + 1)
        if best is None:
            best, parameter = bits, k
        else:
            parameter = np.where(bits < best, k, parameter)
            best = np.minimum(bits, best)
    return best.sum(axis=1) + 6 + (4 << _SPLIT), parameter


def _predictor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second-order linear predictors of frames by the autocorrelation method: (coefficients, residuals)."""
    f = x.astype(np.float64)
    r0 = np.maximum((f * f).sum(axis=1), 1.0)
    r1, r2 = (f[:, 1:] * f[:, :-1]).sum(axis=1), (f[:, 2:] * f[:, :-2]).sum(axis=1)
    k1 = r1 / r0
    e = np.maximum(r0 * (1 - k1 * k1), 1e-9)
    k2 = np.clip((r2 - k1 * r1) / e, -0.99, 0.99)
    scale = 1 << (_LPC_BITS - 3)
    most = (1 << (_LPC_BITS - 1)) - 1
    c = np.clip(np.rint(np.stack([k1 * (1 - k2), k2], axis=1) * scale), -most, most).astype(np.int32)
    residual = x.copy()
    residual[:, 2:] -= (c[:, :1] * x[:, 1:-1] + c[:, 1:] * x[:, :-2]) >> (_LPC_BITS - 3)
    return c, residual


def write_streams(payloads: list[bytes], group: int = GROUP) -> list[bytes]:
    """A FLAC stream of each payload, whose length is a positive multiple of the block; sample = byte - 128.

    Frames are written in groups, whatever stream they belong to, so memory beyond the streams follows a group.  A
    payload whose seek table the format can't hold (over 500 MB) is a ValueError.
    """
    counts = [len(p) // BLOCK for p in payloads]
    if max(counts) * 18 >= 1 << 24:
        raise ValueError("the payload has more frames than a seek table holds")
    x = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    parts = [_write_frames(x[at : at + group], numbers[at : at + group]) for at in range(0, len(x), group)]
    data, lengths = b"".join([d for d, _ in parts]), np.concatenate([n for _, n in parts])
    begins = np.cumsum(lengths) - lengths

    streams, row = [], 0
    for payload, n in zip(payloads, counts):
        lens, start = lengths[row : row + n], int(begins[row])
        points = np.zeros(n, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"] = np.arange(n) * BLOCK
        points["offset"] = begins[row : row + n] - start
        points["size"] = BLOCK
        pcm = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
        info = (
            BLOCK.to_bytes(2, "big") * 2
            + int(lens.min()).to_bytes(3, "big")
            + int(lens.max()).to_bytes(3, "big")
            + (_RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
            + hashlib.md5(pcm).digest()
        )
        table = points.tobytes()
        streams.append(
            b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
            + data[start : start + int(lens.sum())]
        )
        row += n
    return streams


def _write_frames(payload: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of rows of bytes, one after another, and their lengths."""
    x = payload.astype(np.int32) - 128

    # what each way to write a frame costs
    residuals, costs, parameters = [], [], []
    fixed = x
    for order in range(4):
        r = fixed.copy()
        r[:, :order] = 0
        cost, k = _rice_cost(_zigzag(r), order)
        residuals.append(r)
        costs.append(cost + 8 * order)
        parameters.append(k)
        fixed = np.concatenate([fixed[:, :1], np.diff(fixed, axis=1)], axis=1)
    coefficients, r = _predictor(x)
    r[:, :2] = 0
    cost, k = _rice_cost(_zigzag(r), 2)
    residuals.append(r)
    costs.append(cost + 16 + 9 + 2 * _LPC_BITS)
    parameters.append(k)
    way = np.stack(costs).argmin(axis=0)
    bits = np.choose(way, costs)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (bits >= 8 * BLOCK)
    coded = np.flatnonzero(~constant & ~verbatim)
    body = np.where(constant, 8, np.where(verbatim, 8 * BLOCK, bits))

    different, number = np.unique(numbers, return_inverse=True)
    heads = [_head(n) for n in different.tolist()]
    head_length = np.array([len(h) for h in heads])[number]
    lengths = head_length + (8 + body + 7) // 8 + 2
    begins = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()) * 8, dtype=np.uint8)  # a bit each

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            out[at + j] = (value >> (width - 1 - j)) & 1

    as_bits = [np.unpackbits(np.frombuffer(h, dtype=np.uint8)) for h in heads]
    for size in np.unique(head_length):
        rows = np.flatnonzero(head_length == size)
        alike = np.stack([b if len(b) == 8 * size else np.zeros(8 * size, dtype=np.uint8) for b in as_bits])
        out[(8 * begins[rows])[:, None] + np.arange(8 * size)] = alike[number[rows]]
    at = 8 * (begins + head_length)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(way == 4, 32 + 1, 8 + way)))
    put(at, kind << 1, 8)
    at = at + 8
    put(at[constant], x[constant, 0] & 0xFF, 8)
    rows = np.flatnonzero(verbatim)
    if len(rows):
        out[at[rows][:, None] + np.arange(8 * BLOCK)] = np.unpackbits((x[rows] & 0xFF).astype(np.uint8), axis=1)
    for w in np.unique(way[coded]):
        rows = coded[way[coded] == w]
        order = 2 if w == 4 else int(w)
        here = at[rows]
        for j in range(order):
            put(here, x[rows, j] & 0xFF, 8)
            here = here + 8
        if w == 4:
            put(here, np.full(len(rows), (_LPC_BITS - 1) << 5 | (_LPC_BITS - 3)), 9)
            here = here + 9
            for j in range(2):
                put(here, coefficients[rows, j] & ((1 << _LPC_BITS) - 1), _LPC_BITS)
                here = here + _LPC_BITS
        put(here, np.full(len(rows), _SPLIT), 6)
        here = here + 6
        u = _zigzag(residuals[w][rows]).astype(np.int64)
        k = parameters[w][rows]
        size = BLOCK >> _SPLIT
        for p in range(1 << _SPLIT):
            put(here, k[:, p], 4)
            here = here + 4
            first = order if p == 0 else 0
            part = u[:, p * size + first : (p + 1) * size]
            q = part >> k[:, p : p + 1]
            length = q + 1 + k[:, p : p + 1]
            ends = here[:, None] + np.cumsum(length, axis=1)
            out[ends - k[:, p : p + 1] - 1] = 1
            for j in range(int(k[:, p].max(initial=0))):  # low bits, the last first
                has = np.flatnonzero(k[:, p] > j)
                out[ends[has] - 1 - j] = (part[has] >> j) & 1
            here = ends[:, -1]
    data = np.packbits(out)
    crc = _frame_crcs(data, begins, lengths - 2)
    data[begins + lengths - 2] = crc >> 8
    data[begins + lengths - 1] = crc & 0xFF
    return data.tobytes(), lengths


# ---------------------------------------------------------------- reading


def _metadata(stream: bytes) -> dict:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, found = 4, {}
    while True:
        kind, length = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + length]
        if kind & 0x7F == 0:
            word = int.from_bytes(block[10:18], "big")
            found |= {"block": int.from_bytes(block[:2], "big"), "channels": (word >> 41 & 7) + 1, "bits": (word >> 36 & 31) + 1, "samples": word & (1 << 36) - 1, "md5": block[18:34]}
        elif kind & 0x7F == 3:
            found["points"] = np.frombuffer(block, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        at += 4 + length
        if kind & 0x80:
            break
    if found["channels"] != 1 or found["bits"] != 8 or "points" not in found:
        raise ValueError("only mono streams of 8 bits with a seek table are read")
    return found | {"frames": at}


_LEADING = np.full(65536, 16, dtype=np.int64)  # zeros before the first one of 16 bits
for _n in range(16):
    _LEADING[1 << _n : 2 << _n] = 15 - _n


class _Bits:
    """Reading bit fields at many places at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self._words = np.zeros(len(data), dtype=np.uint64)
        for j in range(8):
            self._words |= padded[j : j + len(data)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place on, at the top of 64."""
        return self._words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Up to 32 bits, unsigned."""
        width = np.asarray(width, dtype=np.uint64)
        return (self.window(at) >> np.uint64(1) >> (np.uint64(63) - width)).astype(np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        v = self.take(at, width)
        return np.where(v >> (width - 1), v - (1 << width), v)

    def rice(self, at: np.ndarray, k: np.ndarray, unsigned_k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A Rice code at each place, unfolded to a signed value, and the place after it."""
        word = self.window(at)
        zeros = _LEADING[word >> np.uint64(48)]
        long = zeros == 16
        if long.any():
            place = at.copy()
            rows = np.flatnonzero(long)
            while len(rows):
                place[rows] += 16
                more = _LEADING[self.window(place[rows]) >> np.uint64(48)]
                zeros[rows] = place[rows] - at[rows] + more
                rows = rows[more == 16]
            low = self.take(at + zeros + 1, unsigned_k)
        else:
            low = (word << (zeros + 1).astype(np.uint64) >> np.uint64(1) >> (np.uint64(63) - unsigned_k)).astype(np.int64)
        u = zeros << k | low
        return (u >> 1) ^ -(u & 1), at + zeros + 1 + k


def _residuals(bits: _Bits, at: np.ndarray, order: int, block: int, split: int, wide: np.ndarray) -> np.ndarray:
    """Residuals of frames of one predictor order and partition count, from the first partition's parameter on."""
    out = np.zeros((block - order, len(at)), dtype=np.int64)
    size = block >> split
    width = 4 + wide
    done = 0
    for p in range(1 << split):
        k = bits.take(at, width)
        escape = k == (1 << width) - 1
        at = at + width
        raw = bits.take(at, 5)
        at = np.where(escape, at + 5, at)
        some = escape.any()
        unsigned_k = k.astype(np.uint64)
        for _ in range(size - (order if p == 0 else 0)):
            if some:
                plain = bits.take(at, raw)
                plain = np.where((raw > 0) & (plain >> np.maximum(raw - 1, 0) == 1), plain - (1 << raw), plain)
                value, after = np.empty_like(at), np.empty_like(at)
                coded = ~escape
                value[escape], after[escape] = plain[escape], (at + raw)[escape]
                value[coded], after[coded] = bits.rice(at[coded], k[coded], unsigned_k[coded])
            else:
                value, after = bits.rice(at, k, unsigned_k)
            out[done] = value
            at = after
            done += 1
    return out.T


def _integrated(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Samples of a fixed predictor: as many running sums as its order."""
    if not warm.shape[1]:
        return residual
    inner = _integrated(np.diff(warm, axis=1), residual)
    return np.cumsum(np.concatenate([warm[:, :1], inner], axis=1), axis=1)


def read_frames(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, block: int) -> np.ndarray:
    """Samples of frames, a row each; raises ValueError where a checksum differs."""
    bits = _Bits(data)
    if (data[begins] != 0xFF).any() or (data[begins + 1] != 0xF8).any():
        raise ValueError("a frame doesn't start at its seek point")
    lead = data[begins + 4].astype(np.int64)
    more = np.zeros(len(begins), dtype=np.int64)
    for n, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0), (4, 0xF8), (5, 0xFC), (6, 0xFE)):
        more = np.where(lead >= least, n, more)
    code = data[begins + 2] >> 4
    extra = np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.where(data[begins + 2] & 15 == 12, 1, np.where(np.isin(data[begins + 2] & 15, (13, 14)), 2, 0))
    head = 5 + more + extra
    if (_crcs(data, begins, head, _CRC8, 8) != data[begins + head]).any():
        raise ValueError("a frame header's checksum differs")
    last = begins + lengths - 2
    if (_frame_crcs(data, begins, lengths - 2) != (data[last].astype(np.uint16) << 8 | data[last + 1])).any():
        raise ValueError("a frame's checksum differs")

    at = 8 * (begins + head + 1)
    kind = bits.take(at, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits are not read")
    kind >>= 1
    at = at + 8
    out = np.empty((len(begins), block), dtype=np.int64)
    rows = kind == 0
    out[rows] = bits.signed(at[rows], 8)[:, None]
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        out[rows] = data[(at[rows] >> 3)[:, None] + np.arange(block)].astype(np.int8)
    for k in np.unique(kind[kind > 1]).tolist():
        rows = np.flatnonzero(kind == k)
        order = k - 8 if k < 32 else k - 31
        here = at[rows]
        warm = np.stack([bits.signed(here + 8 * j, 8) for j in range(order)], axis=1) if order else np.empty((len(rows), 0), dtype=np.int64)
        here = here + 8 * order
        if k >= 32:
            precision = bits.take(here, 4) + 1
            shift = bits.signed(here + 4, 5)
            here = here + 9
            c = []
            for _ in range(order):
                v = bits.take(here, precision)
                c.append(np.where(v >> (precision - 1) == 1, v - (1 << precision), v))
                here = here + precision
        method = bits.take(here, 2)
        split = bits.take(here + 2, 4)
        here = here + 6
        residual = np.empty((len(rows), block - order), dtype=np.int64)
        for s in np.unique(split).tolist():
            own = np.flatnonzero(split == s)
            residual[own] = _residuals(bits, here[own], order, block, s, method[own])
        if k < 32:
            out[rows] = _integrated(warm, residual)
        else:
            x = np.concatenate([warm, residual], axis=1)
            for i in range(order, block):
                x[:, i] += sum(c[j] * x[:, i - 1 - j] for j in range(order)) >> shift
            out[rows] = x
    return out


def read_streams(streams: list[bytes], group: int = GROUP) -> list[bytes]:
    """The payloads of streams, verified; frames are read in groups, whatever stream they belong to."""
    heads = [_metadata(s) for s in streams]
    data = np.frombuffer(b"".join([s[h["frames"] :] for s, h in zip(streams, heads)]), dtype=np.uint8)
    begins, lengths, base = [], [], 0
    for s, h in zip(streams, heads):
        own = h["points"]["offset"].astype(np.int64)
        size = len(s) - h["frames"]
        begins.append(own + base)
        lengths.append(np.diff(own, append=size))
        base += size
    block = heads[0]["block"]
    if any(h["block"] != block for h in heads):
        raise ValueError("streams of one group have one block size")
    begin, length = np.concatenate(begins), np.concatenate(lengths)
    parts = []
    for at in range(0, len(begin), group):
        own, end = slice(at, at + group), min(at + group, len(begin)) - 1
        frames = data[begin[at] : begin[end] + length[end]]
        parts.append(read_frames(frames, begin[own] - begin[at], length[own], block).astype(np.int8))
    flat = np.concatenate(parts).reshape(-1).view(np.uint8)
    out, row = [], 0
    for h in heads:
        pcm = flat[row : row + h["samples"]]
        row += len(h["points"]) * block
        if hashlib.md5(pcm.tobytes()).digest() != h["md5"]:
            raise ValueError("a stream's MD5 differs")
        out.append((pcm ^ 0x80).tobytes())
    return out


def read_range(stream: bytes, first: int, count: int) -> bytes:
    """Samples first..first+count as payload bytes, decoding only the frames that hold them."""
    h = _metadata(stream)
    points, block = h["points"], h["block"]
    first, last = max(0, first), min(first + count, h["samples"])
    if first >= last:
        return b""
    a, z = first // block, (last - 1) // block
    offset = points["offset"].astype(np.int64)
    ends = np.append(offset[1:], len(stream) - h["frames"])
    data = np.frombuffer(stream, dtype=np.uint8)[h["frames"] + offset[a] : h["frames"] + ends[z]]
    samples = read_frames(data, offset[a : z + 1] - offset[a], (ends - offset)[a : z + 1], block).reshape(-1)
    part = samples[first - a * block : last - a * block]
    return (part.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


# ---------------------------------------------------------------- tables


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK)), len(data)


def _groups(ids, texts, chars: int = 2_000_000):
    group, size = [], 0
    for i, t in zip(ids, texts):
        payload, n = payload_of(t.as_py())
        group.append((i, payload, n))
        size += len(payload)
        if size > chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled with bytes 255 to whole blocks, as a FLAC stream.

    Null counts as empty, which is one block; repeated rows give equal streams; an empty table gives an empty result;
    other columns are ignored.
    """
    schema = to_arrow(docs.sparkSession, "doc_id long, n_bytes long, media binary")

    def run(batches):
        for b in batches:
            for g in _groups(b.column(0).to_pylist(), b.column(1)):
                yield as_batch([(i, n, s) for (i, _, n), s in zip(g, write_streams([p for _, p, _ in g]))], schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame, samples: int = 8 * BLOCK) -> DataFrame:
    """(doc_id, first_sample, n_samples, pcm): blocks of unsigned 8-bit PCM that a sample's number finds by division."""
    schema = to_arrow(media.sparkSession, "doc_id long, first_sample long, n_samples long, pcm binary")

    def run(batches):
        for b in batches:
            for i, stream in zip(b.column(0).to_pylist(), b.column(1)):
                pcm = read_streams([stream.as_py()])[0]
                yield as_batch([(i, at, len(pcm[at : at + samples]), pcm[at : at + samples]) for at in range(0, len(pcm), samples)], schema)

    return media.select("doc_id", "media").filter("media is not null").mapInArrow(run, "doc_id long, first_sample long, n_samples long, pcm binary")


def feature(payload: bytes) -> str:
    """Plain acoustic measures of the decoded samples, as integers."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"mean={int(x.sum()) // len(x)};energy={int((x * x).sum()) // len(x)};peak={int(np.abs(x).max())};crossings={crossings}"


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each row's stream, reads it back and measures what was read; see ``encode`` for odd rows."""
    columns = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )
    schema = to_arrow(docs.sparkSession, columns)

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for g in _groups(b.column(0).to_pylist(), b.column(1)):
                streams = write_streams([p for _, p, _ in g])
                read = read_streams(streams)
                yield as_batch(
                    [(i, n, len(p), sha(p), zlib.crc32(p[-32:]), len(s), sha(s), feature(p)) for (i, _, n), s, p in zip(g, streams, read)], schema
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, columns)
