"""FLAC streams of 8-bit mono samples, coded and decoded for all frames of a batch in step.

Frames are independent, so one numpy step handles one sample of every frame.
The coder picks for each frame the cheapest of constant, verbatim, fixed
predictors of low order and a quantised linear predictor; residuals are
Rice-coded.  Each stream has a seek table with the first sample and the byte
offset of every frame.  The decoder checks CRC-8 of frame headers, CRC-16 of
frames and the MD5 sum of the samples, and follows frames without a seek table
as well.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Samples in a frame, order and coefficient bits of linear predictors, the sample rate that headers state.
BLOCK, ORDER, PRECISION, RATE = 1024, 4, 12, 8000
#: Fixed predictors that the coder tries (orders 0 to 2); the decoder knows all.
TRIED = 3
#: Fixed values of the format: coefficients of the fixed predictors, latest sample first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
ESCAPE = 15


class FlacError(ValueError):
    """The stream is damaged."""


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        out[byte] = x
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


_by_distance: dict[int, np.ndarray] = {}


def crc(data: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of data[start:stop] for many ranges.

    A checksum that starts at 0 is linear: it is the exclusive or of what each
    byte adds by its distance from the range's end, and a table holds that.
    """
    length = stop - start
    deepest = int(length.max(initial=1))
    table = _by_distance.get(bits, (CRC8 if bits == 8 else CRC16).astype(np.uint16)[None, :])
    if len(table) < deepest:
        rows = [*table]
        base = CRC8 if bits == 8 else CRC16
        for _ in range(max(deepest, 64) - len(table)):
            v = rows[-1].astype(np.uint32)
            rows.append((base[v] if bits == 8 else ((v << np.uint32(8)) & np.uint32(0xFFFF)) ^ base[v >> np.uint32(8)]).astype(np.uint16))
        table = np.stack(rows)
    _by_distance[bits] = table
    out = np.zeros(len(start), np.uint32)
    some = length > 0
    n = length[some]
    total = int(n.sum())
    if total:
        ends = np.cumsum(n)
        kind = np.int32 if max(len(data), 256 * deepest + total) < 2**30 else np.int64
        within = np.arange(total, dtype=kind)
        own = data[np.repeat((start[some] - (ends - n)).astype(kind), n) + within]
        far = np.repeat((ends - 1).astype(kind), n) - within
        parts = table.ravel()[(far << 8) | own]
        out[some] = np.bitwise_xor.reduceat(parts, ends - n)
    return out


def utf8_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8 of up to 7 bytes."""
    if n < 0x80:
        return bytes([n])
    tail = 1
    while n >= 1 << (6 * tail + 6 - tail):
        tail += 1
    lead = (0xFF << (7 - tail)) & 0xFF
    return bytes([lead | (n >> (6 * tail)), *(0x80 | (n >> (6 * k)) & 0x3F for k in range(tail - 1, -1, -1))])


def put_bits(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width) -> None:
    """Write each value in ``width`` bits at its place, the high bit first."""
    width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
    for k in range(int(width.max(initial=0))):
        some = width > k
        bits[(at + width - 1 - k)[some]] = (value[some] >> k) & 1


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors (coefficients, shift) of each row by Levinson's recursion."""
    frames = len(x)
    y = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : y.shape[1] - k]) for k in range(ORDER + 1)], axis=1).astype(np.float64)
    a, error = np.zeros((frames, ORDER)), np.maximum(r[:, 0], 1e-9)
    for k in range(ORDER):
        reflect = (r[:, k + 1] - (a[:, :k] * r[:, k:0:-1]).sum(axis=1)) / error
        reflect = np.clip(reflect, -0.9999, 0.9999)
        a[:, :k] = a[:, :k] - reflect[:, None] * a[:, :k][:, ::-1]
        a[:, k] = reflect
        error = np.maximum(error * (1 - reflect**2), 1e-9)
    most = np.abs(a).max(axis=1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(most, 1e-9))), 0, 14).astype(np.int64)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32), shift.astype(np.int32)


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One FLAC stream for each range data[offsets[k]:offsets[k+1]]; no range is empty."""
    sizes = np.diff(offsets)
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = offsets[:-1][owner] + number * BLOCK
    length = np.minimum(BLOCK, offsets[1:][owner] - first)
    frames = np.empty(len(owner), object)
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        x = data[first[rows][:, None] + np.arange(n)].astype(np.int32) - 128
        for row, frame in zip(rows.tolist(), _frames(x, number[rows])):
            frames[row] = frame
    out = []
    at = 0
    for k in range(len(sizes)):
        own = frames[at : at + per[k]]
        at += per[k]
        lengths = [len(f) for f in own]
        low, high = min(lengths), max(lengths)
        info = (BLOCK).to_bytes(2, "big") * 2 + low.to_bytes(3, "big") + high.to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | int(sizes[k])).to_bytes(8, "big")
        samples = data[offsets[k] : offsets[k + 1]] ^ np.uint8(0x80)  # as signed bytes
        info += hashlib.md5(samples.tobytes()).digest()
        places = np.cumsum([0, *lengths[:-1]])
        points = np.zeros(len(own), dtype=[("sample", ">u8"), ("byte", ">u8"), ("samples", ">u2")])
        points["sample"], points["byte"] = np.arange(len(own)) * BLOCK, places
        points["samples"] = np.minimum(BLOCK, sizes[k] - np.arange(len(own)) * BLOCK)
        table = b"".join(bytes([0x83 if rest == 0 else 0x03]) + len(part).to_bytes(3, "big") + part for part, rest in _parts(points.tobytes()))
        out.append(b"fLaC" + bytes([0x00]) + len(info).to_bytes(3, "big") + info + table + b"".join(own))
    return out


def _parts(points: bytes, most: int = 18 * 900_000):
    """A metadata block holds 16 MB at most: a longer seek table takes several."""
    for a in range(0, len(points), most):
        yield points[a : a + most], max(0, len(points) - a - most)


def _frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Coded frames for rows of equally many samples."""
    frames, n = x.shape
    residuals, costs = [], []
    d = x
    for order in range(min(TRIED, n)):
        residuals.append(d)
        costs.append(np.abs(d).sum(axis=1) + 0.0)
        d = np.diff(d, axis=1)
    coefficients, shift = np.zeros((frames, ORDER), np.int32), np.zeros(frames, np.int32)
    if n >= 2 * ORDER:
        coefficients, shift = _predictors(x)
        predicted = sum(coefficients[:, k, None] * x[:, ORDER - 1 - k : n - 1 - k] for k in range(ORDER)) >> shift[:, None]
        linear = x[:, ORDER:] - predicted
        residuals.append(linear)
        costs.append(np.abs(linear).sum(axis=1) + 0.02 * n)
    choice = np.argmin(np.stack(costs), axis=0)
    order = np.where(choice == TRIED, ORDER, choice)
    rest = np.zeros((frames, n), np.int32)  # residuals, right-aligned; warm-up samples in front
    for k, own in enumerate(residuals):
        rows = choice == k
        rest[rows, n - own.shape[1] :] = own[rows]
    place = np.arange(n)[None, :]
    folded = (rest << 1) ^ (rest >> 31)
    for k in range(min(n, ORDER)):
        folded[order > k, k] = 0
    count = n - order
    mean = folded.sum(axis=1, dtype=np.int64) / np.maximum(count, 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.8, 1))), 0, 13).astype(np.int32)
    quotient = folded >> rice[:, None]
    price = quotient.sum(axis=1, dtype=np.int64) + count * (rice + 1)
    constant = (x == x[:, :1]).all(axis=1)
    lpc = (choice == TRIED) & ~constant
    overhead = np.where(lpc, 8 * ORDER + 9 + PRECISION * ORDER, 8 * order) + 10
    coded = overhead + price
    verbatim = ~constant & (coded >= 8 * n)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 3, 2)))

    heads = []
    same = n == BLOCK
    for k in number.tolist():
        head = bytes([0xFF, 0xF8, 0xA4 if same else 0x74, 0x02]) + utf8_number(k) + (b"" if same else (n - 1).to_bytes(2, "big"))
        heads.append(head)
    head_length = np.array([len(h) for h in heads])
    flat = np.frombuffer(b"".join(heads), np.uint8)
    ends = np.cumsum(head_length)
    check = crc(flat, ends - head_length, ends, 8)

    body = np.select([kind == 0, kind == 1], [np.full(frames, 8), np.full(frames, 8 * n)], coded)
    total = head_length + 1 + (8 + body + 7) // 8 + 2  # header, CRC-8, subframe, CRC-16
    start = np.cumsum(total) - total
    size = int(total.sum())
    bits = np.zeros(8 * size, np.uint8)
    byte_at = np.repeat(start - (ends - head_length), head_length) + np.arange(len(flat))
    put_bits(bits, 8 * byte_at, flat.astype(np.int64), 8)
    at = 8 * (start + head_length)
    put_bits(bits, at, check.astype(np.int64), 8)
    at = at + 8
    put_bits(bits, at, np.select([kind == 0, kind == 1, kind == 2], [0, 1, 8 + order], 32 + ORDER - 1) << 1, 8)
    at = at + 8
    put_bits(bits, at[kind == 0], (x[kind == 0, 0] & 0xFF).astype(np.int64), 8)
    whole = np.flatnonzero(kind == 1)
    at_whole = at[whole]
    some = np.flatnonzero(kind >= 2)
    at, own = at[some], order[some]
    for k in range(min(n, ORDER)):
        row = np.flatnonzero(own > k)
        put_bits(bits, at[row] + 8 * k, (x[some[row], k] & 0xFF).astype(np.int64), 8)
    at = at + 8 * own
    linear_rows = kind[some] == 3
    here = at[linear_rows]
    put_bits(bits, here, np.full(len(here), PRECISION - 1), 4)
    put_bits(bits, here + 4, shift[some][linear_rows], 5)
    for k in range(ORDER):
        put_bits(bits, here + 9 + k * PRECISION, coefficients[some][linear_rows, k] & ((1 << PRECISION) - 1), PRECISION)
    at = at + np.where(linear_rows, 9 + PRECISION * ORDER, 0)
    k_rice = rice[some]
    put_bits(bits, at + 6, k_rice.astype(np.int64), 4)  # method 0, partition order 0, then the parameter
    at = at + 10
    u = folded[some]
    width = quotient[some] + (k_rice + 1)[:, None]
    tail = (u & ((1 << k_rice) - 1)[:, None]) | (1 << k_rice)[:, None]
    for k in range(min(n, ORDER)):
        width[own > k, k] = tail[own > k, k] = 0
    stop = np.cumsum(width, axis=1, dtype=np.int64)
    stop += at[:, None]
    out = np.packbits(bits) | _packed(stop.ravel(), tail.ravel(), size)
    out[((at_whole >> 3)[:, None] + place).ravel()] = (x[whole] & 0xFF).astype(np.uint8).ravel()
    sums = crc(out, start, start + total - 2, 16)
    out[start + total - 2], out[start + total - 1] = sums >> 8, sums & 0xFF
    raw = out.tobytes()
    return [raw[a : a + b] for a, b in zip(start.tolist(), total.tolist())]


def _packed(stop: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Bytes in which each value (31 bits at most) ends before bit ``stop``; stops ascend and values don't overlap."""
    words = np.zeros(size // 4 + 2, np.uint32)
    if len(stop):
        stop = stop - 1
        last = stop >> 5
        shifted = value.astype(np.uint64) << (31 - (stop & 31)).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        words[last[first]] = np.bitwise_or.reduceat(shifted.astype(np.uint32), first)
        high = (shifted >> np.uint64(32)).astype(np.uint32)
        spilled = np.flatnonzero(high)
        words[last[spilled] - 1] |= high[spilled]
    return words.astype(">u4").view(np.uint8)[:size]


#: Codes of 16 bits or less by Rice parameter and next 16 bits: folded value * 32 + length, or 0.
_codes: dict[int, np.ndarray] = {}


def _code_table() -> np.ndarray:
    if 0 not in _codes:
        ahead = np.arange(1 << 16)
        q = 16 - np.frexp(ahead.astype(np.float64))[1]
        rows = []
        for k in range(15):
            length = q + 1 + k
            low = (ahead >> np.maximum(16 - length, 0)) & ((1 << k) - 1)
            rows.append(np.where(length <= 16, ((q << k) | low) * 32 + length, 0))
        _codes[0] = np.stack(rows).astype(np.int32).ravel()
    return _codes[0]


class _Bits:
    """Bit reader for many places at once."""

    def __init__(self, data: bytes):
        self.raw = data + bytes(16)
        self.words = np.ndarray((len(data) + 8,), ">u8", self.raw, 0, (1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place, left-aligned."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        width = np.asarray(width, np.uint64)
        value = (self.window(at) >> (np.uint64(63) - np.maximum(width, np.uint64(1)) + np.uint64(1))).astype(np.int64)
        return np.where(width > 0, value, 0)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value = self.take(at, width)
        half = np.int64(1) << (np.asarray(width, np.int64) - 1)
        return np.where(value >= half, value - 2 * half, value)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zero bits in front of the next one."""
        out = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            top = (self.window(at[live] + out[live]) >> np.uint64(32)).astype(np.float64)
            lead = 32 - np.frexp(top)[1]
            out[live] += np.where(top > 0, lead, 32)
            live = live[top == 0]
            if len(live) and int((at[live] + out[live]).max()) > 8 * len(self.raw):
                raise FlacError("a Rice code runs past the stream")
        return out


def parse(stream: bytes) -> tuple[int, int, bytes, int, np.ndarray]:
    """Block size, samples, MD5 sum, place of the first frame, and seek points (sample, byte)."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, block, total, md5, points = 4, False, 0, 0, b"", []
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 0:
            block = int.from_bytes(body[2:4], "big")
            packed = int.from_bytes(body[10:18], "big")
            total, md5 = packed & ((1 << 36) - 1), body[18:34]
            if (packed >> 36) & 31 != 7 or (packed >> 41) & 7:
                raise FlacError("only 8-bit mono is handled")
        elif kind == 3:
            found = np.frombuffer(body, dtype=[("sample", ">u8"), ("byte", ">u8"), ("samples", ">u2")])
            points.append(found[found["sample"] != 2**64 - 1])
    seek = np.concatenate(points) if points else np.zeros(0, [("sample", ">u8"), ("byte", ">u8"), ("samples", ">u2")])
    return block, total, md5, at, np.stack([seek["sample"].astype(np.int64), seek["byte"].astype(np.int64)], axis=1)


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Samples of all streams in a row (as bytes, silence 128), bounds, and each stream's (first sample, byte in the stream) of every frame."""
    raw = b"".join(streams)
    base = np.cumsum([0, *map(len, streams)])
    heads = [parse(s) for s in streams]
    bounds = np.cumsum([0, *(h[1] for h in heads)])
    out = np.zeros(int(bounds[-1]), np.int32)
    bits = _Bits(raw)
    data = np.frombuffer(raw, np.uint8)
    found: list[list[tuple[int, int]]] = [[] for _ in streams]
    # Seek points let all frames start at once; where they lack, a frame's end starts the next.
    todo = []
    for k, (block, total, _, first, points) in enumerate(heads):
        whole = len(points) == -(-total // max(block, 1)) and total
        todo += [(k, s, base[k] + first + b, True) for s, b in points.tolist()] if whole else [(k, 0, base[k] + first, False)] * bool(total)
    while todo:
        owner, sample, byte, seen = (np.array(x, np.int64) for x in zip(*todo))
        length, stop = _decode_frames(bits, data, byte, np.array([heads[k][0] for k in owner]), out, bounds[owner] + sample)
        for k, s, b in zip(owner.tolist(), sample.tolist(), (byte - base[owner]).tolist()):
            found[k].append((s, b))
        follow = (seen == 0) & (sample + length < np.array([heads[k][1] for k in owner]))
        todo = [(int(k), int(s), int(b), False) for k, s, b in zip(owner[follow], (sample + length)[follow], stop[follow])]
    pcm = (out + 128).astype(np.uint8)
    signed = pcm ^ np.uint8(0x80)
    for k, head in enumerate(heads):
        if hashlib.md5(signed[bounds[k] : bounds[k + 1]].tobytes()).digest() != head[2]:
            raise FlacError("MD5 of the samples differs")
    return pcm, bounds, [np.array(sorted(x), np.int64).reshape(-1, 2) for x in found]


def _decode_frames(bits: _Bits, data: np.ndarray, start: np.ndarray, block: np.ndarray, out: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decode the frames at ``start`` to ``out`` from ``place`` on; returns samples and end of each."""
    if ((data[start] != 0xFF) | (data[start + 1] != 0xF8)).any():
        raise FlacError("no frame sync")
    code = data[start + 2] >> 4
    lead = data[start + 4]
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    at = start + 5 + extra
    length = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7], [192, 576 << np.maximum(code.astype(np.int64) - 2, 0), bits.take(8 * at, 8) + 1, bits.take(8 * at, 16) + 1], 256 << np.maximum(code.astype(np.int64) - 8, 0))
    at = at + (code == 6) + 2 * (code == 7)
    rate = data[start + 2] & 15
    at = at + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    if (crc(data, start, at, 8) != data[at]).any():
        raise FlacError("CRC-8 of a frame header differs")
    p = 8 * (at + 1)
    kind = bits.take(p, 8) >> 1
    p = p + 8
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise FlacError("reserved subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    if (order > length).any():
        raise FlacError("a predictor of more samples than the frame has")
    most, widest = int(length.max()), max(1, int(order.max()))
    value = np.zeros((most, len(start)), np.int32)  # a row for each sample
    value[:, constant] = bits.signed(p[constant], 8)
    p[constant] += 8
    for n in np.unique(length[verbatim]).tolist():
        rows = np.flatnonzero(verbatim & (length == n))
        value[:n, rows] = data[(p[rows] >> 3) + np.arange(n)[:, None]].view(np.int8)
    p[verbatim] += 8 * length[verbatim]
    rows = np.flatnonzero(fixed | linear)
    for t in range(int(order[rows].max(initial=0))):
        some = rows[order[rows] > t]
        value[t, some] = bits.signed(p[some] + 8 * t, 8)
    p[rows] += 8 * order[rows]
    weights, shift = np.zeros((widest, len(start)), np.int64), np.zeros(len(start), np.int64)
    for o, own in enumerate(FIXED):
        some = np.flatnonzero(fixed & (order == o))
        if len(some):
            weights[:o, some] = np.array(own, np.int64).reshape(-1, 1)
    some = np.flatnonzero(linear)
    precision = bits.take(p[some], 4) + 1
    shift[some] = bits.signed(p[some] + 4, 5)
    for k in range(int(order[some].max(initial=0))):
        deep = order[some] > k
        weights[k, some[deep]] = bits.signed((p[some] + 9 + k * precision)[deep], precision[deep])
    p[some] += 9 + precision * order[some]
    plain, rows = _simple(bits, rows, p)
    if len(rows):
        _residuals(bits, rows, p, order, length, value)
        _restore(rows[order[rows] > 0], order, length, weights, shift, value)
    for o in np.unique(order[plain]).tolist():
        own = plain[order[plain] == o]
        own = own[np.argsort(-length[own], kind="stable")]
        block = _one_partition(bits, own, p, o, length[own], value[:o, own])
        if o:
            _predict(block, o, length[own], weights[:o, own], shift[own])
        _put(out, place[own], length[own], block)
    end = (p + 7) >> 3
    sums = crc(data, start, end, 16)
    if (sums != ((data[end].astype(np.uint32) << 8) | data[end + 1])).any():
        raise FlacError("CRC-16 of a frame differs")
    others = np.setdiff1d(np.arange(len(start)), plain)
    others = others[np.argsort(-length[others], kind="stable")]
    _put(out, place[others], length[others], value[:, others])
    return length, end + 2


def _residuals(bits: _Bits, rows: np.ndarray, p: np.ndarray, order: np.ndarray, length: np.ndarray, value: np.ndarray) -> None:
    """Rice-coded residuals of the frames ``rows``, a sample of each a step, any partition order."""
    method = bits.take(p[rows], 2)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    wide = np.where(method == 1, 5, 4)
    parts = np.int64(1) << bits.take(p[rows] + 2, 4)
    each = length[rows] // parts
    at = p[rows] + 6
    rice, raw, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    t = order[rows].copy()
    opened = np.zeros(len(rows), bool)
    codes = _code_table()
    live = np.arange(len(rows))
    while len(live):
        fresh = live[left[live] == 0]
        if len(fresh):
            rice[fresh] = bits.take(at[fresh], wide[fresh])
            at[fresh] += wide[fresh]
            escaped = fresh[rice[fresh] == np.where(wide[fresh] == 5, 31, ESCAPE)]
            raw[fresh] = -1
            raw[escaped] = bits.take(at[escaped], 5)
            at[escaped] += 5
            left[fresh] = np.where(opened[fresh], each[fresh], each[fresh] - order[rows[fresh]])
            opened[fresh] = True
            live = live[(left[live] > 0) | (t[live] < length[rows[live]])]
        now = live[left[live] > 0]
        coded = now[raw[now] < 0] if (raw[now] >= 0).any() else now
        if len(coded):
            here, k = at[coded], rice[coded]
            ahead = (bits.window(here) >> np.uint64(48)).astype(np.int64)
            code = codes[np.minimum(k, 14) * 65536 + ahead].astype(np.int64)
            u, n = code >> 5, code & 31
            if k.max() > 14 or not n.all():
                odd = np.flatnonzero((n == 0) | (k > 14))
                q = bits.zeros(here[odd])
                u[odd] = (q << k[odd]) | bits.take(here[odd] + q + 1, k[odd])
                n[odd] = q + 1 + k[odd]
            at[coded] = here + n
            value[t[coded], rows[coded]] = (u >> 1) ^ -(u & 1)
        plain = now[raw[now] >= 0] if len(coded) < len(now) else now[:0]
        if len(plain):
            value[t[plain], rows[plain]] = np.where(raw[plain] > 0, bits.signed(at[plain], np.maximum(raw[plain], 1)), 0)
            at[plain] += raw[plain]
        t[now] += 1
        left[now] -= 1
        live = live[t[live] < length[rows[live]]]
    p[rows] = at


def _restore(rows: np.ndarray, order: np.ndarray, length: np.ndarray, weights: np.ndarray, shift: np.ndarray, value: np.ndarray) -> None:
    for o in np.unique(order[rows]).tolist():
        own = rows[order[rows] == o]
        own = own[np.argsort(-length[own], kind="stable")]
        block = value[:, own]
        _predict(block, o, length[own], weights[:o, own], shift[own])
        value[:, own] = block


def _predict(block: np.ndarray, order: int, length: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> None:
    """Add predictions to the residuals, a sample of each frame (a column, the longest first) a step."""
    w, s = np.ascontiguousarray(weights, np.int32), shift.astype(np.int32)
    live = np.searchsorted(-length, -np.arange(int(length.max())), "left").tolist()
    for t in range(order, len(live)):
        m = live[t]
        total = w[0, :m] * block[t - 1, :m]
        for k in range(1, order):
            total += w[k, :m] * block[t - 1 - k, :m]
        total >>= s[:m]
        block[t, :m] += total


def _put(out: np.ndarray, place: np.ndarray, length: np.ndarray, block: np.ndarray) -> None:
    """Columns of a block, the longest first, to their places."""
    at = 0
    for n, many in zip(*(x.tolist() for x in np.unique(-length, return_counts=True))):
        n = -n
        out[place[at : at + many, None] + np.arange(n)] = block[:n, at : at + many].T
        at += many


def _simple(bits: _Bits, rows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames with one partition of short plain Rice codes, and the others."""
    head = bits.take(p[rows], 10)
    easy = ((head >> 4) == 0) & ((head & 15) != ESCAPE)
    return rows[easy], rows[~easy]


def _one_partition(bits: _Bits, rows: np.ndarray, p: np.ndarray, order: int, length: np.ndarray, warm: np.ndarray) -> np.ndarray:
    """Warm-up samples and residuals of simple frames of one order, the longest first; moves ``p`` behind them."""
    codes = _code_table()
    block = np.zeros((int(length.max(initial=0)), len(rows)), np.int32)
    block[:order] = warm
    rice = bits.take(p[rows] + 6, 4)
    at, page = p[rows] + 10, rice * 65536
    live = np.searchsorted(-length, -np.arange(len(block)), "left").tolist()
    words = bits.words
    for t in range(order, len(block)):
        m = live[t]
        here = at[:m]
        ahead = words[here >> 3].astype(np.uint64)
        ahead <<= (here & 7).view(np.uint64)
        ahead >>= np.uint64(48)
        code = codes[ahead.view(np.int64) + page[:m]]
        if not code.all():
            odd = np.flatnonzero(code == 0)
            q = bits.zeros(here[odd])
            u = (q << rice[odd]) | bits.take(here[odd] + q + 1, rice[odd])
            block[t, odd] = (u >> 1) ^ -(u & 1)
            at[odd] += q + 1 + rice[odd]
            even = np.flatnonzero(code)
            code = code[even]
            u = code >> 5
            block[t, even] = (u >> 1) ^ -(u & 1)
            at[even] += code & 31
            continue
        here += code & 31
        code >>= 5
        np.bitwise_xor(code >> 1, -(code & 1), out=block[t, :m])
    p[rows] = at
    return block


