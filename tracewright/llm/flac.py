"""FLAC streams of 8-bit mono samples: a vectorised encoder and decoder.

Many frames are coded in lockstep: numpy arrays hold one lane for each frame and
a step handles one sample of all lanes, so no Python loop runs over samples. The
encoder writes frames of ``BLOCK`` samples with constant or fixed-predictor
subframes and one Rice partition; the decoder also reads verbatim and LPC
subframes, wasted bits and partitioned Rice residuals with escapes, as long as
streams are mono with 8 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Samples of a frame; 192 has a block-size code of its own (1).
BLOCK = 192
RATE = 8000
HEADER = 4 + 4 + 34


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint32)
    for j in range(int(size.max(initial=0))):
        crc = np.where(j < size, _CRC8[(crc ^ rows[:, j]) & 0xFF], crc)
    return crc


def crc16(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint32)
    for j in range(int(size.max(initial=0))):
        crc = np.where(j < size, ((crc << 8) & 0xFFFF) ^ _CRC16[(crc >> 8) ^ rows[:, j]], crc)
    return crc


def _coded_number(n: int) -> bytes:
    """The frame number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.insert(0, 0x80 | (n & 0x3F))
        n >>= 6
        limit >>= 1
        if n < limit:
            return bytes([(0xFF ^ (2 * limit - 1)) & 0xFF | n, *tail])


def _header_rows(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers with their CRC-8, padded to one width, and their sizes."""
    coded = [_coded_number(int(n)) for n in np.unique(numbers)]
    width = max(map(len, coded))
    rows = np.zeros((len(coded), 5 + width), np.uint8)
    size = np.array([4 + len(x) for x in coded])
    rows[:, :4] = (0xFF, 0xF8, 0x14, 0x02)  # sync, fixed blocks; 192 samples at 8 kHz; mono, 8 bits
    for i, x in enumerate(coded):
        rows[i, 4 : 4 + len(x)] = list(x)
    rows[np.arange(len(rows)), size] = crc8(rows, size)
    back = np.searchsorted(np.unique(numbers), numbers)
    return rows[back], size[back] + 1


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of ``samples`` (lanes, BLOCK) as one byte array and the size of each frame."""
    x = samples.astype(np.int32)
    lanes = np.arange(len(x))
    diffs = [x]
    for _ in range(2):
        diffs.append(np.diff(diffs[-1], axis=1))
    cost = np.stack([np.abs(d[:, 2 - i :]).sum(1) for i, d in enumerate(diffs)])  # over the same samples
    order = cost.argmin(0)
    constant = (x == x[:, :1]).all(1)
    head, head_size = _header_rows(numbers)
    # residuals on BLOCK places; the first ``order`` are warm-up samples
    res = np.zeros_like(x)
    for i in range(3):
        pick = order == i
        res[pick, i:] = diffs[i][pick]
    folded = (res << 1) ^ (res >> 31)
    live = (np.arange(BLOCK) >= order[:, None]) & ~constant[:, None]
    folded *= live
    # the parameter whose codes are shortest is near the binary logarithm of the mean
    mean = folded.sum(1) / (BLOCK - order)
    rice = np.clip(np.floor(np.log2(0.7 * mean + 1e-9)) + 1, 0, 12).astype(np.int32)
    # layout: header | type | warm-up, a byte each | method 2, order 4, parameter 4 bits | residuals | pad | crc 16
    start = head_size * 8 + 8 + np.where(constant, 8, order * 8 + 10)
    size = ((folded >> rice[:, None]) + 1 + rice[:, None]) * live
    end = np.cumsum(size, 1, dtype=np.int64) + start[:, None]
    body = (end[:, -1] + 7) // 8
    width = int(body.max()) + 4
    rows = np.zeros((len(x), width), np.uint8)
    rows[:, : head.shape[1]] = head * (np.arange(head.shape[1]) < head_size[:, None])
    rows[lanes, head_size] = np.where(constant, 0, (8 + order) << 1)
    rows[lanes, head_size + 1] = np.where(constant | (order > 0), x[:, 0] & 0xFF, 0)
    rows[lanes, head_size + 2] = np.where(~constant & (order > 1), x[:, 1] & 0xFF, 0)
    # each code is a field of at most 13 bits after its zeros: method 0, order 0 and the parameter are one more
    coded = ~constant
    value = np.concatenate((rice[coded], ((1 << rice[:, None]) | (folded & ((1 << rice[:, None]) - 1)))[live]))
    count = np.concatenate((np.full(coded.sum(), 10), np.broadcast_to(rice[:, None] + 1, live.shape)[live]))
    from_ = np.concatenate((start[coded], end[live])) - count
    place = np.concatenate((lanes[coded], np.broadcast_to(lanes[:, None], live.shape)[live])) * width + (from_ >> 3)
    field = value.astype(np.int64) << (24 - (from_ & 7) - count)
    flat = np.zeros(rows.size + 2)
    for j in range(3):  # fields do not overlap, so sums are unions
        flat[j : j + rows.size] += np.bincount(place, (field >> (16 - 8 * j)) & 0xFF, rows.size)
    rows += flat[: rows.size].astype(np.uint8).reshape(rows.shape)
    crc = crc16(rows, body)
    rows[lanes, body] = crc >> 8
    rows[lanes, body + 1] = crc & 0xFF
    size = body + 2
    return rows[np.arange(width) < size[:, None]], size


def stream_header(payload: bytes, frames: np.ndarray) -> bytes:
    """Marker and STREAMINFO, with the MD5 of the signed samples, of a stream."""
    count = len(payload)
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = BLOCK.to_bytes(2, "big") * 2 + int(frames.min()).to_bytes(3, "big") + int(frames.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | count).to_bytes(8, "big") + hashlib.md5(signed).digest()
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info


class Bits:
    """Big-endian bit readers over one byte array, one position for each lane."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
        n = len(data) + 8
        self.words = np.zeros(n, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + n] << np.uint64(56 - 8 * j)
        self.at = at.astype(np.int64) * 8

    def peek(self) -> np.ndarray:
        """The next 57 bits or more, from the top of a word."""
        return self.words[np.minimum(self.at >> 3, len(self.words) - 1)] << (self.at & 7).astype(np.uint64)

    def take(self, count: np.ndarray | int, use: np.ndarray | None = None) -> np.ndarray:
        """``count`` bits (at most 32) of each lane that is used, else 0."""
        n = np.broadcast_to(np.asarray(count, np.int64), self.at.shape)
        if use is not None:
            n = np.where(use, n, 0)
        value = np.where(n > 0, self.peek() >> (64 - np.maximum(n, 1)).astype(np.uint64), 0).astype(np.int64)
        self.at += n
        return value

    def unary(self, use: np.ndarray) -> np.ndarray:
        """The zeros before the next one bit, which is read too."""
        total = np.zeros(len(self.at), np.int64)
        open_ = use.copy()
        while open_.any():
            word = self.peek() >> np.uint64(32)
            zeros = 32 - np.frexp(word.astype(np.float64))[1].astype(np.int64)
            ends = open_ & (word != 0)
            step = np.where(open_, zeros, 0) + ends
            if (self.at[open_] >> 3 >= len(self.words)).any():
                raise ValueError("FLAC: a residual runs past the stream")
            total += np.where(open_, zeros, 0)
            self.at += step
            open_ &= ~ends
        return total


    def rice(self, parameter: np.ndarray, use: np.ndarray) -> np.ndarray:
        """One Rice code of each lane that is used, else 0."""
        word = self.peek()
        top = (word >> np.uint64(32)).astype(np.float64)
        zeros = 32 - np.frexp(top)[1].astype(np.int64)
        size = zeros + 1 + parameter
        if (use & ((top == 0) | (size > 56))).any():
            return (self.unary(use) << np.where(use, parameter, 0)) | self.take(parameter, use)
        low = (word << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - parameter).astype(np.uint64)
        self.at += size * use
        return ((zeros << parameter) | low.astype(np.int64)) * use


def _signed(value: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = np.int64(1) << (np.asarray(bits, np.int64) - 1)
    return np.where(value >= half, value - 2 * half, value)


def decode_frames(data: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (lanes, BLOCK) of the frames that start at bytes ``at``, and where each ends.

    ``first``: the frame number each must carry. Raises ValueError for a bad
    sync code, number, subframe or checksum.
    """
    bits = Bits(data, at)
    if (bits.take(32) != 0xFFF81402).any():
        raise ValueError("FLAC: not a frame of this profile")
    lead = bits.take(8)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(int(more.max(initial=0))):
        number = np.where(j < more, (number << 6) | (bits.take(8, j < more) & 0x3F), number)
    if (number != first).any():
        raise ValueError("FLAC: frames out of order")
    head = bits.at // 8 - at
    if (crc8(data[at[:, None] + np.arange(int(head.max(initial=0)))], head) != bits.take(8)).any():
        raise ValueError("FLAC: header checksum")
    kind = bits.take(8)
    wasted = np.zeros(len(at), np.int64)
    has = (kind & 1) == 1
    if has.any():
        wasted = np.where(has, bits.unary(has) + 1, 0)
    kind >>= 1
    depth = 8 - wasted
    constant, verbatim = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise ValueError("FLAC: reserved subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, np.where(verbatim, BLOCK, 0)))
    x = np.zeros((BLOCK, len(at)), np.int64)
    for j in range(int(order.max(initial=0))):
        x[j] = np.where(j < order, _signed(bits.take(depth, j < order), depth), 0)
    if constant.any():
        value = _signed(bits.take(depth, constant), depth)
        x[:, constant] = value[constant]
    coef = np.zeros((len(at), max(4, int(order[lpc].max(initial=0)))), np.int64)
    for i, row in enumerate(((0,), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))):
        coef[fixed & (order == i), : len(row)] = row
    shift = np.zeros(len(at), np.int64)
    if lpc.any():
        precision = bits.take(4, lpc) + 1
        shift = np.where(lpc, bits.take(5, lpc), 0)
        for j in range(int(order[lpc].max())):
            use = lpc & (j < order)
            coef[:, j] = np.where(use, _signed(bits.take(precision, use), precision), coef[:, j])
    coded = fixed | lpc
    method = bits.take(2, coded)
    parts = bits.take(4, coded)
    wide = np.where(method == 1, 5, 4)
    per = BLOCK >> parts
    rice, escape = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    raw = np.zeros(len(at), np.int64)
    taps = int(np.max(order, where=coded, initial=0))
    coef = np.ascontiguousarray(coef.T)
    quick = bool((parts[coded] == 0).all())
    for j in range(BLOCK):
        new = coded & (j % per == 0) if j == 0 or not quick else None
        if new is not None and new.any():
            rice = np.where(new, bits.take(wide, new), rice)
            escape = np.where(new, rice == (1 << wide) - 1, escape)
            if (new & escape).any():
                raw = np.where(new & escape, bits.take(5, new & escape), raw)
            some_escape = bool((escape & coded).any())
        use = coded & (j >= order)
        if not use.any():
            continue
        plain = use & ~escape if some_escape else use
        value = bits.rice(rice, plain)
        value = (value >> 1) ^ -(value & 1)
        if some_escape and (use & escape).any():
            value = np.where(use & escape, np.where(raw > 0, _signed(bits.take(raw, use & escape), np.maximum(raw, 1)), 0), value)
        guess = np.zeros(len(at), np.int64)
        for i in range(min(taps, j)):
            guess += coef[i] * x[j - 1 - i]
        x[j] = np.where(use, (guess >> shift) + value, x[j])
    end = (bits.at + 7) // 8
    size = end - at
    rows = data[np.minimum(at[:, None] + np.arange(int(size.max(initial=0))), len(data) - 1)]
    bits.at = end * 8
    if (crc16(rows, size) != bits.take(16)).any():
        raise ValueError("FLAC: frame checksum")
    return (x << wasted).T, end + 2
