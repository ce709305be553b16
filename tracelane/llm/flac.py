"""FLAC streams of one channel, many frames at a time: every step works on one sample of all frames."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

#: Samples per frame that the encoder writes; the format has a code of its own for it.
BLOCK = 192
RATE = 8000
#: Quantised predictor coefficients have so many bits and this shift.
PRECISION, SHIFT = 8, 6
_FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


class FlacError(ValueError):
    """A stream that is damaged or outside what is read here."""


@functools.lru_cache(maxsize=2)
def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = ((value << 1) ^ polynomial if value & top else value << 1) & mask
        out.append(value)
    return np.array(out, np.uint32)


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, polynomial: int) -> np.ndarray:
    """Of the bytes of every range."""
    table = _crc_table(bits, polynomial)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that the live ones are a prefix
    starts, sizes = starts[order], (ends - starts)[order]
    crc = np.zeros(len(starts), np.uint32)
    live = len(starts) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), "right")
    for i, n in enumerate(live):
        own = crc[:n]
        crc[:n] = table[(own >> np.uint32(bits - 8)) ^ data[starts[:n] + i]] ^ ((own << np.uint32(8)) & np.uint32((1 << bits) - 1))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def crc8(data, starts, ends):
    return _crc(data, starts, ends, 8, 0x07)


def crc16(data, starts, ends):
    return _crc(data, starts, ends, 16, 0x8005)


# ---- writing ---------------------------------------------------------------------------------------------------


def _number_sizes(numbers: np.ndarray) -> np.ndarray:
    """Bytes of a frame number in the header's variable-length code."""
    return 1 + (numbers >= 1 << 7) + (numbers >= 1 << 11) + (numbers >= 1 << 16) + (numbers >= 1 << 21)


def _fold(residual: np.ndarray) -> np.ndarray:
    return (residual << 1) ^ (residual >> 31)


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded residuals, parameter of each frame, bits of all its codes)."""
    u = _fold(residual)
    n = u.shape[1]
    guess = np.clip(np.frexp(u.mean(axis=1) + 1)[1] - 1, 0, 13).astype(np.int32)
    best, bits = guess, (u >> guess[:, None]).sum(axis=1) + n * (guess + 1)
    lower = np.maximum(guess - 1, 0)
    other = (u >> lower[:, None]).sum(axis=1) + n * (lower + 1)
    better = other < bits
    return u, np.where(better, lower, best), np.where(better, other, bits)


def _predictor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two quantised coefficients for each frame by least squares, and whether there are any."""
    f = x.astype(np.float64)
    a0, a1, a2 = (f * f).sum(axis=1), (f[:, 1:] * f[:, :-1]).sum(axis=1), (f[:, 2:] * f[:, :-2]).sum(axis=1)
    den = a0 * a0 - a1 * a1
    ok = den > 1e-6 * a0 * a0
    den = np.where(ok, den, 1)
    c = np.stack([a1 * (a0 - a2) / den, (a0 * a2 - a1 * a1) / den], axis=1)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(np.where(ok[:, None], c, 0) * (1 << SHIFT)), -top - 1, top).astype(np.int32), ok


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray | int, width: int) -> None:
    for j in range(width):
        bits[at + (width - 1 - j)] = (value >> j) & 1


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of one frame for each row of BLOCK signed 8-bit samples.

    Of a constant, fixed predictors of order 0 and 1, a linear predictor of order 2, and plain samples, each frame takes
    the shortest.
    """
    x = samples.astype(np.int32)
    rows = len(x)
    flat = x[:, 0]
    constant = (x == flat[:, None]).all(axis=1)
    coefficients, fitted = _predictor(x)
    predicted = (coefficients[:, :1] * x[:, 1:-1] + coefficients[:, 1:] * x[:, :-2]) >> SHIFT
    options = [_rice(x), _rice(np.diff(x, axis=1)), _rice(x[:, 2:] - predicted)]
    heads = [10, 8 + 10, 16 + 4 + 5 + 2 * PRECISION + 10]
    sizes = np.stack([o[2] + h for o, h in zip(options, heads, strict=True)] + [np.full(rows, 8 * BLOCK)], axis=1)
    sizes[~fitted, 2] = 1 << 40
    kind = sizes.argmin(axis=1)
    body = np.where(constant, 8, sizes[np.arange(rows), kind])
    kind = np.where(constant, 4, kind)
    head = 5 + _number_sizes(numbers)
    lengths = head + 1 + -(-body // 8) + 2
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    start = offsets[:-1]
    bits = np.zeros(int(offsets[-1]) * 8, np.uint8)
    at = (start + head) * 8
    # The type of a subframe: 0 constant, 1 plain, 8 + order fixed, 31 + order linear.
    _put(bits, at, np.choose(kind, [8, 9, 33, 1, 0]) << 1, 8)
    at = at + 8
    _put(bits, at[constant], flat[constant] & 255, 8)
    plain = np.flatnonzero(kind == 3)
    if len(plain):
        _put(bits, at[plain, None] + 8 * np.arange(BLOCK), x[plain] & 255, 8)
    for which, warm in ((0, 0), (1, 1), (2, 2)):
        own = np.flatnonzero(kind == which)
        if not len(own):
            continue
        for i in range(warm):
            _put(bits, at[own] + 8 * i, x[own, i] & 255, 8)
        here = at[own] + 8 * warm
        if which == 2:
            _put(bits, here, PRECISION - 1, 4)
            _put(bits, here + 4, SHIFT, 5)
            for i in range(2):
                _put(bits, here + 9 + PRECISION * i, coefficients[own, i] & ((1 << PRECISION) - 1), PRECISION)
            here = here + 9 + 2 * PRECISION
        u, k, _ = options[which]
        _put(bits, here + 6, k[own], 4)  # method 0, partition order 0
        for parameter in np.unique(k[own]):
            mine = k[own] == parameter
            code = u[own[mine]]
            ends = here[mine, None] + 10 + np.cumsum((code >> parameter) + (parameter + 1), axis=1)
            bits[ends - 1 - parameter] = 1
            for j in range(parameter):
                bits[ends - 1 - j] = (code >> j) & 1
    out = np.packbits(bits)
    out[start], out[start + 1], out[start + 2], out[start + 3] = 0xFF, 0xF8, (1 << 4) | 4, 1 << 1
    number_size = head - 5
    for size in np.unique(number_size):
        own = np.flatnonzero(number_size == size)
        if size == 1:
            out[start[own] + 4] = numbers[own]
            continue
        lead = (0xFF00 >> size) & 0xFF
        out[start[own] + 4] = lead | (numbers[own] >> (6 * (size - 1)))
        for i in range(1, size):
            out[start[own] + 4 + i] = 0x80 | ((numbers[own] >> (6 * (size - 1 - i))) & 0x3F)
    out[start + head - 1] = crc8(out, start, start + head - 1)
    check = crc16(out, start, offsets[1:] - 2)
    out[offsets[1:] - 2], out[offsets[1:] - 1] = check >> 8, check & 0xFF
    return out, offsets


def stream_header(samples: int, smallest: int, largest: int, digest: bytes) -> bytes:
    """Marker and STREAMINFO of a stream of 8-bit samples; ``digest``: MD5 of the signed samples."""
    packed = (RATE << 44) | (0 << 41) | (7 << 36) | samples
    return b"fLaC\x80\x00\x00\x22" + BLOCK.to_bytes(2, "big") * 2 + smallest.to_bytes(3, "big") + largest.to_bytes(3, "big") + packed.to_bytes(8, "big") + digest


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload of unsigned bytes, a multiple of BLOCK long."""
    sizes = np.array([len(p) // BLOCK for p in payloads], np.int64)
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    ends = np.cumsum(sizes)
    frames, offsets = encode_frames(samples, np.arange(len(samples)) - np.repeat(ends - sizes, sizes))
    lengths = np.diff(offsets)
    out = []
    for a, b in zip(ends - sizes, ends, strict=True):
        own = lengths[a:b]
        digest = hashlib.md5(samples[a:b].tobytes()).digest()
        out.append(stream_header(int(b - a) * BLOCK, int(own.min()), int(own.max()), digest) + frames[offsets[a] : offsets[b]].tobytes())
    return out


# ---- reading ---------------------------------------------------------------------------------------------------


class _Words:
    """Big-endian 64-bit words at every byte, so that up to 57 bits can be read from any bit."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            self.words |= padded[i : i + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * i)

    def at(self, bit: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(bit >> 3, len(self.words) - 1)] << (bit & 7).astype(np.uint64)

    def unsigned(self, bit: np.ndarray, width: int) -> np.ndarray:
        return (self.at(bit) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(bit), np.int64)

    def signed(self, bit: np.ndarray, width: int) -> np.ndarray:
        return self.at(bit).view(np.int64) >> np.int64(64 - width) if width else np.zeros(len(bit), np.int64)


def stream_info(data: np.ndarray) -> tuple[int, int, bytes]:
    """(where the first frame begins, samples, MD5 of the samples) by the metadata; 0 and zero bytes mean unknown."""
    if data[:4].tobytes() != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, samples, digest = 4, False, 0, bytes(16)
    while not last:
        size = int.from_bytes(data[at + 1 : at + 4].tobytes(), "big")
        if at + 4 + size > len(data):
            raise FlacError("metadata is cut off")
        last, kind = bool(data[at] & 0x80), int(data[at] & 0x7F)
        if kind == 0 and size >= 34:
            samples = int.from_bytes(data[at + 14 : at + 22].tobytes(), "big") & ((1 << 36) - 1)
            digest = data[at + 22 : at + 38].tobytes()
        at += 4 + size
    return at, samples, digest


def _whole(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the last two bytes of each range are its CRC-16."""
    long = end - start > 6
    out = np.zeros(len(start), bool)
    begin, stop = start[long], end[long]
    out[long] = crc16(data, begin, stop - 2) == ((data[stop - 2].astype(np.uint32) << 8) | data[stop - 1])
    return out


def frame_starts(data: np.ndarray) -> np.ndarray:
    """Offsets of the frames of one stream: sync code, header checksum and running number, settled by the frames' CRC-16.

    Samples may look like a header, so where neighbouring candidates do not fit, each frame is followed to the first
    candidate at which its checksum is right.
    """
    at = stream_info(data)[0]
    body = data[at:]
    some = np.flatnonzero((body[:-6] == 0xFF) & (body[1:-5] == 0xF8)) + at if len(body) > 6 else np.zeros(0, np.int64)
    head = _headers(data, some)
    some, number = some[head["ok"]], head["number"][head["ok"]]
    if not len(some) or some[0] != at:
        raise FlacError("no frame where the first one belongs")
    ends = np.append(some[1:], len(data))
    if np.array_equal(number, np.arange(len(some))) and _whole(data, some, ends).all():
        return some
    kept, place = [0], 0
    while True:
        later = np.append(np.flatnonzero(number[place + 1 :] == len(kept)) + place + 1, len(some))
        stops = np.append(some, len(data))[later]
        right = next((i for i, stop in zip(later, stops, strict=True) if _whole(data, some[place : place + 1], np.array([stop]))[0]), None)
        if right is None:
            raise FlacError("a frame's checksum is wrong")
        if right == len(some):
            return some[np.array(kept)]
        kept.append(int(right))
        place = int(right)


def _all_starts(data: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """Offsets in ``data`` of the frames of each stream data[base[i]:base[i + 1]], with one pass over the checksums of all.

    Streams whose candidates do not fit their neighbours are followed frame by frame (``frame_starts``).
    """
    begin = np.array([a + stream_info(data[a:b])[0] for a, b in zip(base[:-1], base[1:], strict=True)], np.int64)
    some = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))
    stream = np.searchsorted(base, some, "right") - 1
    inside = (some >= begin[stream]) & (some + 6 < base[stream + 1])
    some, stream = some[inside], stream[inside]
    head = _headers(data, some)
    good = head["ok"] & (some + head["head"] <= base[stream + 1])
    some, stream, number = some[good], stream[good], head["number"][good]
    places = np.searchsorted(stream, np.arange(len(base)))
    last = np.append(stream[1:] != stream[:-1], True)[: len(stream)]
    ends = np.where(last, base[stream + 1], np.append(some[1:], len(data))[: len(some)])
    right = (number == np.arange(len(some)) - places[stream]) & _whole(data, some, ends)
    wrong = np.bincount(stream[~right], minlength=len(begin)) > 0
    out = []
    for i, (a, b) in enumerate(zip(places[:-1].tolist(), places[1:].tolist(), strict=True)):
        settled = b > a and some[a] == begin[i] and not wrong[i]
        out.append(some[a:b] if settled else frame_starts(data[base[i] : base[i + 1]]) + base[i])
    return out


def _headers(data: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of the frame headers at ``start``, and whether their checksum is right."""
    n = len(data)
    byte = lambda i: data[np.minimum(start + i, n - 1)].astype(np.int64)
    size_code, rate_code, channels, depth_code = byte(2) >> 4, byte(2) & 15, byte(3) >> 4, (byte(3) >> 1) & 7
    first = byte(4)
    number_size = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0) + (first >= 0xF8)
    number = np.where(number_size == 1, first, first & ((1 << np.maximum(7 - number_size, 0)) - 1))
    for i in range(1, 5):
        number = np.where(number_size > i, (number << 6) | (data[np.minimum(start + 4 + i, n - 1)] & 0x3F), number)
    after = 4 + number_size
    one, two = data[np.minimum(start + after, n - 1)].astype(np.int64), data[np.minimum(start + after + 1, n - 1)].astype(np.int64)
    block = np.select([size_code == 1, size_code == 6, size_code == 7, size_code >= 8, size_code >= 2], [np.full(len(start), 192), one + 1, (one << 8) + two + 1, 256 << np.maximum(size_code - 8, 0), 576 << np.clip(size_code - 2, 0, 3)], 0)
    head = after + (size_code == 6) + 2 * (size_code == 7) + (rate_code == 12) + 2 * ((rate_code == 13) | (rate_code == 14)) + 1
    ok = (start + head <= n) & (block > 0) & (rate_code != 15) & ((first < 0x80) | (first >= 0xC0)) & (first < 0xFC)
    ends = np.where(ok, start + head - 1, start)
    ok &= crc8(data, start, ends) == data[np.minimum(ends, n - 1)]
    return {"block": block, "head": head, "channels": channels, "depth": np.array([0, 8, 12, 0, 16, 20, 24, 32])[depth_code], "number": number, "ok": ok}


def block_sizes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _headers(data, start)["block"]


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Samples (int64) of each frame. Checksums of header and frame are verified."""
    head = _headers(data, start)
    if not head["ok"].all():
        raise FlacError("a frame header's checksum is wrong")
    if not np.array_equal(crc16(data, start, end - 2), (data[end - 2].astype(np.uint32) << 8) | data[end - 1]):
        raise FlacError("a frame's checksum is wrong")
    return _decode_checked(data, start, head)


def _decode_checked(data: np.ndarray, start: np.ndarray, head: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Samples (int64) of frames whose checksums are right, ``head`` their headers."""
    if (head["channels"] != 0).any() or not np.isin(head["depth"], (8, 16)).all():
        raise FlacError("only one channel of 8 or 16 bits is read")
    words = _Words(data)
    out: list[np.ndarray] = [None] * len(start)  # type: ignore[list-item]
    shape = head["block"] * 32 + head["depth"]
    for one in np.unique(shape):
        own = np.flatnonzero(shape == one)
        for i, samples in zip(own, _subframes(words, (start[own] + head["head"][own]) * 8, int(one // 32), int(one % 32)), strict=True):
            out[i] = samples
    return out


def _subframes(words: _Words, bit: np.ndarray, block: int, depth: int) -> np.ndarray:
    """Samples [frame, block] of subframes that begin at ``bit``; low bits that all samples lack are put back."""
    kind = words.unsigned(bit, 8)
    if (kind & 0x80).any():
        raise FlacError("a subframe begins with a set bit")
    wasted = np.where(kind & 1, 65 - np.frexp(words.at(bit + 8).astype(np.float64))[1].astype(np.int64), 0)
    if (wasted >= depth).any():
        raise FlacError("a subframe has no bits left")
    out = np.zeros((len(bit), block), np.int64)
    for w in np.unique(wasted).tolist():
        own = np.flatnonzero(wasted == w)
        out[own] = _samples(words, kind[own] >> 1, bit[own] + 8 + w, block, depth - w) << w
    return out


def _samples(words: _Words, kind: np.ndarray, bit: np.ndarray, block: int, depth: int) -> np.ndarray:
    """Samples [frame, block] of subframes of a kind whose content begins at ``bit``."""
    out = np.zeros((block, len(bit)), np.int64)
    constant, plain = kind == 0, kind == 1
    out[:, constant] = words.signed(bit[constant], depth)
    if plain.any():
        for i in range(block):
            out[i, plain] = words.signed(bit[plain] + depth * i, depth)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | plain | fixed | linear).all():
        raise FlacError("a reserved kind of subframe")
    coded = np.flatnonzero(fixed | linear)
    if not len(coded):
        return out.T
    bit, order = bit[coded], np.where(linear, kind - 31, kind - 8)[coded]
    linear = linear[coded]
    most = int(order.max())
    if most > block:
        raise FlacError("a predictor is longer than its frame")
    lanes = len(coded)
    coefficients, shift = np.zeros((most, lanes), np.int64), np.zeros(lanes, np.int64)
    x = np.zeros((block, lanes), np.int64)
    for i in range(most):
        warm = order > i
        x[i, warm] = words.signed(bit[warm] + depth * i, depth)
    bit = bit + depth * order
    for o, weights in _FIXED.items():
        for i, w in enumerate(weights[:most]):
            coefficients[i, ~linear & (order == o)] = w
    if linear.any():
        own = np.flatnonzero(linear)
        precision = words.unsigned(bit[own], 4) + 1
        shift[own] = words.signed(bit[own] + 4, 5)
        if (shift < 0).any() or (precision == 16).any():
            raise FlacError("a predictor's scale is not allowed")
        for p in np.unique(precision):
            mine = own[precision == p]
            for i in range(most):
                use = mine[order[mine] > i]
                coefficients[i, use] = words.signed(bit[use] + 9 + int(p) * i, int(p))
        bit[own] += 9 + precision * order[own]
    method, parts = words.unsigned(bit, 2), words.unsigned(bit + 2, 4)
    if (method > 1).any():
        raise FlacError("a reserved coding of residuals")
    width = (4 + method).astype(np.uint64)
    bit = bit + 6
    step = block >> parts  # samples per partition; the first one is without the warm-up
    k = np.zeros(lanes, np.uint64)
    plain_bits = np.full(lanes, -1, np.int64)  # width of residuals that stand as they are, -1 where they are coded
    single = not parts.any()
    after = coefficients.any(axis=1)
    for i in range(block):
        if i == 0 or not single:
            new = np.flatnonzero(i % step == 0)
            if len(new):
                k[new] = words.at(bit[new]) >> (np.uint64(64) - width[new])
                bit[new] += width[new].astype(np.int64)
                escaped = k[new] == (np.uint64(1) << width[new]) - np.uint64(1)
                plain_bits[new] = -1
                if escaped.any():
                    own = new[escaped]
                    plain_bits[own] = words.unsigned(bit[own], 5)
                    k[own] = 0
                    bit[own] += 5
        live = slice(None) if i >= most else np.flatnonzero(order <= i)
        at, own_k = bit[live].copy(), k[live]
        word = words.at(at)
        own_plain = plain_bits[live]
        zeros = np.where(own_plain >= 0, 0, 32 - np.frexp((word >> np.uint64(32)).astype(np.float64))[1].astype(np.int64))
        if (long := np.flatnonzero(zeros > 24)).size:  # long unary parts are read in several steps
            total = np.zeros(len(long), np.int64)
            place, open_ = at[long].copy(), np.arange(len(long))
            while len(open_):
                lead = 32 - np.frexp((words.at(place[open_]) >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
                take = np.minimum(lead, 24)
                total[open_] += take
                place[open_] += take
                if (place >> 3 > len(words.words)).any():
                    raise FlacError("residuals run past the end")
                open_ = open_[lead > 24]
            zeros[long] = total
            word = word.copy()
            word[long] = words.at(place)
            lead = np.where(zeros > 24, 0, zeros)
            lead[long] = 0
        else:
            lead = zeros
        low = (word << (lead + 1).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - own_k)
        u = (zeros.astype(np.uint64) << own_k) | low
        residual = (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)
        bit[live] = at + zeros + 1 + own_k.view(np.int64)
        if (raw := np.flatnonzero(own_plain >= 0)).size:
            wide = own_plain[raw]
            value = words.at(at[raw]).view(np.int64) >> np.minimum(64 - wide, 63)
            residual[raw] = np.where(wide > 0, value, 0)
            bit[np.arange(lanes)[live][raw]] = at[raw] + wide
        if most:
            sum_ = np.zeros(lanes, np.int64)
            for j in range(min(most, i)):
                if after[j]:
                    sum_ += coefficients[j] * x[i - 1 - j]
            residual = residual + (sum_ >> shift)[live]
        x[i, live] = residual
    out[:, coded] = x
    return out.T


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each stream its samples, and the sample offset of each of its frames.

    Checksums of headers and frames, and the number of samples and their MD5 where the stream tells them, are verified.
    """
    if not streams:
        return []
    views = [np.frombuffer(s, np.uint8) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(v) for v in views])]).astype(np.int64)
    whole = np.concatenate(views)
    starts = _all_starts(whole, base)
    first = np.concatenate(starts)
    head = _headers(whole, first)
    frames, depths = _decode_checked(whole, first, head), head["depth"]
    out, at = [], 0
    for own, view in zip(starts, views, strict=True):
        mine = frames[at : at + len(own)]
        samples = np.concatenate(mine)
        _, count, digest = stream_info(view)
        if count and count != len(samples):
            raise FlacError(f"the stream has {len(samples)} of {count} samples")
        kind = np.int8 if depths[at] == 8 else np.dtype("<i2")
        if any(digest) and hashlib.md5(samples.astype(kind).tobytes()).digest() != digest:
            raise FlacError("the samples' MD5 is wrong")
        at += len(own)
        out.append((samples, np.concatenate([[0], np.cumsum([len(f) for f in mine])[:-1]])))
    return out
