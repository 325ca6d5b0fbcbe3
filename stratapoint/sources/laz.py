"""Compressed LAS points (chunked, pointwise; point formats 0 to 3, extra bytes included), by an adaptive arithmetic coder.

A chunk is coded by itself: its first point stands as it is, all others as differences to what is known. One description of a
point's coding serves both directions: a coder is asked for the next symbol and, when it writes, told which one it is.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from stratapoint.errors import FormatNotSupported

# Fixed values of the coder: least length of the interval, and precisions of the models.
LEAST, FULL = 1 << 24, (1 << 32) - 1
SYMBOL_SHIFT, BIT_SHIFT = 15, 13
# Fixed values of the format: the record that describes the coding, its kind with chunks, and the parts a point is made of.
RECORD, CHUNKED = 22204, 2
BYTES, POINT, TIME, COLOUR = 0, 6, 7, 8
VARIABLE = (1 << 32) - 1
# The context of a return, by the number of returns (row) and the return's own (column).
RETURNS = (
    (15, 14, 13, 12, 11, 10, 9, 8), (14, 0, 1, 3, 6, 10, 10, 9), (13, 1, 2, 4, 7, 11, 11, 10), (12, 3, 4, 5, 8, 12, 12, 11),
    (11, 6, 7, 8, 9, 13, 13, 12), (10, 10, 11, 12, 13, 14, 14, 13), (9, 10, 11, 12, 13, 14, 15, 14), (8, 9, 10, 11, 12, 13, 14, 15),
)
# Times are told as multiples of the last difference, down to LOWEST and up to HIGHEST, or by a code beyond.
HIGHEST, LOWEST = 500, -10
UNCHANGED, WHOLE_TIME, TIME_CODES = HIGHEST - LOWEST + 1, HIGHEST - LOWEST + 2, HIGHEST - LOWEST + 6


class Symbols:
    """Frequencies of symbols, renewed at growing intervals."""

    def __init__(self, n: int) -> None:
        self.n, self.counts, self.total, self.cycle = n, [1] * n, 0, n
        self._renew()
        self.left = self.cycle = (n + 6) >> 1

    def _renew(self) -> None:
        self.total += self.cycle
        if self.total > 1 << SYMBOL_SHIFT:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            self.total = sum(self.counts)
        scale, below, self.starts = 0x80000000 // self.total, 0, []
        for c in self.counts:
            self.starts.append((scale * below) >> (31 - SYMBOL_SHIFT))
            below += c
        self.cycle = min((5 * self.cycle) >> 2, (self.n + 6) << 3)
        self.left = self.cycle

    def seen(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self.left -= 1
        if not self.left:
            self._renew()


class Bit:
    def __init__(self) -> None:
        self.zeros, self.total, self.start, self.cycle, self.left = 1, 2, 1 << (BIT_SHIFT - 1), 4, 4

    def seen(self, bit: int) -> None:
        self.zeros += not bit
        self.left -= 1
        if self.left:
            return
        self.total += self.cycle
        if self.total > 1 << BIT_SHIFT:
            self.total, self.zeros = (self.total + 1) >> 1, (self.zeros + 1) >> 1
            self.total += self.zeros == self.total
        self.start = (self.zeros * (0x80000000 // self.total)) >> (31 - BIT_SHIFT)
        self.cycle = self.left = min((5 * self.cycle) >> 2, 64)


class Reader:
    writes = False

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.length = data, at + 4, FULL
        self.value = int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big")

    def _renew(self) -> None:
        while self.length < LEAST:
            self.value = (self.value << 8) | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.length <<= 8

    def symbol(self, m: Symbols, _: int | None = None) -> int:
        end, self.length = self.length, self.length >> SYMBOL_SHIFT
        s = bisect_right(m.starts, self.value // self.length) - 1
        start = m.starts[s] * self.length
        if s + 1 < m.n:
            end = m.starts[s + 1] * self.length
        self.value -= start
        self.length = end - start
        self._renew()
        m.seen(s)
        return s

    def bit(self, m: Bit, _: int | None = None) -> int:
        start = m.start * (self.length >> BIT_SHIFT)
        b = int(self.value >= start)
        if b:
            self.value -= start
            self.length -= start
        else:
            self.length = start
        self._renew()
        m.seen(b)
        return b

    def bits(self, n: int, _: int | None = None) -> int:
        if n > 19:
            low = self.bits(16)
            return low | (self.bits(n - 16) << 16)
        self.length >>= n
        v = self.value // self.length
        self.value -= v * self.length
        self._renew()
        return v


class Writer:
    writes = True

    def __init__(self) -> None:
        self.out, self.base, self.length = bytearray(), 0, FULL

    def _move(self, by: int, length: int) -> None:
        self.base += by
        if self.base > FULL:
            self.base &= FULL
            k = len(self.out) - 1
            while self.out[k] == 255:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
        self.length = length
        while self.length < LEAST:
            self.out.append(self.base >> 24)
            self.base = (self.base << 8) & FULL
            self.length <<= 8

    def symbol(self, m: Symbols, s: int) -> int:
        part = self.length >> SYMBOL_SHIFT
        start = m.starts[s] * part
        self._move(start, (m.starts[s + 1] * part if s + 1 < m.n else self.length) - start)
        m.seen(s)
        return s

    def bit(self, m: Bit, b: int) -> int:
        start = m.start * (self.length >> BIT_SHIFT)
        self._move(start if b else 0, self.length - start if b else start)
        m.seen(b)
        return b

    def bits(self, n: int, v: int) -> int:
        if n > 19:
            self.bits(16, v & 0xFFFF)
            self.bits(n - 16, v >> 16)
            return v
        self._move((self.length >> n) * v, self.length >> n)
        return v

    def done(self) -> bytes:
        self._move(*((LEAST, LEAST >> 1) if self.length > 2 * LEAST else (LEAST >> 1, LEAST >> 9)))
        return bytes(self.out) + b"\0\0\0"


class Whole:
    """Whole numbers of some bits as corrections of a guess: how many bits the correction has, then its value."""

    def __init__(self, bits: int, contexts: int = 1, high: int = 8) -> None:
        self.width, self.high, self.k = bits, high, 0
        self.sizes = [Symbols(bits + 1) for _ in range(contexts)]
        self.small = Bit()
        self.parts: list[Symbols | None] = [None] * (bits + 1)

    def __call__(self, coder: Reader | Writer, guess: int, context: int = 0, real: int | None = None) -> int:
        span, half = 1 << self.width, 1 << (self.width - 1)
        c = k = None
        if coder.writes:
            c = (real - guess + half) % span - half
            k = (c - 1 if c > 0 else -c).bit_length()
        self.k = k = coder.symbol(self.sizes[context], k)
        if k == 0:
            c = coder.bit(self.small, c)
        elif k == 32:
            c = -half
        else:
            if self.parts[k] is None:
                self.parts[k] = Symbols(1 << min(k, self.high))
            low = max(k - self.high, 0)
            v = None if c is None else (c - 1 if c >= 1 << (k - 1) else c + (1 << k) - 1)
            top = coder.symbol(self.parts[k], None if v is None else v >> low)
            v = top << low | coder.bits(low, None if v is None else v & ((1 << low) - 1)) if low else top
            c = v + 1 if v >= 1 << (k - 1) else v - (1 << k) + 1
        # back into the range of the type: signed for 32 bits, else from 0 on
        return (guess + c + half) % span - half if self.width == 32 else (guess + c) % span


class Median:
    """A running middle of about five values: new ones push out the largest and the smallest in turns."""

    def __init__(self) -> None:
        self.values, self.drop_largest = [0] * 5, True

    def add(self, v: int) -> None:
        x = self.values
        if self.drop_largest:
            upper = v >= x[2]
            x[4:] = []
            at = (3 if v < x[3] else 4) if upper else (0 if v < x[0] else 1 if v < x[1] else 2)
            x.insert(at, v)
            if upper and at == 4:
                pass
            self.drop_largest = not upper
        else:
            lower = v <= x[2]
            x[:1] = []
            at = (1 if x[0] < v else 0) if lower else (4 if x[3] < v else 3 if x[2] < v else 2)
            x.insert(at, v)
            self.drop_largest = lower


def _models(n: int = 256) -> list[Symbols | None]:
    return [None] * n


def _of(models: list, k: int) -> Symbols:
    if models[k] is None:
        models[k] = Symbols(256)
    return models[k]


class PointPart:
    """x, y, z, intensity, flags, classification, angle, user data and source."""

    size = 20

    def __init__(self, first: bytes) -> None:
        self.last = list(struct.unpack("<iiiHBBbBH", first))
        self.intensity, self.dx, self.dy, self.height = [0] * 16, [Median() for _ in range(16)], [Median() for _ in range(16)], [0] * 8
        self.changed, self.flags, self.classes, self.users, self.angles = Symbols(64), _models(), _models(), _models(), [Symbols(256), Symbols(256)]
        self.i_intensity, self.i_source, self.i_dx, self.i_dy, self.i_z = Whole(16, 4), Whole(16), Whole(32, 2), Whole(32, 22), Whole(32, 20)
        self.last[3] = 0

    def __call__(self, coder: Reader | Writer, item: bytes | None = None) -> bytes:
        last = self.last
        new = struct.unpack("<iiiHBBbBH", item) if coder.writes else (None,) * 9
        changed = None
        if coder.writes:
            at = RETURNS[new[4] >> 3 & 7][new[4] & 7]
            differs = (new[4] != last[4], new[3] != self.intensity[at], new[5] != last[5], new[6] != last[6], new[7] != last[7], new[8] != last[8])
            changed = sum(d << (5 - k) for k, d in enumerate(differs))
        changed = coder.symbol(self.changed, changed)
        if changed & 32:
            last[4] = coder.symbol(_of(self.flags, last[4]), new[4])
        r, n = last[4] & 7, last[4] >> 3 & 7
        m, level, single = RETURNS[n][r], abs(n - r), int(n == 1)
        if changed:
            if changed & 16:
                self.intensity[m] = self.i_intensity(coder, self.intensity[m], min(m, 3), new[3])
            last[3] = self.intensity[m]
            if changed & 8:
                last[5] = coder.symbol(_of(self.classes, last[5]), new[5])
            if changed & 4:
                turn = coder.symbol(self.angles[last[4] >> 6 & 1], None if new[6] is None else (new[6] - last[6]) & 255)
                last[6] = (last[6] + turn + 128) % 256 - 128
            if changed & 2:
                last[7] = coder.symbol(_of(self.users, last[7]), new[7])
            if changed & 1:
                last[8] = self.i_source(coder, last[8], 0, new[8])
        ahead = lambda k: None if new[k] is None else new[k] - last[k]
        wrap = lambda v: (v + (1 << 31)) % (1 << 32) - (1 << 31)
        d = self.i_dx(coder, self.dx[m].values[2], single, ahead(0))
        self.dx[m].add(d)
        last[0] = wrap(last[0] + d)
        k = self.i_dx.k
        d = self.i_dy(coder, self.dy[m].values[2], single + (k & ~1 if k < 20 else 20), ahead(1))
        self.dy[m].add(d)
        last[1] = wrap(last[1] + d)
        k = (self.i_dx.k + self.i_dy.k) // 2
        last[2] = self.height[level] = self.i_z(coder, self.height[level], single + (k & ~1 if k < 18 else 18), new[2])
        return struct.pack("<iiiHBBbBH", *last)


class TimePart:
    """Times, as differences within one of four sequences that take turns."""

    size = 8

    def __init__(self, first: bytes) -> None:
        self.times, self.steps, self.far, self.now, self.free = [struct.unpack("<q", first)[0], 0, 0, 0], [0] * 4, [0] * 4, 0, 0
        self.codes, self.still, self.whole = Symbols(TIME_CODES), Symbols(6), Whole(32, 9)

    def _narrow(self, v: int) -> int:
        return (v + (1 << 31)) % (1 << 32) - (1 << 31)

    def __call__(self, coder: Reader | Writer, item: bytes | None = None) -> bytes:
        time = struct.unpack("<q", item)[0] if coder.writes else None
        while True:
            k, step = self.now, self.steps[self.now]
            still = step == 0
            code = diff = None
            if coder.writes:
                diff = time - self.times[k]
                fits = -(1 << 31) <= diff < 1 << 31
                other = next((j for j in (1, 2, 3) if -(1 << 31) <= time - self.times[k + j & 3] < 1 << 31), 0)
                if still:
                    code = 0 if diff == 0 else 1 if fits else 2 + other
                elif diff == 0:
                    code = UNCHANGED
                elif not fits:
                    code = WHOLE_TIME + other
                else:
                    times = int(np.floor(diff / step + 0.5))
                    code = 1 if times == 1 else 0 if times == 0 else min(times, HIGHEST) if times > 0 else HIGHEST - max(times, LOWEST)
            code = coder.symbol(self.still if still else self.codes, code)
            full, switch = (2, 2) if still else (WHOLE_TIME, WHOLE_TIME)
            if code > switch:
                self.now = self.now + code - switch & 3
                continue
            break
        if code == full:
            self.free = self.free + 1 & 3
            high = self.whole(coder, self._narrow(self.times[k] >> 32), 8, None if time is None else time >> 32)
            low = coder.bits(32, None if time is None else time & FULL)
            self.now = k = self.free
            self.times[k], self.steps[k], self.far[k] = high << 32 | low, 0, 0
        elif still:
            if code == 1:
                self.steps[k] = self.whole(coder, 0, 0, diff)
                self.times[k] += self.steps[k]
                self.far[k] = 0
        elif code == 1:
            self.times[k] += self.whole(coder, step, 1, diff)
            self.far[k] = 0
        elif code < UNCHANGED:
            times = code if code <= HIGHEST else HIGHEST - code
            context = 7 if code == 0 else 2 if 0 < times < 10 else 3 if 0 < times < HIGHEST else 4 if times == HIGHEST else 5 if times > LOWEST else 6
            diff = self.whole(coder, self._narrow(times * step), context, diff)
            if context in (4, 6, 7):
                self.far[k] += 1
                if self.far[k] > 3:
                    self.steps[k], self.far[k] = diff, 0
            self.times[k] += diff
        return struct.pack("<q", self.times[self.now])


class ColourPart:
    size = 6

    def __init__(self, first: bytes) -> None:
        self.last, self.used, self.parts = list(first), Symbols(128), [Symbols(256) for _ in range(6)]

    def __call__(self, coder: Reader | Writer, item: bytes | None = None) -> bytes:
        last, new = self.last, list(item) if coder.writes else [None] * 6  # low and high byte of red, green, blue
        used = None
        if coder.writes:
            used = sum((new[k] != last[k]) << k for k in range(6)) | (new[0] != new[2] or new[0] != new[4] or new[1] != new[3] or new[1] != new[5]) << 6
        used = coder.symbol(self.used, used)
        out = list(last)

        def part(k: int, guess: int) -> None:
            if used & 1 << k:
                out[k] = guess + coder.symbol(self.parts[k], None if new[k] is None else new[k] - guess & 255) & 255

        clamp = lambda v: min(max(v, 0), 255)
        part(0, last[0])
        part(1, last[1])
        if used & 64:
            for low in (0, 1):
                diff = out[low] - last[low]
                part(2 + low, clamp(diff + last[2 + low]))
                diff = int((diff + out[2 + low] - last[2 + low]) / 2)
                part(4 + low, clamp(diff + last[4 + low]))
        else:
            out[2:] = out[:2] * 2
        self.last = out
        return bytes(out)


class BytesPart:
    def __init__(self, first: bytes) -> None:
        self.size, self.last, self.parts = len(first), list(first), [Symbols(256) for _ in first]

    def __call__(self, coder: Reader | Writer, item: bytes | None = None) -> bytes:
        for k, m in enumerate(self.parts):
            self.last[k] = self.last[k] + coder.symbol(m, None if item is None else item[k] - self.last[k] & 255) & 255
        return bytes(self.last)


PARTS = {POINT: PointPart, TIME: TimePart, COLOUR: ColourPart, BYTES: BytesPart}


@dataclass(frozen=True)
class Coding:
    """How a file's points are coded: items (kind, bytes), points a chunk, and where each chunk begins."""

    items: tuple[tuple[int, int], ...]
    chunk: int
    starts: tuple[int, ...]


def describe(record: bytes) -> tuple[tuple[tuple[int, int], ...], int]:
    """Items and points a chunk, from the describing record. Other codings raise FormatNotSupported."""
    kind, coder = struct.unpack_from("<HH", record)
    chunk, n = struct.unpack_from("<I", record, 12)[0], struct.unpack_from("<H", record, 32)[0]
    items = [struct.unpack_from("<HHH", record, 34 + 6 * k) for k in range(n)]
    if kind != CHUNKED or coder != 0 or chunk == VARIABLE or any(k not in PARTS or version != 2 for k, _, version in items):
        raise FormatNotSupported(f"points coded by kind {kind}, parts {[(k, v) for k, _, v in items]}")
    return tuple((k, size) for k, size, _ in items), chunk


def chunk_starts(path: str, offset: int) -> tuple[int, ...]:
    """Where the chunks of a file begin, from the table behind them."""
    with open(path, "rb") as f:
        f.seek(offset)
        table = struct.unpack("<q", f.read(8))[0]
        if table < 0:  # a writer that could not go back left it at the end
            f.seek(-8, 2)
            table = struct.unpack("<q", f.read(8))[0]
        f.seek(table)
        _, n = struct.unpack("<II", f.read(8))
        coder, sizes, last, out = Reader(f.read()), Whole(32, 2), 0, [offset + 8]
    for _ in range(n):
        last = sizes(coder, last, 1)
        out.append(out[-1] + last)
    return tuple(out[:-1])


def _points(coder: Reader, parts: list, n: int) -> Iterator[bytes]:
    for _ in range(n):
        yield b"".join(p(coder) for p in parts)


def read_chunk(data: bytes, items: tuple[tuple[int, int], ...], n: int) -> bytes:
    """The n point records of a chunk."""
    at, parts = 0, []
    for kind, size in items:
        parts.append(PARTS[kind](data[at : at + size]))
        at += size
    return data[:at] + b"".join(_points(Reader(data, at), parts, n - 1))


def write_chunk(records: list[bytes], items: tuple[tuple[int, int], ...]) -> bytes:
    coder, parts, at = Writer(), [], 0
    for kind, size in items:
        parts.append((PARTS[kind](records[0][at : at + size]), at, size))
        at += size
    for r in records[1:]:
        for part, begin, size in parts:
            part(coder, r[begin : begin + size])
    return records[0] + (coder.done() if len(records) > 1 else b"\0\0\0\0")


def coded(records: list[bytes], items: tuple[tuple[int, int], ...], chunk: int, offset: int) -> bytes:
    """The points' part of a file that begins at ``offset``: the table's place, the chunks, the table."""
    chunks = [write_chunk(records[k : k + chunk], items) for k in range(0, len(records), chunk)]
    coder, sizes, last = Writer(), Whole(32, 2), 0
    for c in chunks:
        last = sizes(coder, last, 1, len(c))
    body = b"".join(chunks)
    return struct.pack("<q", offset + 8 + len(body)) + body + struct.pack("<II", 0, len(chunks)) + coder.done()


def record(items: tuple[tuple[int, int], ...], chunk: int) -> bytes:
    head = struct.pack("<HHBBHIIqqH", CHUNKED, 0, 2, 2, 0, 0, chunk, -1, -1, len(items))
    return head + b"".join(struct.pack("<HHH", k, size, 2) for k, size in items)
