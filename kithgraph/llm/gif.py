"""GIF: writing, and decoding LZW code streams, palettes, disposal and transparency.

Many images are handled at once: streams of a batch are packed and decoded together in
numpy. A code's width depends on its place since the last clear code only, so the codes
of a stretch are cut out in one step; every table entry is a stretch of the output
itself (where its code was first followed by another), so lengths and bytes are found
by following such references with pointer doubling instead of code by code.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np

#: Most codes in a table.
_FULL = 4096
_LAST = (_FULL - 1) << 8
#: Samples of streams that are packed or decoded together.
AT_ONCE = 1 << 20


class BadGif(ValueError):
    """An image that breaks the format."""


@lru_cache(maxsize=8)
def _widths(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the first n codes after a clear code, and the bits before each."""
    width = np.array([bits + 1] + [min(12, max(bits + 1, ((1 << bits) + 1 + i).bit_length())) for i in range(1, n)], np.int64)
    return width, np.concatenate([[0], np.cumsum(width)])


def _codes(data: bytes) -> list[int]:
    """LZW codes of 8-bit samples, times 256, with the clear and end codes."""
    out = [256 << 8]
    if not data:
        return [*out, 257 << 8]
    table: dict[int, int] = {}
    find, put = table.get, out.append
    # What a code and the next sample make: under code + sample, codes being multiples of 256.
    at, free = data[0] << 8, 258 << 8
    for b in data[1:]:
        if (known := find(at + b)) is not None:
            at = known
            continue
        put(at)
        if free < _LAST:
            table[at + b] = free
            free += 256
        else:
            put(256 << 8)
            table.clear()
            free = 258 << 8
        at = b << 8
    put(at)
    put(257 << 8)
    return out


def lzw_encode(streams: Iterable[bytes]) -> list[bytes]:
    """The code stream of each string of 8-bit samples."""
    each = [_codes(s) for s in streams]
    sizes = np.array([len(c) for c in each])
    code = np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum())) >> 8
    head = np.zeros(len(code), bool)
    head[np.cumsum(sizes)[:-1]] = True  # a stream's own first code
    clear = (code == 256) & ~head
    clear[0] = False
    # A code's place since the last clear code; the first code of a stream has the first width.
    start = np.concatenate([[0], np.flatnonzero(head | np.concatenate([[False], code[:-1] == 256]))]).astype(np.int64)
    start = np.unique(start)
    place = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
    width = _widths(8, _FULL)[0][np.minimum(place, _FULL - 1)]
    bits = np.add.reduceat(width, np.cumsum(sizes) - sizes)
    bytes_ = (bits + 7) // 8
    base = 8 * (np.cumsum(bytes_) - bytes_)
    before = np.cumsum(width) - width
    at = before + np.repeat(base - before[np.cumsum(sizes) - sizes], sizes)
    # A code lies in at most three bytes; bits of different codes never meet, so adding is joining.
    value, byte = code << (at & 7), at >> 3
    n = int(bytes_.sum()) + 2
    body = sum(np.bincount(byte + k, (value >> 8 * k) & 255, n) for k in range(3)).astype(np.uint8).tobytes()
    ends = np.cumsum(bytes_).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _segments(code: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The samples of stretches of codes (without clear and end codes), and their bounds."""
    first = (1 << bits) + 2
    n = len(code)
    start = np.repeat(bounds[:-1], np.diff(bounds))
    entry = code >= first
    itself = np.arange(n, dtype=np.int32)
    to = np.where(entry, code + (start - first), itself).astype(np.int32)
    if (entry & (to >= itself)).any():
        raise BadGif("a code that isn't in the table")
    hops, up = entry.astype(np.int32), to
    while True:  # lengths: one more than that of the code an entry comes from
        further = up[up]
        if (further == up).all():
            break
        hops, up = hops + hops[up], further
    length = hops + 1
    place = np.cumsum(length) - length
    total = int(length.sum())
    place = place.astype(np.int32)
    source = np.arange(total, dtype=np.int32) + np.repeat(np.where(entry, place[to] - place, 0).astype(np.int32), length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.repeat(np.where(entry, 0, code).astype(np.uint8), length)
    return value[source], np.append(place, total)[bounds]


def lzw_decode(streams: list[bytes], bits: int = 8) -> list[bytes]:
    """The samples of each code stream."""
    clear, end = 1 << bits, (1 << bits) + 1
    sizes = np.array([len(s) for s in streams], np.int64)
    raw = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    word = np.ndarray((len(raw) - 3,), "<u4", raw.tobytes(), strides=(1,))
    at, stop = 8 * (np.cumsum(sizes) - sizes), 8 * np.cumsum(sizes)
    out: list[list[bytes]] = [[] for _ in streams]
    active = np.arange(len(streams))
    limit = _FULL + 64
    while len(active):
        width, before = _widths(bits, limit)
        room = np.minimum(limit, np.searchsorted(before, stop[active] - at[active], "right") - 1)
        if (room < 1).any():
            raise BadGif("a code stream without its end")
        bounds = np.concatenate([[0], np.cumsum(room)])
        k = np.arange(bounds[-1]) - np.repeat(bounds[:-1], room)
        position = np.repeat(at[active], room) + before[k]
        code = ((word[position >> 3].astype(np.int64) >> (position & 7)) & ((1 << width[k]) - 1)).astype(np.int64)
        halt = np.flatnonzero((code == clear) | (code == end))
        found = np.searchsorted(halt, bounds[:-1])
        first_halt = np.append(halt, 1 << 60)[found]
        if (first_halt >= bounds[1:]).any():
            if (room[first_halt >= bounds[1:]] < limit).any():
                raise BadGif("a code stream without its end")
            limit *= 4  # a table that stays full
            continue
        n = first_halt - bounds[:-1]
        inside = k < np.repeat(n, room)
        samples, cuts = _segments(code[inside], np.concatenate([[0], np.cumsum(n)]), bits)
        body, cuts = samples.tobytes(), cuts.tolist()
        for i, stream in enumerate(active.tolist()):
            if cuts[i + 1] > cuts[i]:
                out[stream].append(body[cuts[i] : cuts[i + 1]])
        at[active] += before[n + 1]
        active = active[code[first_halt] == clear]
    return [b"".join(parts) for parts in out]


@dataclass
class Frame:
    """An image of a GIF as stored: samples are numbers of the palette's colours."""

    samples: np.ndarray  # (height, width) uint8
    left: int = 0
    top: int = 0
    delay: int = 0  # hundredths of a second
    disposal: int = 0  # 2: to the background, 3: to what was there before
    transparent: int | None = None
    palette: np.ndarray | None = None  # (colours, 3) uint8, in place of the image's own


@dataclass
class Shown:
    """What a frame shows: the canvas as (height, width, 3), which part the frame drew, and for how long."""

    canvas: np.ndarray
    part: np.ndarray
    delay: int


def _blocks(body: bytes) -> bytes:
    return b"".join(bytes([len(c)]) + c for c in (body[k : k + 255] for k in range(0, len(body), 255))) + b"\0"


def _palette(table: np.ndarray) -> tuple[int, bytes]:
    size = max(0, (len(table) - 1).bit_length() - 1)
    return size, table.astype(np.uint8).tobytes() + bytes(3 * ((2 << size) - len(table)))


def _groups(sizes: Iterable[int], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Consecutive stretches with about `most` in all, one at least."""
    first = held = n = 0
    for n, size in enumerate(sizes, 1):
        held += size
        if held >= most:
            yield first, n
            first, held = n, 0
    if first < n:
        yield first, n


def write(images: list[tuple[tuple[int, int], np.ndarray, list[Frame]]]) -> list[bytes]:
    """Each of (width and height, palette, frames) as a file."""
    every = [f for _, _, frames in images for f in frames]
    bodies = chain.from_iterable(lzw_encode([f.samples.tobytes() for f in every[a:b]]) for a, b in _groups(f.samples.size for f in every))
    out = []
    for (width, height), palette, frames in images:
        size, table = _palette(palette)
        parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | size, 0, 0), table]
        for f in frames:
            flags = f.disposal << 2 | (f.transparent is not None)
            parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, f.delay, f.transparent or 0, 0))
            own, own_table = _palette(f.palette) if f.palette is not None else (None, b"")
            parts.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, f.samples.shape[1], f.samples.shape[0], 0 if own is None else 0x80 | own))
            parts += [own_table, b"\x08", _blocks(next(bodies))]
        out.append(b"".join([*parts, b";"]))
    return out


@dataclass
class _Stored:
    frame: Frame
    stream: bytes
    bits: int
    size: tuple[int, int]
    interlaced: bool


def _parse(body: bytes) -> tuple[tuple[int, int], np.ndarray, list[_Stored]]:
    def table(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if at + 3 * n > len(body):
            raise BadGif("the file ends inside a palette")
        return np.frombuffer(body, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while (n := body[at]) > 0:
            parts.append(body[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if body[:6] not in (b"GIF87a", b"GIF89a"):
        raise BadGif("no GIF header")
    try:
        width, height, flags, _, _ = struct.unpack_from("<HHBBB", body, 6)
        at, palette = 13, np.zeros((0, 3), np.uint8)
        if flags & 0x80:
            palette, at = table(at, flags)
        stored, control = [], (0, 0, None)
        while body[at] != 0x3B:
            if body[at] == 0x21:
                extra, end = blocks(at + 2)
                if body[at + 1] == 0xF9:
                    control = (struct.unpack_from("<H", extra, 1)[0], extra[0] >> 2 & 7, extra[3] if extra[0] & 1 else None)
                at = end
            elif body[at] == 0x2C:
                left, top, w, h, f = struct.unpack_from("<HHHHB", body, at + 1)
                at, own = at + 10, None
                if f & 0x80:
                    own, at = table(at, f)
                bits = body[at]
                if not 2 <= bits <= 8:
                    raise BadGif(f"{bits} bits a sample")
                stream, at = blocks(at + 1)
                stored.append(_Stored(Frame(np.zeros((0, 0), np.uint8), left, top, *control, own), stream, bits, (h, w), bool(f & 0x40)))
                control = (0, 0, None)
            else:
                raise BadGif(f"a block of kind {body[at]}")
    except (IndexError, struct.error) as e:
        raise BadGif("the file ends inside a block") from e
    return (width, height), palette, stored


def _interlaced(height: int) -> np.ndarray:
    """The rows in the order in which an interlaced image stores them."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def shown(size: tuple[int, int], palette: np.ndarray, frames: Iterable[Frame]) -> Iterator[Shown]:
    """What each frame shows on the canvas after the ones before and their disposal."""
    width, height = size
    canvas = np.zeros((height, width, 3), np.uint8)
    for f in frames:
        h, w = f.samples.shape
        if f.left + w > width or f.top + h > height:
            raise BadGif("a frame that isn't inside the image")
        colours = f.palette if f.palette is not None else palette
        if f.samples.size and int(f.samples.max()) >= len(colours):
            raise BadGif("a sample without a colour")
        area = np.s_[f.top : f.top + h, f.left : f.left + w]
        before = canvas[area].copy() if f.disposal == 3 else None
        drawn = colours[f.samples]
        canvas[area] = drawn if f.transparent is None else np.where((f.samples == f.transparent)[:, :, None], canvas[area], drawn)
        yield Shown(canvas, canvas[area], f.delay)
        if f.disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas[area] = before


def read(files: list[bytes]) -> Iterator[Iterator[Shown]]:
    """The frames of each file; a frame's arrays hold until the next one is taken."""
    parsed = [_parse(body) for body in files]
    streams = [s for _, _, stored in parsed for s in stored]
    for bits in {s.bits for s in streams}:
        some = [s for s in streams if s.bits == bits]
        decoded = chain.from_iterable(lzw_decode([s.stream for s in some[a:b]], bits) for a, b in _groups(s.size[0] * s.size[1] for s in some))
        for s, samples in zip(some, decoded, strict=True):
            h, w = s.size
            if len(samples) != h * w:
                raise BadGif(f"{len(samples)} samples for {w} x {h}")
            grid = np.frombuffer(samples, np.uint8).reshape(h, w)
            if s.interlaced:
                straight = np.empty_like(grid)
                straight[_interlaced(h)] = grid
                grid = straight
            s.frame.samples = grid
    for size, palette, stored in parsed:
        yield shown(size, palette, (s.frame for s in stored))
