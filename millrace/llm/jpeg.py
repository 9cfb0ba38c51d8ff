"""Baseline JPEG in numpy: a byte payload as quantised coefficients, and a reader for baseline files.

The reader decodes all restart intervals of many files in step: one Huffman
symbol of each interval at a time, by look-up tables over whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

BLOCK = 64
#: Blocks between restart markers of files that are written here.
INTERVAL = 8
#: Most samples along a side.
SIDE = 65_535

# The zigzag order of a block's coefficients, as rows of the standard.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

#: Code lengths of the symbols that are written: sizes of DC differences, then (run 0, size) of other coefficients.
_DC_LENGTHS = {s: 4 for s in range(10)}
_AC_LENGTHS = {7: 1, 6: 3, 8: 4, 5: 4, 4: 4, 9: 4, 3: 4, 2: 5, 1: 6, 0: 7}


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical: short codes first."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol] = code, n
        code, last = code + 1, n
    return out


def _by_size(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    table = codes(lengths)
    pairs = [table.get(s, (0, 0)) for s in range(12)]
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)


_DC, _AC = _by_size(_DC_LENGTHS), _by_size(_AC_LENGTHS)
_SIZE = np.array([int(v).bit_length() for v in range(512)])


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman_segment(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: x[1])
    counts = bytes(sum(n == k for _, n in order) for k in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(s for s, _ in order))


_TABLES = _segment(0xDB, b"\0" + bytes([8, *[1] * 63])) + _huffman_segment(0x00, _DC_LENGTHS) + _huffman_segment(0x10, _AC_LENGTHS)


def _scan(payload: np.ndarray) -> bytes:
    """Entropy-coded data of whole blocks: byte b as coefficient b - 128 in first place, b + 1 elsewhere."""
    blocks = payload.reshape(-1, BLOCK).astype(np.int64)
    n = len(blocks)
    value = blocks + 1
    dc = blocks[:, 0] - 128
    before = np.where(np.arange(n) % INTERVAL == 0, 0, np.append(0, dc[:-1]))
    diff = dc - before
    size = _SIZE[value]
    size[:, 0] = _SIZE[np.abs(diff)]
    value[:, 0] = np.where(diff < 0, diff + (1 << size[:, 0]) - 1, diff)
    code, length = _AC[0][size], _AC[1][size]
    code[:, 0], length[:, 0] = _DC[0][size[:, 0]], _DC[1][size[:, 0]]
    bits = (code << size.astype(np.uint64)) | value.astype(np.uint64)
    length = length + size
    # Four symbols, at most 52 bits, are put into one word.
    bits, length = bits.reshape(-1, 4), length.reshape(-1, 4)
    word = bits[:, 0]
    for i in range(1, 4):
        word = (word << length[:, i].astype(np.uint64)) | bits[:, i]
    total = length.sum(1).reshape(n, -1)
    per_block = total.sum(1)
    starts = np.arange(0, n, INTERVAL)
    interval_bits = np.add.reduceat(per_block, starts)
    interval_bytes = -(-interval_bits // 8)
    first_byte = np.cumsum(interval_bytes) - interval_bytes
    flat = total.ravel()
    along = np.cumsum(flat) - flat
    per = BLOCK // 4
    of = np.repeat(np.arange(n) // INTERVAL, per)
    at = along - along[starts * per][of] + 8 * first_byte[of]
    byte, shift = at >> 3, at & 7
    aligned = word << (64 - flat - shift).astype(np.uint64)
    out = np.zeros(int(interval_bytes.sum()) + 8)
    for j in range(8):
        part = (aligned >> np.uint64(56 - 8 * j)) & np.uint64(255)
        out += np.bincount(byte + j, part, len(out))
    data = out[:-8].astype(np.uint8)
    spare = interval_bytes * 8 - interval_bits
    data[first_byte + interval_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)
    # A zero goes after each 0xFF, a restart marker before each interval but the first.
    insert_at = np.concatenate([np.flatnonzero(data == 255) + 1, np.repeat(first_byte[1:], 2)])
    markers = np.stack([np.full(len(starts) - 1, 255), 0xD0 + np.arange(len(starts) - 1) % 8], 1).ravel()
    values = np.concatenate([np.zeros(len(insert_at) - len(markers), np.int64), markers])
    return np.insert(data, insert_at, values.astype(np.uint8)).tobytes()


def shape(blocks: int) -> tuple[int, int]:
    """Blocks across and down, near a square, with room for ``blocks``."""
    across = max(1, int(np.ceil(np.sqrt(blocks))))
    return across, -(-blocks // across)


def encode(payload: bytes) -> bytes:
    """A grey baseline JPEG whose coefficients are ``payload``, a positive multiple of 64 bytes; its length is kept in a comment."""
    across, down = shape(len(payload) // BLOCK)
    if 8 * across > SIDE:
        raise ValueError("the payload has more blocks than an image of this format")
    full = np.zeros(across * down * BLOCK, np.uint8)
    full[: len(payload)] = np.frombuffer(payload, np.uint8)
    size = (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big")
    head = _segment(0xFE, b"payload=%d" % len(payload)) + _TABLES + _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00") + _segment(0xDD, INTERVAL.to_bytes(2, "big"))
    return b"\xff\xd8" + head + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + _scan(full) + b"\xff\xd9"


@dataclass
class Component:
    key: int
    across: int  # blocks of an MCU
    down: int
    quant: int
    dc: int = 0
    ac: int = 0
    wide: int = 0  # blocks of the component
    high: int = 0
    coefficients: np.ndarray | None = None


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, dict[int, int]] = field(default_factory=dict)
    interval: int = 0
    comment: bytes = b""
    scans: list = field(default_factory=list)  # (components, table snapshot, interval, data)

    @property
    def payload(self) -> bytes:
        """What ``encode`` stored."""
        c = self.components[0].coefficients.copy()
        c[:, 0] += 129
        return (c - 1).astype(np.uint8).tobytes()[: int(self.comment.removeprefix(b"payload="))]

    @property
    def thumbnail(self) -> np.ndarray:
        """Luminance of each block: its DC coefficient alone, 0 to 255."""
        y = self.components[0]
        mean = y.coefficients[:, 0].reshape(y.high, y.wide) * int(self.quants[y.quant][0]) / 8 + 128
        return np.clip(np.rint(mean), 0, 255).astype(np.uint8)


def _look_up(lengths_of: dict[int, int], order: list[int]) -> np.ndarray:
    """For each 16 bits: symbol and, above it, code length; length 0 where no code is."""
    table = np.zeros(1 << 16, np.int32)
    code, last = 0, 0
    for symbol in order:
        n = lengths_of[symbol]
        code <<= n - last
        table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
        code, last = code + 1, n
    return table


def parse(data: bytes) -> Image:
    """Markers of a baseline file; scans are kept encoded."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, i = Image(), 2
    while i < len(data) - 1:
        if data[i] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[i + 1]
        if marker == 0xFF:
            i += 1
            continue
        if marker == 0xD9:
            break
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        body, i = data[i + 4 : i + 2 + n], i + 2 + n
        if marker in (0xC0, 0xC1):
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or not image.height:
                raise ValueError("only 8-bit samples of a known height are read")
            image.components = [Component(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * k : 9 + 3 * k] for k in range(body[5]))]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are read")
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = 1 + (body[k] >> 4)
                raw = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, k + 1)
                image.quants[body[k] & 15] = raw.astype(np.int64)
                k += 1 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                symbols = list(body[k + 17 : k + 17 + sum(counts)])
                lengths = dict(zip(symbols, (n for n, c in enumerate(counts, 1) for _ in range(c))))
                image.huffman[body[k]] = (lengths, symbols)
                k += 17 + len(symbols)
        elif marker == 0xDD:
            image.interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            chosen = []
            for k in range(body[0]):
                component = next(c for c in image.components if c.key == body[1 + 2 * k])
                component.dc, component.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                chosen.append(component)
            end = i
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            image.scans.append((chosen, dict(image.huffman), image.interval, data[i:end]))
            i = end
    return image


def _place(image: Image) -> None:
    """Sizes of the components in blocks, whole MCUs."""
    h, v = max(c.across for c in image.components), max(c.down for c in image.components)
    across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    for c in image.components:
        c.wide, c.high = across * c.across, down * c.down
        c.coefficients = np.zeros((c.wide * c.high, BLOCK), np.int16)


def _blocks_of_scan(image: Image, chosen: list[Component]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each block of an MCU its component number; and, MCU by MCU, the block's place in the component."""
    if len(chosen) == 1:
        c = chosen[0]
        h, v = max(x.across for x in image.components), max(x.down for x in image.components)
        wide, high = -(-image.width * c.across // (8 * h)), -(-image.height * c.down // (8 * v))
        return np.zeros(1, np.int64), (np.arange(high)[:, None] * c.wide + np.arange(wide)).reshape(-1, 1)
    across = chosen[0].wide // chosen[0].across
    mcus = np.arange(across * (chosen[0].high // chosen[0].down))
    of, places = [], []
    for number, c in enumerate(chosen):
        for y in range(c.down):
            for x in range(c.across):
                of.append(number)
                places.append((mcus // across * c.down + y) * c.wide + mcus % across * c.across + x)
    return np.array(of), np.stack(places, 1)


def decode(files: list[bytes]) -> list[Image]:
    """Images with the coefficients of all components, in zigzag order."""
    images = list(map(parse, files))
    tables: dict[tuple, int] = {}
    looked: list[np.ndarray] = []
    streams, raw, plans = [], [], []
    size = 0
    for image in images:
        _place(image)
        for chosen, huffman, interval, data in image.scans:
            of, places = _blocks_of_scan(image, chosen)
            numbers = []
            for kind in (0, 16):
                for c in chosen:
                    lengths, order = huffman[kind | (c.ac if kind else c.dc)]
                    known = tuple(lengths.items())
                    if known not in tables:
                        tables[known] = len(looked)
                        looked.append(_look_up(lengths, order))
                    numbers.append(tables[known])
            bytes_ = np.frombuffer(data, np.uint8)
            ff = np.flatnonzero(bytes_[:-1] == 255)
            stuffed = ff[bytes_[ff + 1] == 0] + 1
            marks = ff[(bytes_[ff + 1] >= 0xD0) & (bytes_[ff + 1] <= 0xD7)]
            drop = np.concatenate([stuffed, marks, marks + 1])
            kept = np.delete(bytes_, drop)
            begin = np.append(0, marks - np.searchsorted(np.sort(drop), marks)) if len(marks) else np.zeros(1, np.int64)
            mcus = len(places)
            step = interval or max(1, mcus)
            plan = len(plans)
            plans.append((chosen, of, places, np.array(numbers)))
            for k, b in enumerate(begin[: -(-mcus // step)]):
                streams.append((plan, k * step, min(mcus, (k + 1) * step), size + int(b)))
            raw += [kept, np.full(8, 255, np.uint8)]
            size += len(kept) + 8
    if streams:
        _decode_streams(np.array(streams, np.int64), np.concatenate(raw), plans, np.stack(looked))
    return images


def _decode_streams(streams: np.ndarray, raw: np.ndarray, plans: list, tables: np.ndarray) -> None:
    """Fill the coefficients of all streams, a symbol of each at a time."""
    padded = np.concatenate([raw, np.full(8, 255, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(raw), np.uint64)  # six bytes from each place
    for j in range(6):
        word |= padded[j : j + len(raw)] << np.uint64(40 - 8 * j)
    # One flat array of coefficients; each block of each plan has its place in it.
    offset, where, kinds, tabs, first_block, per_mcu, components, pred_at = 0, [], [], [], [], [], [], []
    bases = {}
    blocks_before = preds = 0
    for chosen, of, places, numbers in plans:
        for c in chosen:
            if id(c) not in bases:
                bases[id(c)] = offset
                offset += len(c.coefficients)
                components.append(c)
        base = np.array([bases[id(c)] for c in chosen])
        where.append((places + base[of]).ravel())
        kinds.append(np.tile(of, len(places)))
        tabs.append((numbers[of], numbers[len(chosen) + of]))
        first_block.append(blocks_before)
        per_mcu.append(len(of))
        pred_at.append(len(chosen))
        blocks_before += places.size
    where, kinds = np.concatenate(where), np.concatenate(kinds)
    dc_table = np.concatenate([np.tile(t[0], len(p[2])) for t, p in zip(tabs, plans)])
    ac_table = np.concatenate([np.tile(t[1], len(p[2])) for t, p in zip(tabs, plans)])
    first_block, per_mcu = np.array(first_block), np.array(per_mcu)
    out = np.zeros(offset * BLOCK, np.int16)
    flat = tables.ravel()

    plan = streams[:, 0]
    block = first_block[plan] + streams[:, 1] * per_mcu[plan]
    stop = first_block[plan] + streams[:, 2] * per_mcu[plan]
    bit = streams[:, 3] * 8
    most = max(pred_at)
    pred = np.zeros(len(streams) * most, np.int64)
    me = np.arange(len(streams)) * most
    k = np.zeros(len(streams), np.int64)
    limit = len(raw) - 1
    while len(block):
        w = word[np.minimum(bit >> 3, limit)] << (bit & 7).astype(np.uint64)
        start = k == 0
        table = np.where(start, dc_table[block], ac_table[block])
        entry = flat[(table << 16) + ((w >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
        n, symbol = entry >> 8, entry & 255
        if not n.all():
            raise ValueError("a code that no table has")
        size = symbol & 15
        value = ((w << n.astype(np.uint64) & np.uint64((1 << 48) - 1)) >> (48 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((value >> np.maximum(size - 1, 0) & 1 == 0) & (size > 0), value - (1 << size) + 1, value)
        bit = bit + n + size
        run = np.where(start, 0, symbol >> 4)
        at = k + run
        ended = ~start & (symbol == 0)
        puts = (size > 0) & ~ended
        if start.any():
            slot = me[start] + kinds[block[start]]
            pred[slot] += value[start]
            value[start] = pred[slot]
            puts |= start
        if (at[puts] >= BLOCK).any():
            raise ValueError("a run leaves its block")
        out[where[block[puts]] * BLOCK + at[puts]] = value[puts]
        k = np.where(ended, BLOCK, at + 1)
        done = k >= BLOCK
        if done.any():
            k = np.where(done, 0, k)
            block = block + done
            over = block >= stop
            if over.any():
                left = ~over
                block, stop, bit, k, me = block[left], stop[left], bit[left], k[left], me[left]
    rows = out.reshape(-1, BLOCK)
    for c in components:
        c.coefficients = rows[bases[id(c)] : bases[id(c)] + len(c.coefficients)]


@lru_cache(4096)
def _cells(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of ``cells`` equal stretches of a side, one place at least."""
    edges = np.arange(cells + 1) * size // cells
    end = np.minimum(np.maximum(edges[1:], edges[:-1] + 1), size)
    return np.minimum(edges[:-1], end - 1), end


def difference_hash(thumbnail: np.ndarray) -> int:
    """64 bits: of an 8 by 9 grid of means, which is brighter than its left neighbour."""
    high, wide = thumbnail.shape
    sums = np.zeros((high + 1, wide + 1))
    np.cumsum(np.cumsum(thumbnail, 0, dtype=float), 1, out=sums[1:, 1:])
    (top, bottom), (left, right) = _cells(high, 8), _cells(wide, 9)
    down = sums[bottom] - sums[top]
    grid = (down[:, right] - down[:, left]) / (right - left)
    return int.from_bytes(np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes(), "big")
