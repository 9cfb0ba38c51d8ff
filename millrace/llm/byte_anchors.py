"""Rolling hashes and anchors of byte strings, in numpy.

A window is ``LENGTH`` bytes. Its anchor is the start of the ``Q``-gram inside
it with the least hash, leftmost among equals: it depends on nothing but the
window's bytes, so equal windows have their anchors at the same place.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a repeated string, and of the grams that fill the initial buckets.
LENGTH, Q = 200, 64
#: Grams of a window.
GRAMS = LENGTH - Q + 1
#: Windows of a long text that are treated at once, and bytes of short texts that are.
PIECE, CHUNK = 1 << 18, 1 << 19
POSITION = np.uint64((1 << 20) - 1)

_random = np.random.default_rng(20_200)
_OF_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_ROOM = CHUNK + PIECE + 2 * LENGTH + 1
_POWER = _powers(_BASE, _ROOM)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _ROOM)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of ``data`` (at most ``_ROOM`` bytes), from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * _POWER[: len(data)], out=self.prefix[1:])

    def of(self, start, end) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * _INVERSE[start]

    def windows(self, n: int) -> np.ndarray:
        """Of the n-byte string at each offset."""
        return (self.prefix[n:] - self.prefix[:-n]) * _INVERSE[: len(self.prefix) - n]


def chunks(texts):
    """(bytes, [(text number, offset in the text, first, end in the bytes)]): pieces of texts, whole windows each, packed together."""
    held, pieces, size = [], [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - LENGTH + 1), PIECE):
            part = text[offset : offset + PIECE + LENGTH - 1]
            held.append(part)
            pieces.append((number, offset, size, size + len(part)))
            size += len(part)
            if size >= CHUNK:
                yield np.frombuffer(b"".join(held), np.uint8), pieces
                held, pieces, size = [], [], 0
    if pieces:
        yield np.frombuffer(b"".join(held), np.uint8), pieces


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, pieces: list) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with one anchor.

    text: text number; first, last: starts of the run's windows in the text;
    at: the anchor in the text; gram: hash of its gram; hull: hash of all bytes
    that the run's windows cover.
    """
    hashes = Hashes(data)
    grams = mixed(hashes.windows(Q))
    least = _sliding_least(grams & ~POSITION | np.arange(len(grams), dtype=np.uint64), GRAMS)
    where = (least & POSITION).astype(np.int64)
    number, offset, begin, end = (np.array(x, np.int64) for x in zip(*pieces))
    valid = np.zeros(len(where) + LENGTH, np.int32)  # windows inside one piece
    valid[begin] += 1
    valid[end - LENGTH + 1] -= 1
    inside = np.flatnonzero(np.cumsum(valid[: len(where)]))
    piece = np.searchsorted(begin, inside, "right") - 1
    new = np.append(True, (where[inside][1:] != where[inside][:-1]) | (piece[1:] != piece[:-1]))
    at = np.flatnonzero(new)
    first, last = inside[at], inside[np.append(at[1:], len(inside)) - 1]
    of, anchor = piece[at], where[first]
    shift = offset[of] - begin[of]
    return {"text": number[of], "first": first + shift, "last": last + shift, "at": anchor + shift, "gram": grams[anchor], "hull": mixed(hashes.of(first, last + LENGTH))}
