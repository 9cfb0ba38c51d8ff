"""A SentencePiece BPE model: normalising with alignment, encoding to pieces with source spans, decoding.

Only plain Python and numpy; ``sentencepiece_ops.py`` runs it in Spark tasks.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from millrace.llm.bpe import LONG, NEVER, PairTable, merge, merge_many

SPACE = "▁"
#: Types of a piece in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Remembered segments in a Python worker.
MEMO = 120_000


def fields(data: bytes):
    """(number, value) of each field of a serialised message: ints, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over UTF-8 and its replacement strings."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at ``start``."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(start, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - start, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class PieceModel:
    """Vocabulary and rules read from a .model file of type BPE."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.pieces, self.types, scores = [], [], []
        norm = {}
        trainer = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.types.append(piece.get(3, NORMAL))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        if trainer.get(3) != 2 or {USER_DEFINED, UNUSED} & set(self.types) or trainer.get(24):
            raise ValueError("only BPE models without user-defined or unused pieces, spaces before words, are read")
        self.map = CharacterMap(norm[2]) if norm.get(2) else None
        self.dummy_prefix, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = self.types.index(UNKNOWN)
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        # No merge crosses from a letter to a space if no piece does: text then falls apart into segments.
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # Nor from or to a character that stands in single-character pieces at most.
        joining = "".join(re.escape(c) for c in sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE}))
        self.segments = re.compile(f"{SPACE}*[{joining}]+|{SPACE}+|[^{SPACE}{joining}]+" if apart and joining else r"(?s).+").findall
        self.packed: dict[str, bytes] = {}
        self._prepare_many()
        # What decodes alone and always alike: not parts of characters, unknowns or controls.
        self.surface = [chr(self.of_byte[i]) if t == BYTE else p.replace(SPACE, " ") for i, (p, t) in enumerate(zip(self.pieces, self.types))]
        self.plain = np.array([t == NORMAL or t == BYTE and self.of_byte[i] < 128 for i, t in enumerate(self.types)])

    def _prepare_many(self) -> None:
        """Symbol numbers, their packed pieces and the table of pairs for merging many segments at once."""
        known = sorted({c for p in self.ids for c in p} | set(self.ids))
        self.symbol = {s: i for i, s in enumerate(known)}
        self.of_symbol = np.array([self.ids[s] << 32 | len(s.encode()) if s in self.ids else -1 for s in known] or [-1], np.int64)
        rank = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        self.pairs = PairTable((self.symbol[p[:i]], self.symbol[p[i:]], rank[self.rank[p]], self.symbol[p]) for p in self.ids for i in range(1, len(p)) if p[:i] in self.symbol and p[i:] in self.symbol)
        of_char = np.full(0x110000, -1, np.int32)
        for s, i in self.symbol.items():
            if len(s) == 1:
                of_char[ord(s)] = i
        self.of_char = of_char

    def learn(self, segments: set[str]) -> None:
        """Remember the packed pieces of ``segments``; if memory is full, of these only."""
        new = segments - self.packed.keys()
        if len(self.packed) + len(new) > MEMO:
            self.packed.clear()
            new = segments
        short = [s for s in new if len(s) <= LONG]
        if short:
            symbols = self.of_char[np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)]
            lengths = np.array(list(map(len, short)))
            ends = np.cumsum(lengths)
            # Units with characters of no piece, or that end in no piece, take the slow way.
            strange = np.add.reduceat(symbols < 0, ends - lengths) > 0
            merged, sizes = merge_many(symbols[np.repeat(~strange, lengths)].astype(np.int64), lengths[~strange], self.pairs)
            packed, blob = self.of_symbol[merged], self.of_symbol[merged].tobytes()
            plain = np.add.reduceat(packed < 0, np.cumsum(sizes) - sizes) == 0 if len(sizes) else []
            bounds = (np.cumsum(np.append(0, sizes)) * 8).tolist()
            for s, a, b, good in zip((s for s, odd in zip(short, strange) if not odd), bounds, bounds[1:], plain):
                if good:
                    self.packed[s] = blob[a:b]
        for s in new:
            if s not in self.packed:
                self.packed[s] = self.encode_segment(s)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its byte offsets (its end included), the source's byte offset."""
        source = text.encode()
        if self.map is None and not self.squeeze and self.escape:
            raw = np.frombuffer(source, np.uint8)
            align = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 32, 3, 1))
            out = text.replace(" ", SPACE)
            if self.dummy_prefix and text:
                out, align = SPACE + out, np.concatenate([np.zeros(3, np.int32), align])
            return out, np.append(align, np.int32(len(raw)))
        return self._normalise_mapped(source)

    def _normalise_mapped(self, source: bytes) -> tuple[str, np.ndarray]:
        """One prefix at a time: the map's longest key, else one character."""
        space = SPACE.encode() if self.escape else b" "
        out, align = bytearray(), []
        i, gap = 0, bool(self.squeeze)  # gap: a space here is dropped
        pending_prefix = self.dummy_prefix
        while i < len(source):
            hit = self.map.longest(source, i) if self.map else None
            if hit:
                length, chunk = hit
            else:
                b = source[i]
                length = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                chunk = source[i : i + length]
            while gap and chunk[:1] == b" ":
                chunk = chunk[1:]
            if chunk:
                if pending_prefix:
                    out += space
                    align += [i] * len(space)
                    pending_prefix = 0
                for part in re.findall(rb" |[^ ]+", chunk):
                    part = space if part == b" " else part
                    out += part
                    align += [i] * len(part)
                gap = bool(self.squeeze) and chunk.endswith(b" ")
            i += length
        end = i
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = align[len(out)]
                del align[len(out) :]
        return out.decode(), np.array([*align, end], np.int32)

    def encode_segment(self, segment: str) -> bytes:
        """A segment's pieces as 64-bit ints: the id and, in the low half, the UTF-8 length."""
        rank = self.rank
        out: list[int] = []
        for piece in merge(list(segment), lambda a, b: rank.get(a + b, NEVER)):
            raw = piece.encode()
            if piece in self.ids:
                out.append(self.ids[piece] << 32 | len(raw))
            elif self.bytes:
                out += [self.bytes[b] << 32 | 1 for b in raw]
            elif out and out[-1] >> 32 == self.unknown:
                out[-1] += len(raw)
            else:
                out.append(self.unknown << 32 | len(raw))
        return np.array(out, "<i8").tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the end byte of each piece in the source text."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]):
        """``encode`` of each; segments that are new are merged together."""
        normal = list(map(self.normalise, texts))
        parts = [self.segments(n) for n, _ in normal]
        self.learn(set().union(*parts))
        packed_of = self.packed.__getitem__
        for (_, align), segments in zip(normal, parts):
            packed = np.frombuffer(b"".join(map(packed_of, segments)), "<i8")
            ids, ends = (packed >> 32).astype(np.int32), np.cumsum(packed & 0xFFFFFFFF)
            if not self.bytes and len(ids):  # runs of unknowns may meet at segment borders
                last = np.flatnonzero(np.append((ids[:-1] != self.unknown) | (ids[1:] != self.unknown), True))
                ids, ends = ids[last], ends[last]
            bounds = align[np.append(0, ends)]
            yield ids, bounds[:-1], bounds[1:]

    def decode(self, ids) -> str:
        """The text of ``ids``: byte pieces joined into characters, control ids silent, the first space dropped."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not self.squeeze and self.plain[ids].all():
            text = "".join(map(self.surface.__getitem__, ids.tolist()))
            return text[1:] if self.dummy_prefix and self.pieces[ids[0]].startswith(SPACE) else text
        return self._decode_stepwise(ids.tolist())

    def _decode_stepwise(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        start = True
        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(decode_bytes(bytes(run)))
                run.clear()
                start = False
            if kind == CONTROL:
                continue
            piece = self.unknown_surface if kind == UNKNOWN else self.pieces[i]
            if start and kind == NORMAL and (self.dummy_prefix or self.squeeze) and piece.startswith(SPACE):
                piece = piece.lstrip(SPACE) if self.squeeze else piece[1:]
                start = self.squeeze and not piece
            else:
                start = False
            out.append(piece.replace(SPACE, " ") if kind == NORMAL else piece)
        if run:
            out.append(decode_bytes(bytes(run)))
        return "".join(out)


def decode_bytes(raw: bytes) -> str:
    """Well-formed characters; U+FFFD for each byte that belongs to none."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        i += n
    return "".join(out)
