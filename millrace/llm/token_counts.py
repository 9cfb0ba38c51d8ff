"""Token counts under a byte-level BPE vocabulary, by the whole-token shortcut.

Once, on the driver, every vocabulary string is encoded alone; those that come
out as one token are proven whole tokens. Tasks split each text into
pre-tokens, count a proven one as 1 by a look-up, and merge only the rest,
remembering a bounded number of short ones.

Null text counts as empty (0 tokens). Rows are kept one to one, repeated rows
and null ids included; an existing column of the output's name is replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import NEVER, merge

#: Remembered pre-tokens in a Python worker, besides the proven ones.
MEMO = 300_000


def _class(keep) -> str:
    """The characters for which ``keep(category)`` holds, as ranges for a regex class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and keep(unicodedata.category(chr(c)))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def pre_token_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern, its Unicode classes spelled out."""
    letters, numbers = _class(lambda k: k[0] == "L"), _class(lambda k: k[0] == "N")
    # The contractions, and the code points with the White_Space property.
    contractions = "'s|'t|'re|'ve|'m|'ll|'d"
    space = r"\t-\r \x85\xa0  -     　"
    return re.compile(f"{contractions}| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and specials of a byte-level BPE file, and the cost of each pre-token."""

    def __init__(self, path: str, proven: frozenset[str] | None = None):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        unlike = [
            k
            for k, bad in (
                ("model", model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout")),
                ("normalizer", spec["normalizer"]),
                ("pre_tokenizer", pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)),
                ("added_tokens", any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])),
            )
            if bad
        ]
        if unlike:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {unlike}")
        self.of_byte = byte_symbols()
        self.tokens = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.split = pre_token_pattern().findall
        self.costs = _Costs(self, proven or ())

    def pieces(self, unit: str) -> list[str]:
        of_byte = self.of_byte
        return merge([of_byte[b] for b in unit.encode()], lambda a, b: self.ranks.get((a, b), NEVER))

    def prove(self) -> frozenset[str]:
        """The vocabulary strings that are text and, encoded alone, give exactly one token."""
        to_byte = {s: b for b, s in enumerate(self.of_byte)}
        out = set()
        for token in self.tokens:
            try:
                text = bytes(map(to_byte.__getitem__, token)).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character, or no bytes at all: never a whole pre-token
            if len(self.pieces(text)) == 1:
                out.add(text)
        return frozenset(out)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added.split(text) if self.added else [text]
        return len(parts) - 1 + sum(sum(map(self.costs.__getitem__, self.split(p))) for p in parts)


class _Costs(dict):
    """Tokens of a pre-token: 1 for the proven ones, else by merging, remembered up to ``MEMO``."""

    def __init__(self, vocabulary: Vocabulary, proven):
        super().__init__(dict.fromkeys(proven, 1))
        self.vocabulary, self.most = vocabulary, len(proven) + MEMO

    def __missing__(self, unit: str) -> int:
        n = len(self.vocabulary.pieces(unit))
        if len(unit) <= 64 and len(self) < self.most:
            self[unit] = n
        return n


@lru_cache(4)
def proven_whole_tokens(path: str) -> frozenset[str]:
    return Vocabulary(path).prove()


_loaded: dict[str, Vocabulary] = {}


def token_count(df: DataFrame, path: str, text: str | Column = "text") -> Column:
    """Column with the number of tokens of ``text``; ``path`` names a byte-level BPE .json file."""
    # Bounded by the vocabulary: about 1 MB for 50,000 strings, whatever the corpus.
    proven = df.sparkSession.sparkContext.broadcast(proven_whole_tokens(path))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        if path not in _loaded:
            _loaded[path] = Vocabulary(path, proven.value)
        one = _loaded[path].count
        return pa.array((one(t.as_py()) for t in texts), pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)


def with_token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with ``out``, the number of tokens of ``text``."""
    return df.withColumn(out, token_count(df, path, text))
