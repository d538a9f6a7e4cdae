"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut by the tokenizer's pattern; no merge crosses a cut.  Each match is encoded as a tree: its
halves are encoded recursively and neighbours are joined.  A join re-encodes a window around the seam,
first one token from either side, and doubles it until both outer seams are stable.  A seam (a, b) is
stable when the bytes of a and b together encode to (a, b) again; a token sequence all of whose seams are
stable is the encoding of its bytes, so tokens outside the window provably do not change.  Halves are cut
at the largest power of two below the length, so that equal prefixes share memo entries.

Decoding concatenates byte strings up a tree of halves of the token sequence.

Nulls and empty texts have no tokens; texts of any length and script are handled; row order, repeated rows
and further columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 400_000
LEAF = 4


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBpe:
    """Encoder and decoder for one rank table; memo tables are bounded and live in one Python worker."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        self.ranks, self.memo = ranks, memo
        self.tokens = {i: t for t, i in ranks.items()}
        self.trees: dict[bytes, tuple[int, ...]] = {}
        self.seams: dict[tuple[int, ...], tuple[int, ...]] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Plain merge loop for short strings: the pair of lowest rank first, the leftmost of equals."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def seam(self, a: int, b: int) -> tuple[int, ...]:
        """Encoding of the bytes of two neighbouring tokens."""
        got = self.seams.get((a, b))
        if got is None:
            if len(self.seams) >= self.memo:
                self.seams.clear()
            got = self.seams[a, b] = self.merged(self.tokens[a] + self.tokens[b])
        return got

    def window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of a few neighbouring tokens."""
        got = self.seams.get(ids)
        if got is None:
            got = self.merged(b"".join([self.tokens[t] for t in ids]))
            if len(ids) <= 4:
                self.seams[ids] = got
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid operation: the encoding of the bytes of both sides."""
        if not left or not right:
            return left or right
        k = 1
        while True:
            lo, hi = max(0, len(left) - k), min(k, len(right))
            if k == 1:
                mid = self.seam(left[-1], right[0])
            else:
                mid = self.window(left[lo:] + right[:hi])
            if (lo == 0 or self.seam(left[lo - 1], mid[0]) == (left[lo - 1], mid[0])) and (
                hi == len(right) or self.seam(mid[-1], right[hi]) == (mid[-1], right[hi])
            ):
                return left[:lo] + mid + right[hi:]
            k *= 2

    def tree(self, data: bytes) -> tuple[int, ...]:
        got = self.trees.get(data)
        if got is None:
            if len(data) <= LEAF:
                got = self.merged(data) if data else ()
            else:
                half = 1 << (len(data) - 1).bit_length() - 1
                got = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= 16:
                if len(self.trees) >= self.memo:
                    self.trees.clear()
                self.trees[data] = got
        return got

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of both halves, concatenated up the tree."""
        if len(ids) <= 1:
            return self.tokens[ids[0]] if len(ids) else b""
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: Letters, numbers and white space below U+0100, for the pattern's classes; fixed values of Unicode.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\t\n\x0b\x0c\r \x85\xa0"}


def splitters(pattern: str):
    """(findall for texts below U+0100 by the standard library, findall for all texts by ``regex``)."""
    import regex

    latin = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + LATIN[r"\s"] + LATIN[r"\p{L}"] + LATIN[r"\p{N}"] + "]")
    latin = latin.replace(r"(?!\S)", f"(?![^{LATIN[r'\s']}])")
    for k, v in LATIN.items():
        latin = latin.replace(k, f"[{v}]")
    return re.compile(latin).findall, regex.compile(pattern).findall


class TextBpe:
    """Texts to token ids: the pattern's matches, each through the tree."""

    def __init__(self, path: str, pattern: str):
        self.bpe = TreeBpe(load_ranks(path))
        self.latin, self.any = splitters(pattern)
        self.words: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        try:
            text.encode("latin-1")
            found = self.latin(text)
        except UnicodeEncodeError:
            found = self.any(text)
        words, out = self.words, []
        for w in found:
            got = words.get(w)
            if got is None:
                got = self.bpe.tree(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(words) >= MEMO:
                        words.clear()
                    words[w] = got
            out += got
        return out


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids (array<int>, replacing one of that name)."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = TextBpe(path, pattern)
        for s in batches:
            yield pd.Series([bpe.encode(t) for t in s], dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """``df`` with the bytes of the token ids (binary)."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = TreeBpe(load_ranks(path))
        for s in batches:
            yield pd.Series([b"" if x is None else bpe.decode(list(x)) for x in s], dtype=object)

    return df.withColumn(data, run(F.col(ids)))


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids_sha256, decoded_sha256 of every row: a round trip that ships digests, not ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = TextBpe(path, pattern)
        names = {i: str(i) for i in bpe.bpe.tokens}.__getitem__
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                ids = bpe.encode(t)
                rows.append((len(ids), hashlib.sha256(" ".join(map(names, ids)).encode()).hexdigest(), hashlib.sha256(bpe.bpe.decode(ids)).hexdigest()))
            yield pd.concat([pdf[["k"]], pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=pdf.index)], axis=1)

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", key)
