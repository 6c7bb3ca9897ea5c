"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Pre-tokens that are no single token are merged by a rank queue: a bucket per merge rank holds
places of a linked list of symbols, a three-level bitmap of the ranks in use gives the next one
by find-first-set, and entries that an earlier merge made stale are skipped. A pre-token of n
bytes takes about n log n steps, so very long ones (no spaces, one repeated character) are no
trouble.
"""

from __future__ import annotations

import base64
import importlib.util
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: pre-token pattern of the vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers, the longest of them in characters, and remembered pairs:
#: some 100 MB a worker at most.
REMEMBERED, REMEMBERED_LENGTH, PAIRS = 200_000, 48, 400_000
#: The vocabulary is sent to the executors; a larger file than this is refused.
MAX_VOCABULARY_BYTES = 64_000_000


class RankQueue:
    """Buckets of list places by merge rank, with a three-level bitmap of non-empty ones."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.high = 0

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, place)
            return
        self.buckets[rank] = [place]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.middle[b] = self.middle.get(b, 0) | 1 << (a & 63)
        self.high |= 1 << b

    def pop(self) -> tuple[int, int] | None:
        """The smallest rank with its leftmost place; None when empty."""
        if not self.high:
            return None
        b = (self.high & -self.high).bit_length() - 1
        middle = self.middle[b]
        a = b << 6 | (middle & -middle).bit_length() - 1
        low = self.low[a]
        rank = a << 6 | (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        place = heappop(bucket)
        if not bucket:
            self.low[a] = low = low & (low - 1)
            if not low:
                self.middle[b] = middle = middle & (middle - 1)
                if not middle:
                    self.high &= self.high - 1
        return rank, place


class Encoder:
    """Encodes texts by the ranks of a vocabulary (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}

    def _rank(self, left: int, right: int) -> int:
        """Rank at which two symbols merge, which is the id of what they make; -1 if never."""
        pair = left, right
        rank = self.pairs.get(pair)
        if rank is None:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
            if len(self.pairs) < PAIRS:
                self.pairs[pair] = rank
        return rank

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        symbol = [self.single[b] for b in data]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            rank = self._rank(symbol[i], symbol[i + 1])
            if rank >= 0:
                queue.push(rank, i)
        while (top := queue.pop()) is not None:
            rank, i = top
            j = after[i]
            if symbol[i] < 0 or j >= n or self._rank(symbol[i], symbol[j]) != rank:
                continue  # stale
            symbol[i], symbol[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                made = self._rank(rank, symbol[k])
                if made >= 0:
                    queue.push(made, i)
            h = before[i]
            if h >= 0:
                made = self._rank(symbol[h], rank)
                if made >= 0:
                    queue.push(made, h)
        return [s for s in symbol if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty and a null text have none."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for part in self.split(text):
            ids = known.get(part)
            if ids is None:
                ids = self.merge(part.encode("utf-8", "replace"))
                if len(part) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            out += ids
        return out


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank per line."""
    return _parse_ranks(Path(path).read_bytes())


def _parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_ENCODERS: dict[int, Encoder] = {}


def token_ids(spark: SparkSession, documents: DataFrame, path: str | None = None) -> DataFrame:
    """One row (doc_id, ids) per row of ``documents``; null and empty texts give an empty list.

    Special tokens' strings are ordinary text. Rows that are repeated come out repeated.
    """
    data = Path(path or vocabulary_path()).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {len(data)} bytes")
    sent = spark.sparkContext.broadcast(data)

    def batch(texts: pd.Series) -> pd.Series:
        key = hash(sent.value)
        encoder = _ENCODERS.get(key)
        if encoder is None:
            encoder = _ENCODERS[key] = Encoder(_parse_ranks(sent.value))
        return pd.Series([np.array(encoder.encode(t), dtype=np.int32) for t in texts], dtype=object)

    ids = F.pandas_udf(batch, T.ArrayType(T.IntegerType(), False))
    return documents.select("doc_id", ids("text").alias("ids"))
