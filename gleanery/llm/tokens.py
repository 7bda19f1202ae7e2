"""Byte-level BPE encoding of a corpus with the vocabulary of a public tokenizer.

Texts are cut into pre-tokens by the tokenizer's pattern; each distinct pre-token is encoded once per worker and
remembered. The encoder proper keeps, for every merge rank, a bucket of linked-list positions, and finds the next
rank with find-first-set over a three-level bitmap of 64-bit words, so that a pre-token of any length takes time in
proportion to its merges. Entries whose pair has changed since are stale and skipped.

Defined results: a null and an empty text give an empty list; strings that look like special tokens are ordinary
text. The vocabulary file stays where it is: its path is a parameter and must exist on every executor.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-token pattern of byte_bpe_50k (a fixed value of that tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens of up to this many characters are remembered, and at most so many; beyond, the memory starts anew.
REMEMBERED_CHARS, REMEMBERED = 64, 300_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file in the folder of public tokenizers: $PUBLIC_TOKENIZERS, the installed package or /opt/tokenizers."""
    if "PUBLIC_TOKENIZERS" in os.environ:
        return os.path.join(os.environ["PUBLIC_TOKENIZERS"], name)
    spec = importlib.util.find_spec("public_tokenizers")
    base = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(base, name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by merge rank; ``pop`` gives the lowest rank with its positions in ascending order."""

    def __init__(self, ranks: int) -> None:
        n0 = (ranks >> 6) + 1
        n1 = (n0 >> 6) + 1
        self.words, self.middle, self.top = [0] * n0, [0] * n1, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        w, m = rank >> 6, rank >> 12
        self.words[w] |= 1 << (rank & 63)
        self.middle[m] |= 1 << (w & 63)
        self.top |= 1 << m

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        w = (m << 6) + (self.middle[m] & -self.middle[m]).bit_length() - 1
        rank = (w << 6) + (self.words[w] & -self.words[w]).bit_length() - 1
        self.words[w] &= self.words[w] - 1
        if not self.words[w]:
            self.middle[m] &= self.middle[m] - 1
            if not self.middle[m]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Encodes pre-tokens and texts with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.find = regex.compile(pattern).findall
        self.memory = _Memory(self)
        self.queue = RankQueue(self.size)  # empty after every merge, so one serves them all

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes: always the lowest rank first, the leftmost of equal ones first."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        ends = list(range(1, n + 1))  # of the part that begins at a position
        before = list(range(-1, n - 1))
        pair: list[int] = [-1] * n  # rank of a part merged with the next, -1: none or no longer a part
        queue = self.queue
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        while (lowest := queue.pop()) is not None:
            rank, positions = lowest
            for i in positions:
                if pair[i] != rank:
                    continue
                j = ends[i]
                end = ends[i] = ends[j]
                pair[j] = -1
                if end < n:
                    before[end] = i
                    r = ranks.get(data[i : ends[end]])
                    pair[i] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, i)
                else:
                    pair[i] = -1
                p = before[i]
                if p >= 0:
                    r = ranks.get(data[p:end])
                    if r is None:
                        pair[p] = -1
                    elif r != pair[p]:
                        pair[p] = r
                        queue.push(r, p)
                    else:
                        queue.push(r, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as native 32-bit integers."""
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        return b"".join([memory[w] for w in self.find(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist() if text else []


class _Memory(dict):
    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.encoder.merge(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= REMEMBERED_CHARS:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(load_ranks(path))


def _encoded(path: str, column: str, result: str, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = batch.column(at).to_pylist()
            parts = [enc.encode_bytes(t) if t else b"" for t in texts]
            sizes = np.fromiter((len(p) >> 2 for p in parts), dtype=np.int64, count=len(parts))
            if count:
                made = pa.array(sizes.astype(np.int32))
            else:
                offsets = np.zeros(len(parts) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
                made = pa.ListArray.from_arrays(pa.array(offsets), values)
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], names=[*(batch.schema.field(i).name for i in keep), result])

    return run


def _apply(df: DataFrame, text: str, result: str, path: str | None, kind: T.DataType, count: bool) -> DataFrame:
    if result in df.columns and result != text:
        raise ValueError(f"the table has a column {result} already")
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField(result, kind)])
    return df.mapInArrow(_encoded(path or tokenizer_path(), text, result, count), schema)


def encode_texts(df: DataFrame, text: str = "text", result: str = "ids", path: str | None = None) -> DataFrame:
    """The table with ``text`` replaced by the list of its token ids (never null). A map over the scan: no shuffle.

    Give it only the columns to keep: all of them pass through the workers.
    """
    return _apply(df, text, result, path, T.ArrayType(T.IntegerType()), False)


def count_tokens(df: DataFrame, text: str = "text", result: str = "n_tokens", path: str | None = None) -> DataFrame:
    """The table with ``text`` replaced by its number of tokens, 0 for null and empty texts."""
    return _apply(df, text, result, path, T.IntegerType(), True)
