"""Byte-level BPE: merges by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volsmith.llm.splitting import splitter
from volsmith.session import ship_package

NONE = 1 << 40
#: Matches whose ids a Python worker remembers (about 60 MB) in two generations, and the longest of them.
#: When the young one is full it becomes the old one; what is met again moves over. It changes no result.
REMEMBERED, LONGEST = 250_000, 64


@lru_cache(maxsize=4)
def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


@lru_cache(maxsize=4)
def read_tokens(content: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(content).items()}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``data`` (not empty) after all merges.

    A leaf stands at each byte where a token begins and holds the rank of that token joined with the next
    one; inner nodes hold the lower rank of their children. The root tells the next merge, the way
    down, left first, its leftmost place. A merge changes three leaves: the merged token's, the one
    before it, and the one that it swallows.
    """
    if (whole := ranks.get(data)) is not None:
        return [whole]
    n = len(data)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(data[i:i + 2], NONE)
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left <= right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, rank: int) -> None:
        k = size + place
        tree[k] = rank
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            low = left if left <= right else right
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (low := tree[1]) < NONE:
        k = 1
        while k < size:
            k = 2 * k if tree[2 * k] == low else 2 * k + 1
        start = k - size
        swallowed = after[start]
        end = after[swallowed]
        after[start] = end
        put(swallowed, NONE)
        if end < n:
            before[end] = start
            put(start, ranks.get(data[start:after[end]], NONE))
        else:
            put(start, NONE)
        if (previous := before[start]) >= 0:
            put(previous, ranks.get(data[previous:end], NONE))

    ids, i = [], 0
    while i < n:
        ids.append(ranks[data[i:after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, content: bytes, pattern: str) -> None:
        self.ranks = read_ranks(content)
        self.split = splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if len(self.known) >= REMEMBERED // 2:
            self.known, self.old = {}, self.known
        known, old, parts = self.known, self.old, []
        for match in self.split(text):
            packed = known.get(match)
            if packed is None:
                packed = old.get(match)
                if packed is None:
                    packed = np.array(merge(match.encode("utf-8", "surrogatepass"), self.ranks), dtype="<u4").tobytes()
                if len(match) <= LONGEST:
                    known[match] = packed
            parts.append(packed)
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(content, pattern)


def _with_column(batch: pa.RecordBatch, name: str, values: list[bytes]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values, pa.binary())], names=[*kept, name])


def _schema_with(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in names] + [T.StructField(n, T.BinaryType()) for n in names])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that a worker holds little besides its input."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield batch.slice(at, 200)


def _encoded(batches: Iterator[pa.RecordBatch], text: str, content: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    run = encoder(content, pattern).encode
    for batch in _slices(batches):
        yield _with_column(batch, "token_ids", [run(t or "") for t in batch.column(text).to_pylist()])


def _decoded(batches: Iterator[pa.RecordBatch], column: str, content: bytes) -> Iterator[pa.RecordBatch]:
    tokens = read_tokens(content)
    for batch in _slices(batches):
        yield _with_column(batch, "decoded", [
            b"".join(map(tokens.__getitem__, np.frombuffer(b or b"", "<u4").tolist())) for b in batch.column(column).to_pylist()])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``token_ids``: binary, four little-endian bytes an id.

    The text is split by ``pattern`` and each match is merged by itself, lowest rank first and
    leftmost among equals. Null and empty texts have no ids; rows are encoded by themselves; an empty table
    gives an empty result; an existing column ``token_ids`` is replaced. The rank file (of fixed
    size) is read once on the driver and sent to the executors.
    """
    ship_package(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    return docs.mapInArrow(lambda b: _encoded(b, text, content.value, pattern), _schema_with(docs, "token_ids"))


def decode(rows: DataFrame, ranks_path: str, column: str = "token_ids") -> DataFrame:
    """Every row with ``decoded``: the bytes that its ids stand for; none for null."""
    ship_package(rows.sparkSession)
    content = rows.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    return rows.mapInArrow(lambda b: _decoded(b, column, content.value), _schema_with(rows, "decoded"))


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass of one Python worker: ``token_ids`` and ``decoded`` of every row."""
    ship_package(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    return docs.mapInArrow(
        lambda b: _decoded(_encoded(b, text, content.value, pattern), "token_ids", content.value),
        _schema_with(docs, "token_ids", "decoded"))
