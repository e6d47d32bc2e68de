"""Vector code compression: product codes whose nearest entries are found in a trie over distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.session import ship_package, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest integer component: squared distances over 64 dimensions then stay within 63 bits.
MOST = 1 << 27
#: Leaves below which a subtree of the trie is walked level by level at once.
SUBTREE = 4096
#: Vectors whose parts are held against each other at a time when codes are given out.
BLOCK = 20_000


@dataclass
class Codes:
    """``rows``: key, added columns, ``code`` and ``error``; ``codebooks``: part x entry x place, few numbers."""

    rows: DataFrame
    codebooks: np.ndarray


def walk(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, distance) for lexicographically sorted distinct ``parts`` (rows of integers).

    The rows are the leaves of a trie with a level for each dimension. The walk is depth first; a node
    carries the squared distances of its prefix to all entries, so a dimension that many parts share is
    added once. Neighbouring subtrees of at most ``SUBTREE`` leaves together are finished in one go, level by
    level, with the same shared sums, so memory is bounded by that number and the depth. Equal distances go
    to the lower entry.
    """
    n, dims = parts.shape
    nearest, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    changed = np.ones((n, dims), bool)  # does the prefix up to this dimension begin at this row?
    changed[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
    # Neighbouring nodes of one depth: where they begin and end, and the sums they carry.
    todo = [(np.zeros(1, np.int64), n, 0, np.zeros((1, len(entries)), np.int64))] if n else []
    while todo:
        begins, high, depth, above = todo.pop()
        low = int(begins[0])
        if high - low > SUBTREE and len(begins) > 1:
            half = int(np.clip(np.searchsorted(begins, (low + high) // 2), 1, len(begins) - 1))
            todo.append((begins[half:], high, depth, above[half:]))
            todo.append((begins[:half], int(begins[half]), depth, above[:half]))
            continue
        step = depth + 1 if high - low > SUBTREE else dims
        node = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, high)))
        for d in range(depth, step):
            first = changed[low:high, d]
            first[0] = True
            below = np.flatnonzero(first)
            gap = parts[low + below, d][:, None] - entries[None, :, d]
            above = above[node[below]] + gap * gap
            node, begins = np.cumsum(first) - 1, low + below
        if step < dims:
            todo.append((begins, high, step, above))
        else:
            nearest[low:high] = above.argmin(1)[node]
            distance[low:high] = above.min(1)[node]
    return nearest, distance


def _floors(batch: pa.Array) -> np.ndarray:
    """The integer components of a list column, one row for each vector; all have one length."""
    flat = np.floor(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > MOST:
        raise ValueError(f"components beyond {MOST // SCALE} cannot be coded")
    return flat.astype(np.int64).reshape(len(batch), -1)


def _kept(vectors: DataFrame, key: str, vector: str, also: Sequence[str]) -> DataFrame:
    """Key, ``also`` and vector of the rows with finite components, in one struct ``row`` and ``vec``."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in (key, *also)])
    vec = F.col(f"`{vector}`").cast("array<double>")
    # NaN is above every number, infinity included.
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(row.alias("row"), vec.alias("vec")).where(fine)


def distinct_parts(vec: np.ndarray, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in order, place of each vector's part among them, times) of one part position."""
    return np.unique(vec[:, part * width:(part + 1) * width], axis=0, return_inverse=True, return_counts=True)


def refined(parts: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` of assignment and integer means over the staged distinct ``parts``.

    A task keeps nothing but sums over its parts; the driver gets one row for each entry and part.
    """
    spark = parts.sparkSession
    n_parts, n_entries, width = codebooks.shape
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(codebooks)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            count, total = np.zeros((n_parts, n_entries), np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                number, times = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                rows = batch.column(1).flatten().to_numpy().reshape(-1, width)
                for part in np.unique(number).tolist():
                    own = number == part
                    order = np.lexsort(rows[own].T[::-1])
                    leaves, weight = rows[own][order], times[own][order]
                    near, _ = walk(leaves, books[part])
                    np.add.at(count[part], near, weight)
                    np.add.at(total[part], near, leaves * weight[:, None])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
                 pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=schema.names)

        found = parts.mapInArrow(assign, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()
        codebooks = codebooks.copy()
        for row in found:
            codebooks[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
        sent.unpersist()
    return codebooks


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", also: Sequence[str] = (),
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors with finite components, and the codebooks behind them.

    Each component x becomes floor(4096 x). A codebook begins with the parts of the ``entries`` vectors
    of least key (nulls last, then by vector; fewer where there are fewer vectors) and is refined in
    ``rounds``: every part goes to its nearest entry, the lower one of equals, and an entry becomes the floor of its parts' mean, or stays
    if it has none. ``rows`` has ``key``, the ``also`` columns, ``code`` (two hex digits a part) and ``error``
    (squared distances summed). Equal parts are counted before any shuffle and once more after it, so a vector that
    fills a third of the table is one row a part. Rows that are dropped: null vectors and those with null, NaN or infinite
    components. Columns ``code`` and ``error`` are replaced. An empty table gives an empty result and empty codebooks. Vectors of unlike or indivisible
    length and components beyond 32,768 are errors.
    """
    ship_package(vectors.sparkSession)
    also = [c for c in also if c not in (key, "code", "error")]
    kept = stage(_kept(vectors, key, vector, also), "vectors")
    bounds = kept.agg(F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high")).first()
    length = bounds["high"] or 0
    if bounds["low"] is not None and (bounds["low"] != length or length % parts):
        raise ValueError(f"vectors need one length that {parts} divides, found {bounds['low']} to {length}")
    width = length // parts
    name = F.col(f"row.`{key}`")
    first = kept.select(name.alias("name"), "vec").orderBy(F.asc_nulls_last("name"), "vec").limit(entries).collect()
    start = np.array([np.floor(np.array(r["vec"], float) * SCALE) for r in first]).astype(np.int64)
    start = start.reshape(len(first), parts, width).transpose(1, 0, 2)
    books = refined(_counted_parts(kept, parts, width), start, rounds) if start.size else start
    return Codes(_coded(kept, key, also, books), books)


def _counted_parts(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """Distinct parts with their counts, in ranges, so that the parts of a task share prefixes."""
    schema = "part int, value array<long>, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                vec = _floors(whole.column(0).slice(at, BLOCK))
                for part in range(parts):
                    leaves, _, times = distinct_parts(vec, part, width)
                    values = pa.ListArray.from_arrays(
                        pa.array(np.arange(0, leaves.size + 1, width), pa.int32()), pa.array(leaves.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(leaves), part), pa.int32()), values, pa.array(times, pa.int64())],
                        names=["part", "value", "n"])

    found = kept.select("vec").mapInArrow(count, schema).groupBy("part", "value").agg(F.sum("n").alias("n"))
    return stage(found.repartitionByRange("part", "value").sortWithinPartitions("part", "value"), "parts")


def _coded(kept: DataFrame, key: str, also: Sequence[str], books: np.ndarray) -> DataFrame:
    """``key``, ``also``, ``code`` and ``error`` of every vector; equal parts of a block are walked to once."""
    n_parts, _, width = books.shape
    own = kept.select("row").schema["row"]
    schema = T.StructType([own, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                vec = _floors(batch.column(1))
                digits, error = np.zeros((batch.num_rows, n_parts), np.uint8), np.zeros(batch.num_rows, np.int64)
                for part in range(n_parts if width else 0):
                    leaves, place, _ = distinct_parts(vec, part, width)
                    near, distance = walk(leaves, sent.value[part])
                    digits[:, part] = near[place.ravel()]
                    error += distance[place.ravel()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([d.tobytes().hex() for d in digits]), pa.array(error)], names=schema.names)

    found = kept.select("row", "vec").mapInArrow(code, schema)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in (key, *also)], "code", "error")


def error_by(rows: DataFrame, label: str, name: str = "label_error") -> DataFrame:
    """``rows`` with the sum of ``error`` over all rows of an equal ``label``; nulls are one label.

    The sums are a staged table of one row a label: joined by broadcast while it is small.
    """
    coded = stage(rows, "codes")
    sums = stage(coded.groupBy(F.col(label).alias("of")).agg(F.sum("error").alias(name)), "label-errors")
    return coded.join(sums, coded[label].eqNullSafe(sums["of"])).drop(sums["of"])


def fingerprint(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
