"""Texts as slices: a few megabytes of text, its distinct parts once, and each text as places in that list.

A corpus-wide table over distinct parts then needs no row for each occurrence: a part is looked up once a
slice, however often it stands there, and texts are put together again by place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.llm.common import text_of
from volsmith.session import ship_package, stage

#: Characters after which a slice is closed; a longer text is a slice of its own.
SLICE_CHARS = 4_000_000
#: Characters that a row counts besides its text, so that empty texts close a slice too.
ROW_CHARS = 16
PARTS = T.StructType([
    T.StructField("slice", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("group", T.StringType()),
    T.StructField("part", T.StringType()), T.StructField("n", T.LongType())])


class _Slice:
    """The open slice of a task: rows, their codes, and codes of distinct parts by group."""

    def __init__(self, number: int) -> None:
        self.number, self.chars = number, 0
        self.rows: list[int] = []
        self.codes: list[np.ndarray] = []
        self.place = count()
        self.by_group: dict = defaultdict(lambda: defaultdict(self.place.__next__))

    def add(self, group: str | None, parts: list[str]) -> None:
        place = self.by_group[group].__getitem__
        self.codes.append(np.fromiter(map(place, parts), np.int32, len(parts)))

    def parts(self) -> pa.RecordBatch:
        """Every distinct part with its place, group and number of occurrences."""
        groups, parts, places = [], [], []
        for group, known in self.by_group.items():
            groups += [group] * len(known)
            parts += known.keys()
            places += known.values()
        codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.int32)
        times = np.bincount(codes, minlength=len(places))[places] if places else []
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(places), self.number), pa.int64()), pa.array(places, pa.int32()),
             pa.array(groups, pa.string()), pa.array(parts, pa.string()), pa.array(times, pa.int64())], names=PARTS.names)


def sliced(docs: DataFrame, split: Callable[[str], list[str]], keys: list[str], text: str = "text",
           group: str | None = None, chars: int = SLICE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(texts, parts): ``keys``, ``slice`` and ``codes`` of every row; the distinct parts of every slice.

    ``split`` cuts a text into parts. ``codes`` holds a little-endian 32-bit place for each part of the
    text, in order; ``parts`` has (slice, place, group, part, n), n counting occurrences. With
    ``group``, parts of different values of that column are different. A null text is empty and has no
    parts. Both come from one staged pass, so slices keep their numbers when an executor is lost later.
    """
    ship_package(docs.sparkSession)
    fields = [T.StructField(f"key{i}", docs.schema[k].dataType) for i, k in enumerate(keys)]
    text_fields = T.StructType([*fields, T.StructField("codes", T.BinaryType())])
    schema = T.StructType([*text_fields, *PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(text_fields).types
        numbers = count(TaskContext.get().partitionId() << 33)
        now = _Slice(next(numbers))

        def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            """The texts of ``batch`` that the open slice has taken since the last call."""
            taken = pa.array(now.rows, pa.int32())
            codes = pa.array([c.tobytes() for c in now.codes[len(now.codes) - len(now.rows):]], pa.binary())
            number = pa.array(np.full(len(now.rows), now.number), pa.int64())
            nothing = [pa.nulls(len(now.rows), t) for t in (pa.int32(), pa.string(), pa.string(), pa.int64())]
            now.rows = []
            return pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(taken) for i in range(len(fields))), codes, number, *nothing], names=schema.names)

        def parts_of() -> pa.RecordBatch:
            found = now.parts()
            nothing = [pa.nulls(found.num_rows, kind) for kind in kinds]
            return pa.RecordBatch.from_arrays([*nothing, *found.columns], names=schema.names)

        for batch in batches:
            bodies = batch.column(len(fields)).to_pylist()
            groups = batch.column(len(fields) + 1).to_pylist() if group else [None] * len(bodies)
            for row, (body, own) in enumerate(zip(bodies, groups, strict=True)):
                now.rows.append(row)
                now.add(own, split(body) if body else [])
                now.chars += len(body) + ROW_CHARS
                if now.chars >= chars:
                    yield rows_of(batch)
                    yield parts_of()
                    now = _Slice(next(numbers))
            if now.rows:
                yield rows_of(batch)
        if now.codes:
            yield parts_of()

    columns = [F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys)] + [text_of(f"`{text}`").alias("body")]
    columns += [F.col(f"`{group}`").cast("string").alias("own")] if group else []
    both = stage(docs.select(*columns).mapInArrow(run, schema), "slices")
    texts = both.where("codes is not null").select(
        *[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "slice", "codes")
    # New names of the same columns, so that the two can be joined with each other.
    return texts, both.where("part is not null").select(*[F.col(c).alias(c) for c in PARTS.names])
