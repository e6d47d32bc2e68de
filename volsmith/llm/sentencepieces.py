"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.llm.common import text_of
from volsmith.session import ship_package

#: Characters of texts whose distinct words make up one table.
SLICE_CHARS = 4_000_000

MARK = "▁"
#: White space that stays as it is; where no piece holds such a character, words end before it too.
PLAIN_SPACE = "\t\n\r"


@lru_cache(maxsize=2)
def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(maxsize=2)
def borders(model: bytes) -> str | None:
    """Characters that no piece holds behind another one, the marker first; None if pieces may cross the marker.

    A merge across such a border would need a piece that crosses it, so a text's pieces are those of the
    words between borders, one after another. The model may neither drop nor add white space but for one
    marker in front.
    """
    processor = _processor(model)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    crossing = any(MARK in p.lstrip(MARK) for p in pieces)
    probe = "  a \t b  "
    if crossing or processor.normalize(probe) != MARK + probe.replace(" ", MARK):
        return None
    return MARK + "".join(c for c in PLAIN_SPACE if not any(c in p for p in pieces))


@lru_cache(maxsize=4)
def _words(ends: str) -> Callable[[str], list[str]]:
    return re.compile(f"(?:{MARK}+|[{ends}])[^{ends}]*").findall


def marked_words(text: str, ends: str) -> list[str]:
    """The words of a text that is not empty: a run of markers or one other border, and all up to the next border."""
    return _words(ends)(MARK + text.replace(" ", MARK))


def segmented(model: bytes, words: list[str]) -> list[bytes]:
    """Ids of each word as little-endian 32-bit integers.

    The library puts a marker in front of what it is given, but not before nothing; before a border that is no
    marker it stays a piece of its own.
    """
    run = _processor(model).encode
    alone = run(f"a{MARK}")[len(run("a")):]
    marked = [w[0] == MARK for w in words]
    coded = run([w[1:] if m else w for w, m in zip(words, marked, strict=True)])
    return [np.array(alone if w == MARK else ids if m else ids[len(alone):], "<i4").tobytes()
            for w, m, ids in zip(words, marked, coded, strict=True)]


def _coded(model: bytes, texts: list[str], end: bytes) -> list[bytes]:
    """Ids of each text by a table of the distinct words of all of them."""
    if (ends := borders(model)) is None:
        return [np.array(ids, "<i4").tobytes() + end for ids in _processor(model).encode(texts)]
    places: defaultdict[str, int] = defaultdict(lambda: len(places))
    codes = [list(map(places.__getitem__, marked_words(t, ends))) if t else [] for t in texts]
    table = segmented(model, list(places))
    return [b"".join(map(table.__getitem__, own)) + end for own in codes]


def encode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", end_id: int | None = None,
           decoded: bool = False, chars: int = SLICE_CHARS) -> DataFrame:
    """``key`` and ``token_ids`` (array) of every row; with ``decoded`` the text that they stand for.

    The ids are those of the sentencepiece library for the whole text, without sampling, then ``end_id``
    if given. A task takes some ``chars`` characters of texts at a time (one text if it is longer), makes a
    table of their distinct marked words, segments each of these once and puts the ids together by place,
    so it needs no shuffle and holds no more than the texts at hand. A model whose pieces may cross white
    space codes whole texts. Null and empty texts have no ids but the end id and decode to the empty
    text; rows that repeat a key or text are encoded by themselves; an empty table gives an empty result;
    other columns are not read. The model file (of fixed size) is sent to the executors.
    """
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    end = b"" if end_id is None else np.array([end_id], "<i4").tobytes()
    schema = T.StructType([docs.schema[key], T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
                          + [T.StructField("decoded", T.StringType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            cuts = np.flatnonzero(np.diff(size // chars, prepend=0)).tolist()
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                if low < high:
                    coded = _coded(model.value, batch.column(1).slice(low, high - low).to_pylist(), end)
                    columns = [batch.column(0).slice(low, high - low), _lists(coded)]
                    if decoded:
                        columns.append(pa.array(_texts(model.value, coded), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(f"`{key}`"), text_of(f"`{text}`").alias("text")).mapInArrow(run, schema)


def _lists(coded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def _texts(model: bytes, coded: list[bytes]) -> list[str]:
    run = _processor(model).decode
    return [run(np.frombuffer(c, "<i4").tolist()) if c else "" for c in coded]


def decode(rows: DataFrame, model_path: str, column: str = "token_ids") -> DataFrame:
    """Every row with ``decoded``: the library's text for its ids; empty for null and for no ids."""
    ship_package(rows.sparkSession)
    model = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    schema = T.StructType([f for f in rows.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                kept = [c for c in batch.schema.names if c != "decoded"]
                found = [processor.decode(ids) if ids else "" for ids in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, "decoded"])

    return rows.mapInArrow(run, schema)
