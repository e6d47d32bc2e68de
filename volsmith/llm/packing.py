"""Best-fit packing of tokenized documents by hierarchical merging of underfull bins."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.llm.common import text_of
from volsmith.llm.splitting import splitter
from volsmith.session import ship_package, stage

CAPACITY = 1024
#: Tokens that may be missing from a bin that is not looked at again.
SLACK = 8
#: Items that one task packs at a time: about 20 MB of numbers.
BLOCK = 200_000
#: Matches whose ids a Python worker remembers, in two generations, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it shows, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Ids:
    """Ids of texts by a tokenizer; of texts split by its own pattern, each distinct match once.

    Added tokens come before the pattern and may span its matches, so a text that holds one is encoded whole.
    Matches whose ids are known are kept in two generations: when the young one is full it becomes the old one,
    and what is asked for again moves over, so frequent matches stay. It changes no result.
    """

    def __init__(self, content: bytes, pattern: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A normaliser may turn other texts into added tokens, or change matches by what is around them.
        by_match = pattern and self.tokenizer.normalizer is None
        holds_added = regex.compile("|".join(map(regex.escape, added)) if added else "(?!)").search
        self.is_whole = holds_added if by_match else lambda text: True
        self.split = splitter(pattern) if by_match else None
        before = json.loads(content).get("pre_tokenizer") or {}
        self.byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _of_matches(self, matches: list[str]) -> Iterator[bytes]:
        """Ids of single matches; a byte-level model may be asked without the steps before it."""
        if self.byte_level:
            run, letters = self.tokenizer.model.tokenize, self.letters
            for m in matches:
                ids = [t.id for t in run(m.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]
                yield struct.pack(f"<{len(ids)}I", *ids)
        else:
            for e in self.tokenizer.encode_batch_fast(matches, add_special_tokens=False):
                yield struct.pack(f"<{len(e.ids)}I", *e.ids)

    def of_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.young) >= REMEMBERED // 2:
            self.young, self.old = {}, self.young
        whole = [i for i, t in enumerate(texts) if t and self.is_whole(t)]
        coded = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        of_whole = {i: np.array(e.ids, dtype="<u4") for i, e in zip(whole, coded, strict=True)}
        matches = [self.split(t) if t and i not in of_whole else [] for i, t in enumerate(texts)]
        young, old = self.young, self.old
        # Long matches are looked up once and not kept.
        unknown = set().union(*matches).difference(young)
        again = unknown.intersection(old) if old else ()
        young.update((m, old[m]) for m in again)
        fresh = list(unknown.difference(again))
        young.update(zip(fresh, self._of_matches(fresh), strict=True))
        found = [of_whole[i] if i in of_whole else np.frombuffer(b"".join(map(young.__getitem__, own)), dtype="<u4")
                 for i, own in enumerate(matches)]
        for m in fresh:
            if len(m) > LONGEST:
                del young[m]
        return found


@lru_cache(maxsize=2)
def _ids(content: bytes, pattern: str | None) -> _Ids:
    return _Ids(content, pattern)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, pattern: str | None = None, text: str = "text",
                 key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: key, piece, start, length, token_ids.

    A document is its ids and ``end_id``. Only documents longer than ``capacity`` are cut; all
    pieces but the first are then full. ``pattern`` is the expression by which the tokenizer itself
    splits text; with it, distinct matches are encoded once, but for texts that hold one of the tokenizer's
    added tokens; either way the ids are those of the tokenizer for the whole text. Null and empty
    texts are one piece of the end id. Rows that repeat a key are documents of their own.
    """
    ship_package(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("token_ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(content.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                source, piece, start, length, held = [], [], [], [], []
                for row, own in enumerate(ids.of_batch(batch.column(1).to_pylist())):
                    own = np.append(own, np.array([end_id], dtype="<u4"))
                    begin, number = 0, 0
                    end = (len(own) - 1) % capacity + 1
                    while begin < len(own):
                        source.append(row)
                        piece.append(number)
                        start.append(begin)
                        length.append(end - begin)
                        held.append(own[begin:end].tobytes())
                        begin, end, number = end, end + capacity, number + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(source, pa.int32())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(held, pa.binary())],
                    names=[key, "piece", "start", "length", "token_ids"])

    return docs.select(F.col(key), text_of(text).alias("text")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: longest first, into the fullest bin that still has room."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r of rooms: some bin has r tokens of room
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        if fitting := rooms >> need:
            room = need + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, number, made = capacity, made, made + 1
        bins[item], offsets[item] = number, capacity - room
        if left := room - need:
            by_room[left].append(number)
            rooms |= 1 << left
    return bins, offsets


def _merge_bins(table: pa.Table, capacity: int) -> pa.Table:
    """Rows with the bins of ``table`` packed into each other as whole items."""
    bins, place, fill = (table.column(c).to_numpy() for c in ("sequence_id", "offset", "fill"))
    names, first, member = np.unique(bins, return_index=True, return_inverse=True)
    number, shift = best_fit(fill[first], capacity)
    new_fill = np.bincount(number, weights=fill[first]).astype(np.int64)
    name = np.empty(len(new_fill), np.int64)
    name[number[shift == 0]] = names[shift == 0]  # a bin is called after the one at its beginning
    for column, values in (("sequence_id", name[number][member]), ("offset", place + shift[member]),
                           ("fill", new_fill[number][member])):
        table = table.set_column(table.schema.get_field_index(column), column, pa.array(values, pa.int64()))
    return table


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, block: int = BLOCK) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``; sequences hold ``capacity`` tokens at most.

    Each task packs its own pieces by best fit, ``block`` at a time. Bins that miss at most ``slack``
    tokens are finished; the others become items, are dealt by hash to about one task for each ``block`` of
    them and packed again, until one task has packed all that is left or a round brings nothing.
    Rows hold numbers only and carry their place along, so no join is needed. Pieces longer than
    ``capacity`` are an error. No pieces, no rows. Columns ``sequence_id``, ``offset`` and ``fill`` are
    replaced.
    """
    ship_package(pieces.sparkSession)
    own = [c for c in pieces.columns if c not in {"sequence_id", "offset", "fill"}]
    items = stage(pieces.select(*own, F.monotonically_increasing_id().alias("sequence_id"),
                                F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill")), "pieces")
    schema = items.schema

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield from _merge_bins(pa.Table.from_batches(held), capacity).to_batches()
                held, rows = [], 0
        if rows:
            yield from _merge_bins(pa.Table.from_batches(held), capacity).to_batches()

    def together(table: pa.Table) -> pa.Table:
        return _merge_bins(table.drop_columns(["group"]), capacity)

    packed = stage(items.mapInArrow(local, schema), "packed")
    unfinished = F.col("fill") < capacity - slack
    done, left = [packed.where(~unfinished)], packed.where(unfinished)
    bins, turn = left.where("offset = 0").count(), 0
    while bins > 1:
        groups = ceil(bins / block)
        group = F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups))
        packed = stage(left.withColumn("group", group).groupBy("group").applyInArrow(together, schema), "packed")
        if groups > 1:
            done.append(packed.where(~unfinished))
            left = packed.where(unfinished)
            now = left.where("offset = 0").count()
        else:
            left, now = packed, 0
        if now > 0.98 * bins:
            break
        bins, turn = now, turn + 1
    for part in done:
        left = left.unionByName(part)
    return left.drop("fill")
