"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsmith.session import ship_package, stage, staging_root

#: The skippable frame in front of an archive that holds its dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 32_768
#: A dictionary is trained on pieces of so many bytes, spread evenly over its archive's records, and on at most so
#: many bytes of them together.
SAMPLE_BYTES, TRAINING_BYTES = 2048, 2_000_000
#: A new archive begins when this many payload bytes are in one.
ARCHIVE_BYTES = 64_000_000
#: Payloads shorter than this are stored each time.
REVISIT_BYTES = 1000
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, payload_bytes long, dictionary_bytes long, archive_bytes long"


def with_record_types(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Page, url, payload, digest, record type and the page referred to, one row a page.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the largest page id is the response and the others
    revisit it. Only digests are shuffled to find them; the groups of several pages are joined back by
    their measured size. Rows that repeat the largest id are all responses.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page).alias("page_id"), F.col("url"), payload.alias("payload"),
                        F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("size"))
    groups = stage(
        rows.where(F.col("size") >= REVISIT_BYTES).groupBy("payload_digest", "size")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    joined = rows.join(groups, ["payload_digest", "size"], "left")
    revisit: Column = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "size",
        F.when(revisit, F.col("first_id")).alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    held = name.removeprefix("<urn:page:").removesuffix(">")
    return None if held == "none" else int(held)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int,
           refers_to: int | None) -> bytes:
    """One WARC/1.1 record; without a payload a revisit, whose block keeps the HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload or b""
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _name(page_id)),
              ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if payload is None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def samples_of(records: list[bytes]) -> list[bytes]:
    """Pieces of all records, long ones in several, evenly thinned to ``TRAINING_BYTES``."""
    pieces = [(r, at) for r in records for at in range(0, len(r), SAMPLE_BYTES)]
    step = max(1, -(-sum(map(len, records)) // TRAINING_BYTES))
    return [r[at:at + SAMPLE_BYTES] for r, at in pieces[::step]]


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from samples of the records; where they are too few to train one, the samples themselves are it."""
    samples = samples_of(records)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """An archive being written: its records, ``ARCHIVE_BYTES`` at most but for the last one, wait for the dictionary."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.held: list[bytes] = []
        self.payload = 0

    def add(self, data: bytes, payload: int) -> None:
        self.held.append(data)
        self.payload += payload

    def close(self) -> dict:
        trained = dictionary_of(self.held)
        content = trained.as_bytes()
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        system, path = _open_folder(self.path)
        with system.open_output_stream(path, compression=None) as out:
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
            for data in self.held:
                out.write(pack.compress(data))
            size = out.tell()
        return {"path": self.path, "records": len(self.held), "payload_bytes": self.payload,
                "dictionary_bytes": len(content), "archive_bytes": size}


def write_archives(pages: DataFrame, folder: str | None = None, page: str = "page_id", html: str = "html") -> DataFrame:
    """Write one record a page into archives in ``folder``; returns the table of the archives.

    ``folder`` must be shared by all executors (by default a new one under the checkpoint
    folder). A task that is run again writes new files; only files of finished tasks are in the returned
    table, which is the archive's index. A null page id, url or html is allowed: no number, no
    address, an empty payload. No pages, no archives.
    """
    spark = pages.sparkSession
    ship_package(spark)
    if folder is None:
        folder = f"{staging_root(spark)}/volsmith-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    system, path = _open_folder(folder)
    system.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or Archive(folder)
                archive.add(record(page_id, url, payload, digest, size, refers_to), size)
                if archive.payload >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return stage(with_record_types(pages, page, html).mapInArrow(write, MANIFEST), "archives")


def records_of(path: str) -> Iterator[dict]:
    """The records of an archive, in order, with their payloads checked against their digests."""
    system, local = _open_folder(path)
    with system.open_input_stream(local, compression=None) as source:
        head = source.read(8)
        dictionary = None
        if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
            dictionary = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", head)[1]))
        else:
            source.close()
            source = system.open_input_stream(local, compression=None)
        unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
        reader = io.BufferedReader(unpack.stream_reader(source, read_across_frames=True), 1 << 16)
        while line := reader.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: no record where one was expected")
            fields = {}
            while (line := reader.readline()) != b"\r\n":
                name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
                fields[name] = value
            block = reader.read(int(fields["Content-Length"]))
            reader.read(4)
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            revisit = fields["WARC-Type"] == "revisit"
            if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{path}: a payload does not fit its digest")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload)
            yield {"page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
                   "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest,
                   "record_type": fields["WARC-Type"],
                   "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None}


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the ``archives`` table, one row each; ``payload`` false leaves the payloads out.

    Archives are dealt one by one; each is read as a stream, so a task holds some records only.
    """
    ship_package(archives.sparkSession)
    columns = ["page_id", "url", *(["payload"] if payload else []), "payload_bytes", "payload_digest", "record_type",
               "refers_to"]
    kinds = {"page_id": "long", "payload": "binary", "payload_bytes": "long", "refers_to": "long"}
    schema = pa.schema([(c, {"long": pa.int64(), "binary": pa.binary()}.get(kinds.get(c), pa.string())) for c in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for found in records_of(path):
                    rows.append({c: found[c] for c in columns})
                    held += found["payload_bytes"] if payload else 100
                    if held >= 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = max(1, min(archives.count(), 10_000))
    return archives.select("path").repartition(tasks).mapInArrow(
        read, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
