"""WARC archives compressed record by record against a dictionary of their own.

A writer task collects the records of an archive, trains a Zstandard dictionary on
them, puts it into a skippable frame at the head of the file and compresses each
record as a frame of its own, so that any record can be read with the head alone.
Payloads that were archived already become revisit records without a payload.

Archives go to a folder that all executors share, through the file system that its
URI names: one that Arrow knows (file, hdfs, s3, gs, abfs), s3a, or any that fsspec has a
driver for.  Names are of a task's attempt, so attempts don't meet; the list that `write`
returns says which archives count, and a lost attempt's files aren't in it.  An archive holds `archive_bytes` at most (or
one record), which bounds a task's memory; dictionaries are trained on records spread
over the archive, `SAMPLE_BYTES` of them.

Defined cases.  Null html: an empty payload.  Null url: no target header.  Null
page_id: never the response where an equal payload has an id; without any id all
are responses.  Repeated rows of the response's id are responses too, with record ids of
their own; revisits refer to the first.  Very long payloads: an archive each.  Ties of
page_id: the row with the least url.  Payloads under
`least_bytes` are never revisits.  Empty table: no archive.  Extra and clashing columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import passing_folder
from .common import bounded, settle

#: Fixed values of the format: the skippable frame, and the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES = 1 << 15
SAMPLE_BYTES = 100 * DICTIONARY_BYTES
#: URI schemes of Hadoop and what Arrow calls them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    scheme, colon, rest = uri.partition("://")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as unknown:
        try:
            import fsspec

            return pafs.PyFileSystem(pafs.FSSpecHandler(fsspec.filesystem(scheme))), uri
        except (ImportError, ValueError):
            raise ValueError(f"neither Arrow nor fsspec has a file system for {uri}; archives need a shared folder that Python on the executors can open") from unknown


def decide(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload (binary), digest, record_type, refers_to, head (whether others refer to it)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    repeated = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest", "page_id")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.sum("c").alias("c"), F.min_by("c", F.coalesce("page_id", F.lit(2**63 - 1))).alias("n_first"))
        .where("c > 1 and first is not null")
        .select("digest", "first", "n_first")
    )
    repeated = bounded(settle(repeated))
    rows = rows.join(repeated, "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    # Of repeated rows of the response's id, others refer to one.
    twins = F.coalesce((F.col("n_first") > 1) & (F.col("page_id") == F.col("first")), F.lit(False))
    one = rows.where(twins).withColumn("head", F.row_number().over(Window.partitionBy("digest").orderBy("url")) == 1)
    rows = rows.where(~twins).withColumn("head", F.col("first").isNotNull() & ~F.col("again")).unionByName(one)
    return rows.select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("again"), F.col("first")).alias("refers_to"),
        "head",
    )


def _record_id(*of) -> str:
    """Of the response that others refer to, by page and digest; of every other record, by its place as well."""
    name = " ".join(map(str, of))
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16])}>"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str, place: str | None = None) -> bytes:
    """A WARC record in full; `place` tells it from others of its page and payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": _record_id(page_id, digest, *([place] if place else [])),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": page_id,
        "WARC-Payload-Length": len(payload),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "WARC-Refers-To-Page-ID": refers_to}
    else:
        block += payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records spread over the list; if they are too few or small, made of their text."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), sample, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The parts of an archive: the frame with the dictionary, then a frame for each record."""
    trained = dictionary(records)
    data = trained.as_bytes()
    yield struct.pack("<II", DICTIONARY_FRAME, len(data)) + data
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
    for r in records:
        yield packer.compress(r)


def _dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict:
    # A trained dictionary begins with its own magic number.
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of the records of an open file, checked against their digests."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary_of(source.read(size)))
    with unpacker.stream_reader(source, read_across_frames=True, closefd=False) as stream:
        held = b""

        def need(n: int) -> None:
            nonlocal held
            parts, have = [held], len(held)
            while have < n:
                more = stream.read(max(1 << 16, n - have))
                if not more:
                    raise ValueError("the archive is cut off")
                parts.append(more)
                have += len(more)
            held = b"".join(parts)

        while True:
            if not held:
                held = stream.read(1 << 16)
                if not held:
                    return
            while (end := held.find(b"\r\n\r\n")) < 0:
                need(len(held) + 1)
            lines = held[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            head = dict(line.split(": ", 1) for line in lines[1:])
            length = int(head["Content-Length"])
            need(end + 4 + length + 4)
            block, held = held[end + 4 : end + 4 + length], held[end + 8 + length :]
            payload = block.split(b"\r\n\r\n", 1)[1]
            if head["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != head["WARC-Payload-Digest"]:
                raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
            yield head, payload


def write(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20, least_bytes: int = 100, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write `pages` to archives in `folder`; path, records, raw_bytes, archive_bytes of each."""

    def put(batches):
        task = TaskContext.get()
        fs, base = file_system(folder)
        attempt = uuid.uuid4().hex[:12]
        fs.create_dir(base, recursive=True)
        held, size, made = [], 0, 0

        def flush():
            nonlocal held, size, made
            name = f"{base}/part-{task.partitionId():06d}-{made:04d}-{attempt}.warc.zst"
            own = f"{base}/.{attempt}-{made}.tmp"
            out = 0
            with fs.open_output_stream(own, compression=None) as f:
                for part in archive(held, level):
                    out += len(part)
                    f.write(part)
            fs.move(own, name)
            row = pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (len(held), size, out))], ["path", "records", "raw_bytes", "archive_bytes"])
            held, size, made = [], 0, made + 1
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                r = record(*row[:-1], date, None if row[-1] else f"{attempt} {made} {len(held)}")
                if held and size + len(r) > archive_bytes:
                    yield flush()
                held.append(r)
                size += len(r)
        if held:
            yield flush()

    rows = decide(pages, least_bytes)
    return settle(rows.mapInArrow(put, "path string, records bigint, raw_bytes bigint, archive_bytes bigint"))


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The records of archives that `write` lists: page_id, url, payload and what the headers say."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"

    def get(batches):
        fs, _ = file_system(folder)

        def number(x):
            return None if x is None else int(x)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(path, compression=None) as f:
                    for head, payload in read_archive(f):
                        whole = head["WARC-Type"] == "response"
                        size = len(payload) if whole else int(head["WARC-Payload-Length"])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        rows.append((number(head.get("WARC-Page-ID")), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], number(head.get("WARC-Refers-To-Page-ID")), payload if whole else None))
                        held += len(payload)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return archives.select("path").mapInArrow(get, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def report(pages: DataFrame) -> DataFrame:
    """Archives `pages` in the shared folder, reads them back and gives the contract's columns."""
    folder = passing_folder(pages.sparkSession, "warc")
    found = read(write(pages, folder), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
