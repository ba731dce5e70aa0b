"""Dictionary-compressed WARC archives.

Every task writes its rows to archives of its own in the shared folder. An
archive begins with a skippable frame that holds a Zstandard dictionary, trained
on the first records of that archive, and each record is one Zstandard frame. Of
records with equal payloads, one is a response and the others revisit it.

Writers put each archive under a name of its own and report it only when it is
complete; a task that runs again leaves at most a file that no manifest names.

Only the digests of payloads that occur twice are gathered, so payloads go straight
from the scan to their archive and are never shuffled where those digests are few.

Defined cases: null html is an empty payload; a null url leaves out the target;
control characters in a url are percent-encoded; rows that share the largest
page_id of a payload are all responses; a null page_id is written as such, and is
a response only where no row of its payload has an id; repeated rows are records
each; very long payloads are held one at a time; an empty table makes no archive;
columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutworks.runtime import staged, work_path

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
#: Compressed size at which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: What the dictionary of an archive is trained on, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
LEVEL = 6
#: Tasks that read archives back, at most.
READERS = 20_000
_MAGIC = (0x184D2A5D).to_bytes(4, "little")
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest, record_type and refers_to (null for responses).

    Digests are counted by partial sums; those that occur twice are stored, and are broadcast where they are few.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least
    kept = rows.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    repeated = staged(kept.select("payload_digest", "kept"), "repeated-payloads")
    marked = rows.join(repeated, "payload_digest", "left")
    again = large & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return marked.select(
        "page_id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("kept")).alias("refers_to")
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
        block += b"\r\n"
    else:
        block += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the samples; too few or too uniform ones are themselves the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _open(path: str):
    url = urllib.parse.urlparse(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), url.path
    return pafs.FileSystem.from_uri(path)


class _Archive:
    """Holds back the first records until the dictionary is trained."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.held: list[bytes] = []
        self.held_bytes = self.size = self.records = 0
        self.out = self.squeeze = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.out is None:
            self.held.append(raw)
            self.held_bytes += len(raw)
            if self.held_bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.squeeze.compress(raw))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def _begin(self) -> None:
        system, plain = _open(self.path)
        system.create_dir(os.path.dirname(plain), recursive=True)
        self.out = system.open_output_stream(plain, compression=None)
        dictionary = train(self.held)
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        raw = dictionary.as_bytes()
        self._put(_MAGIC + len(raw).to_bytes(4, "little") + raw)
        for record_ in self.held:
            self._put(self.squeeze.compress(record_))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._begin()
        self.out.close()
        return self.path, self.records, self.size


MANIFEST = "path string, records long, bytes long"


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``mark_revisits`` below ``folder``; the manifest of complete archives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, kind, refers_to = (c[i].as_py() for c in columns)
                archive = archive or _Archive(folder)
                archive.add(record(page_id, url, html.encode(), digest, kind, refers_to))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            made = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return staged(marked.mapInArrow(run, MANIFEST), "manifest")


def records_of(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    system, plain = _open(path)
    with system.open_input_stream(plain, compression=None) as raw:
        head = raw.read(8)
        if head[:4] != _MAGIC:
            raise ValueError(f"{path} doesn't begin with a dictionary frame")
        dictionary = zstandard.ZstdCompressionDict(raw.read(int.from_bytes(head[4:], "little")))
        plain_stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True), 1 << 20)
        while line := plain_stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path} has something else where a record should begin")
            headers = {}
            while (line := plain_stream.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[name] = value
            block = plain_stream.read(int(headers["Content-Length"]))
            if plain_stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"a record of {path} has no end")
            yield headers, block


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _parsed(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    kind, payload = headers["WARC-Type"], None
    size, digest = number("X-Payload-Length"), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} doesn't match its digest")
    return number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page-ID"), headers.get("WARC-Target-URI"), payload if with_payload else None


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives, each archive in one task; payloads are checked against their digests.

    Paths are dealt to as many tasks as there are archives, up to ``READERS``.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [f.strip().split()[0] for f in READ.split(",")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for headers, block in records_of(path):
                    rows.append(_parsed(headers, block, with_payload))
                    held += len(block) if with_payload else 100
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    # a number of partitions that is asked for isn't coalesced again, as small as the manifest is
    tasks = min(max(1, manifest.count()), READERS)
    return manifest.select("path").repartition(tasks).mapInArrow(run, READ)


def report(pages: DataFrame) -> DataFrame:
    """All pages archived and read back."""
    manifest = write_archives(mark_revisits(pages), work_path(pages.sparkSession, "warc"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN k ON k.d = p.d AND p.n >= 1000
"""
