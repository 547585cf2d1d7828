"""Operator 12: WARC archives through a table of payload chunks.

Writing.  Each page is one record.  Payloads are cut on the JVM into chunks of ``CHUNK``
bytes, so what reaches Python are rows of a record's identifier, its chunk number and at most
that many bytes; the writer compresses and hashes them one after the other (one gzip
member for each record), and never holds a record.  Among equal payloads of at least ``least``
bytes the one of the smallest page id is a ``response`` record, the others are ``revisit``
records (profile identical-payload-digest) without payload.  Equal means: equal SHA-256 and length;
the smallest ids are found by an aggregation that combines before the shuffle, and joined back.

Reading.  A task streams a file: it inflates blocks, parses one header at a time and
gives the payload as rows (record identifier, chunk number, bytes, bytes so far, SHA-256 so far).
The digest is carried on from chunk to chunk, so the last chunk of a record has that of the
whole payload; it is compared with the header's.  ``records`` reads the same table without the bytes.

Files have names of their task attempt and are listed in a stored manifest when they are
complete, so a lost executor leaves no trace.  They go to the shared folder of the session
through pyarrow's file systems.

Defined results: null html is an empty payload; null page ids and null urls have no header field and are null
when read; rows with a null page id are always responses and never referred to; rows with the same
page id and payload are all responses, or all revisits; their record identifiers are equal (they are made from page id,
url and digest).  Payloads of any length are streamed (a Parquet cell is read whole by Spark itself); line
breaks in urls are written as %0D and %0A; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import shared_dir, small_batches, stored
from acreage.llm.token_files import file_system

CHUNK = 1 << 16
BLOCK = 1 << 18                                    # compressed bytes that are read at once
# Names of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Extension fields: the page ids as given, and the length of a payload that a revisit leaves out.
PAGE, REFERS_TO_PAGE, LENGTH = "X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Length"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
CHUNKS = ("path string, record_id string, page_id string, uri string, record_type string, refers_to string, refers_to_page string, "
          "chunk int, data binary, payload_bytes bigint, payload_digest string, last boolean")


def _record_id(page, url, digest) -> F.Column:
    """An identifier made from page id, url and digest, in the form of a UUID of version 8."""
    h = F.sha2(F.concat_ws("\n", F.coalesce(page, F.lit("-")), digest, F.coalesce(url, F.lit("-"))), 256)
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-8"), at(13, 3), F.lit("-8"), at(16, 3), F.lit("-"), at(19, 12), F.lit(">"))


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Each page as a record: (page_id, url, payload, payload_bytes, payload_digest, record_id, refers_to_page, refers_to).
    The last two are null for responses.  Revisits keep no payload."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    rows = rows.withColumn("record_id", _record_id(F.col("page_id").cast("string"), F.col("url"), F.col("payload_digest")))
    copies = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_bytes", "payload_digest", "record_id")
    first = (copies.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.max("page_id").alias("greatest"))
             .where(F.col("first.page_id") < F.col("greatest")).drop("greatest"))          # most payloads occur once: nothing to join
    later = F.col("first.page_id") < F.col("page_id")
    return rows.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", F.when(~F.coalesce(later, F.lit(False)), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "record_id",
        F.when(later, F.col("first.page_id")).alias("refers_to_page"), F.when(later, F.col("first.record_id")).alias("refers_to"))


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (record fields, chunk number, data) in order, one at least for each record."""
    pieces = F.expr(f"transform(sequence(0, greatest(0, cast((payload_bytes - 1) div {size} as int))), i -> substring(payload, i * {size} + 1, {size}))")
    pieces = F.when(F.col("payload").isNull(), F.array(F.lit(None).cast("binary"))).otherwise(pieces)
    names = [c for c in records.columns if c != "payload"]
    return records.select(*names, pieces.alias("pieces")).select(*names, F.posexplode("pieces").alias("chunk", "data"))


def _header(kind: str, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}"] + [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


class Writer:
    """Writes records to a stream from their chunks."""

    def __init__(self, out, date: str, level: int) -> None:
        self.out, self.date, self.level, self.records, self.size, self.open = out, date, level, 0, 0, None
        body = b"software: acreage\r\nformat: WARC File Format 1.1\r\n"
        self._begin()
        self._put(_header("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], len(body)) + body)
        self._end()

    def _begin(self) -> None:
        self.gzip = zlib.compressobj(self.level, zlib.DEFLATED, 31)

    def _put(self, data: bytes) -> None:
        self._out(self.gzip.compress(data))

    def _end(self) -> None:
        self._out(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())

    def _out(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def chunk(self, number: int, row: dict, data: bytes | None) -> None:
        """The next chunk; number 0 begins a record."""
        if number == 0:
            self.close_record()
            url = row["url"] and row["url"].replace("\r", "%0D").replace("\n", "%0A")
            fields = [("WARC-Record-ID", row["record_id"]), ("WARC-Date", self.date), ("WARC-Target-URI", url), (PAGE, row["page_id"]),
                      ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("Content-Type", "application/http; msgtype=response")]
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
            self._begin()
            if data is None:
                fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers_to"]), (REFERS_TO_PAGE, row["refers_to_page"]), (LENGTH, row["payload_bytes"])]
                self._put(_header("revisit", fields, len(http)) + http)
            else:
                self._put(_header("response", fields, len(http) + row["payload_bytes"]) + http)
                self.open = (hashlib.sha256(), row["payload_digest"])
            self.records += 1
        if data is not None:
            self.open[0].update(data)
            self._put(data)

    def close_record(self) -> None:
        if self.open and self.open[0].hexdigest() != self.open[1]:
            raise ValueError("a record's chunks are not those of its digest")
        if self.records:
            self._end()
        self.open = None


def write(pages: DataFrame, folder: str | None = None, level: int = 6, date: str | None = None, **names) -> DataFrame:
    """Write the archives; returns the stored manifest, one row for each file."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    root, path = file_system(folder)
    root.create_dir(path, recursive=True)
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_id", "refers_to_page", "refers_to"]

    def archive(batches):
        from pyspark import TaskContext
        writer = out = None
        uri = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if batch.num_rows and writer is None:
                fs, place = file_system(uri)
                out = fs.open_output_stream(place, compression=None)          # members are compressed here
                writer = Writer(out, date, level)
            number, data = batch.column("chunk").to_pylist(), batch.column("data")
            rows = batch.select(fields).to_pylist()
            for i, n in enumerate(number):
                writer.chunk(n, rows[i], data[i].as_py())
        if writer is not None:
            writer.close_record()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "n_records": [writer.records], "n_bytes": [writer.size]})

    return stored(small_batches(chunked(plan(pages, **names))).mapInArrow(archive, MANIFEST), "warc-manifest")


class Stream:
    """Inflated bytes of a file of gzip members, read in blocks."""

    def __init__(self, file) -> None:
        self.file, self.gzip, self.packed, self.ready, self.ended = file, zlib.decompressobj(31), b"", bytearray(), False

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.file.read(BLOCK)
                if not self.packed:
                    if not self.ended:
                        raise ValueError("the archive is cut off")
                    return False
            if self.ended:
                self.gzip, self.ended = zlib.decompressobj(31), False
            data = self.gzip.decompress(self.packed, BLOCK)
            self.packed = self.gzip.unused_data or self.gzip.unconsumed_tail
            self.ended = self.gzip.eof
            if data:
                self.ready += data
                return True

    def until(self, mark: bytes, limit: int = 1 << 20) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the file."""
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > limit or not self._more():
                if self.ready:
                    raise ValueError("a header without end")
                return None
        found = bytes(self.ready[:at + len(mark)])
        del self.ready[:at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise ValueError("a record is cut off")
        found = bytes(self.ready[:n])
        del self.ready[:n]
        return found


def _parse(stream: Stream, size: int):
    """(fields, chunk number, data, bytes so far, digest so far, last) of all records of a file but warcinfo."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head[:-4].decode().split("\r\n")
        if version != VERSION:
            raise ValueError("not a WARC 1.1 record")
        fields = dict(line.split(": ", 1) for line in lines)
        left = int(fields["Content-Length"])
        if fields["WARC-Type"] == "response":
            left -= len(stream.until(b"\r\n\r\n"))
            digest, done, number = hashlib.sha256(), 0, 0
            while True:
                data = stream.take(min(size, left - done))
                done += len(data)
                digest.update(data)
                last = done == left
                if last and f"sha256:{digest.hexdigest()}" != fields["WARC-Payload-Digest"]:
                    raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                yield fields, number, data, done, digest.copy().hexdigest(), last
                if last:
                    break
                number += 1
        else:
            while left:
                left -= len(stream.take(min(size, left)))
            if fields["WARC-Type"] == "revisit":
                yield fields, 0, None, int(fields[LENGTH]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), True
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record without end")


def _read(manifest: DataFrame, size: int, with_data: bool) -> DataFrame:
    of = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [(name, of[kind]) for name, kind in (c.split() for c in CHUNKS.split(", "))]

    def batch_of(rows):
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], names=[n for n, _ in kinds])

    def scan(batches):
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, place = file_system(uri)
                with fs.open_input_stream(place, compression=None) as file:
                    for f, number, data, done, digest, last in _parse(Stream(file), size):
                        if not with_data and not last:
                            continue
                        rows.append((uri, f["WARC-Record-ID"], f.get(PAGE), f.get("WARC-Target-URI"), f["WARC-Type"], f.get("WARC-Refers-To"), f.get(REFERS_TO_PAGE),
                                     number, data if with_data else None, done, digest, last))
                        held += len(data) if with_data and data else 0
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    files = manifest.select("path").repartition(max(1, manifest.count()))       # a task for each file
    return files.mapInArrow(scan, CHUNKS)


def chunks(manifest: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of the archives: one row for each ``size`` bytes of a payload (at least one for a record), with
    the number of bytes and the digest up to its end; ``last`` marks the row whose digest is that of the whole."""
    return _read(manifest, size, True)


def records(manifest: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row for each record: identifiers, type, length and digest of the full payload (a revisit's: of the payload it refers to)."""
    return _read(manifest, size, False).drop("chunk", "data", "last")


def dangling(manifest: DataFrame) -> DataFrame:
    """Revisited records that no response of the same length and digest has: (refers_to, payload_bytes, payload_digest, n).
    Empty for a sound set of archives."""
    rows = stored(records(manifest), "warc-records")
    same = ["refers_to", "payload_bytes", "payload_digest"]
    asked = rows.where("record_type = 'revisit'").groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    there = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), *same[1:])
    return asked.join(there, same, "left_anti")
