"""Operator 5: token ids in seekable binary files.

A file holds one zstandard frame for each document (its ids, little-endian unsigned
32-bit), a frame with the document keys in ascending order, and a trailing seek table
in the public zstd seekable format: a skippable frame with the compressed size, the
decompressed size and a checksum (low 32 bits of XXH64) of every frame, and a footer.
Frames do not depend on each other, so a reader seeks to the documents it wants and
decompresses nothing else.

``write`` range-partitions documents by key and writes one file for each partition
under a name of the task attempt; the stored manifest names the files of the
attempts that succeeded, so a lost executor or a repeated task leaves no trace in it.
Files go to the shared folder of the session through pyarrow's file systems.

Defined results: null or empty text is a document of the end id alone; a null key is
kept and sorts first; equal keys keep all their rows (ordered by a hash of the text);
an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreage.llm.common import shared_dir, small_batches, stored, text_bytes
from acreage.llm.tokens import encoder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1   # fixed values of the zstd seekable format
NO_KEY = -(1 << 63)                            # stands for a null key in the directory frame
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint, first_doc bigint, last_doc bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


class Writer:
    """Writes frames and, at the end, the seek table."""

    def __init__(self, out, level: int) -> None:
        import xxhash
        import zstandard

        self.out, self.table, self.xxh = out, [], xxhash.xxh64_intdigest
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)

    def frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(data), self.xxh(data) & 0xFFFFFFFF))

    def close(self) -> None:
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class Reader:
    """Reads single frames of a file and checks their checksums."""

    def __init__(self, file) -> None:
        import xxhash
        import zstandard

        self.file, self.xxh, self.zstd = file, xxhash.xxh64_intdigest, zstandard.ZstdDecompressor()
        end = file.size()
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        file.seek(end - 9 - 12 * n)
        table = np.frombuffer(file.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = table.T
        self.starts = np.cumsum(self.packed) - self.packed

    def frame(self, i: int) -> bytes:
        self.file.seek(int(self.starts[i]))
        return self._checked(i, self.file.read(int(self.packed[i])))

    def _checked(self, i: int, packed: bytes) -> bytes:
        data = self.zstd.decompress(packed, max_output_size=max(1, int(self.plain[i])))
        if len(data) != self.plain[i] or self.xxh(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return data

    def keys(self) -> np.ndarray:
        return np.frombuffer(self.frame(len(self.packed) - 1), dtype="<i8")

    def documents(self, frames: np.ndarray):
        """The given frames in ascending order; frames that follow each other are read at once, up to 8 MB."""
        at = 0
        while at < len(frames):
            end = at + 1
            while end < len(frames) and frames[end] == frames[end - 1] + 1 and self.starts[frames[end]] - self.starts[frames[at]] < 8 << 20:
                end += 1
            base, last = int(self.starts[frames[at]]), frames[end - 1]
            self.file.seek(base)
            block = self.file.read(int(self.starts[last] + self.packed[last]) - base)
            for i in frames[at:end]:
                s = int(self.starts[i]) - base
                yield int(i), self._checked(i, block[s:s + int(self.packed[i])])
            at = end


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, level: int = 3, folder: str | None = None,
          text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and write; returns the stored manifest, one row for each file."""
    folder = folder or shared_dir(docs.sparkSession, "token-files")
    root, path = file_system(folder)
    root.create_dir(path, recursive=True)

    def shard(batches):
        from pyspark import TaskContext
        part, tok, n_ids, keys = TaskContext.get().partitionId(), encoder(tokenizer), 0, []
        writer = out = None
        uri = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            if batch.num_rows and writer is None:
                fs, place = file_system(uri)
                out = fs.open_output_stream(place)
                writer = Writer(out, level)
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(text_bytes(batch.column(1)))):
                ids = np.append(ids, end_id).astype("<u4")
                writer.frame(ids.tobytes())
                n_ids += len(ids)
                keys.append(NO_KEY if doc is None else doc)
        if writer is not None:
            writer.frame(np.array(keys, dtype="<i8").tobytes())
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [uri], "n_docs": [len(keys)], "n_ids": [n_ids],
                                              "first_doc": [keys[0]], "last_doc": [keys[-1]]})

    rows = small_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(shard, MANIFEST), "manifest")


def read(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files of a manifest: key, number of ids of all documents before, number of ids,
    ids.  The place in a file comes from its seek table, that of a file from the manifest.  With ``wanted`` (a list of keys that the caller states) only their frames are read."""
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")       # one row for each file
    manifest = manifest.withColumn("before", before)
    if wanted is not None:
        wanted = sorted(set(wanted))
        near = F.lit(False)
        for a in range(0, len(wanted), 1000):      # only files whose key range can hold one
            block = wanted[a:a + 1000]
            near = near | ((F.col("first_doc") <= block[-1]) & (F.col("last_doc") >= block[0]))
        manifest = manifest.where(near)

    def decode(batches):
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, place = file_system(uri)
                with fs.open_input_file(place) as file:
                    reader = Reader(file)
                    keys = reader.keys()
                    frames = np.arange(len(keys)) if wanted is None else np.flatnonzero(np.isin(keys, wanted))
                    start = before + (np.cumsum(reader.plain) - reader.plain) // 4
                    rows, size = [], 0
                    for i, data in reader.documents(frames):
                        rows.append((None if keys[i] == NO_KEY else int(keys[i]), int(start[i]), len(data) // 4, data))
                        size += len(data)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    files = manifest.select("path", "before").repartition(max(1, manifest.count()))       # a task for each file
    return files.mapInArrow(decode, DOCUMENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()))
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], names=[n for n, _ in kinds])

