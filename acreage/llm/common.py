"""Helpers that several operators share: stored intermediate tables, a fixed-size
bitmap of hashes, and vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

import gc
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage.session import ensure_checkpoint_dir, ship_package

MULT = np.uint64(0x9E3779B97F4A7C15)       # odd: invertible modulo 2^64
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX1 = np.uint64(0xBF58476D1CE4E5B9)       # fixed values: multipliers of the splitmix64 finaliser
MIX2 = np.uint64(0x94D049BB133111EB)
SEGMENT = 1 << 20                          # bytes that are hashed at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, survives lost executors, and later reads prune columns."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more (their successors are written), through the file system of their
    path; the shuffle files behind them go when the driver's collector finds them unused, which is asked for here."""
    for df in frames:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores after it while a column is called so (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """Whole texts are large rows: at most 1,000 of them in an Arrow batch of this session, which
    bounds the memory of Python workers.  The package is sent to them."""
    ship_package(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= 1000:
        conf.set(name, "1000")
    return df


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * MIX2
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of MULT and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SEGMENT + 1)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, MULT, dtype=np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, MULT_INV, dtype=np.uint64)], dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of (values[k] + 1) * MULT^k for i <= k < j (modulo 2^64)."""
    up, _ = POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of the sequence behind ``prefix``; equal
    ranges have equal hashes wherever they stand."""
    _, down = POWERS.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


LONG = 64                                  # bytes; what is longer is hashed by itself


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the byte ranges [start, end).  Eight bytes at a time go through the finaliser, which is not linear, so
    that sequences of two letters that cancel out in sums of powers (modulo 2^64) do not collide; longer ranges are hashed by BLAKE2b."""
    raw = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=raw.data, strides=(1,))
    size = ends - starts
    keep = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
    h = mix(size.astype(np.uint64) * MULT + np.uint64(seed))
    rest = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        rest = rest[size[rest] > at]
        if not len(rest):
            break
        h[rest] = mix(h[rest] * MULT + (eight[starts[rest] + at] & keep[np.minimum(8, size[rest] - at)]))
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(raw[starts[i]:ends[i]].data, digest_size=8, salt=seed.to_bytes(16, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def byte_runs(data: np.ndarray, is_member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a class (a table of 256 booleans)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_member[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("A"):ord("Z") + 1] += 32
    return t


LOWER = lower_table()


def cut_points(data: np.ndarray, is_member: np.ndarray, limit: int = SEGMENT) -> list[int]:
    """Places to cut a long byte string into segments of about ``limit`` bytes that
    split no run of the class; a run longer than the limit stays whole."""
    cuts, at = [0], 0
    while len(data) - at > limit:
        end = at + limit
        outside = np.flatnonzero(~is_member[data[at + 1:end]])
        if len(outside):
            end = at + 1 + int(outside[-1])
        else:
            rest = np.flatnonzero(~is_member[data[end:]])
            end = end + int(rest[0]) if len(rest) else len(data)
        cuts.append(end)
        at = end
    if cuts[-1] != len(data) or len(cuts) == 1:
        cuts.append(len(data))
    return cuts


def word_hashes(text: bytes, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word of a text; words are maximal runs of
    the byte class.  Long texts are hashed segment by segment."""
    data = np.frombuffer(text, dtype=np.uint8)
    if lower:
        data = LOWER[data]
    hashes, starts, ends = [], [], []
    cuts = cut_points(data, is_word)
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        s, e = byte_runs(part, is_word)
        if len(s):
            hashes.append(span_hashes(part, s, e))
            starts.append(s + a)
            ends.append(e + a)
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words; a shorter non-empty sequence is one window."""
    if len(words) == 0:
        return words
    if len(words) < n:
        n = len(words)
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * MULT + words[i:len(words) - n + 1 + i])
    return out


def text_bytes(column: pa.Array):
    """The UTF-8 bytes of each text of an Arrow string column; null counts as empty."""
    large = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    valid = large.is_valid().to_numpy(zero_copy_only=False) if large.null_count else None
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset:large.offset + len(large) + 1]
    data = large.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    for i in range(len(large)):
        yield b"" if valid is not None and not valid[i] else view[offsets[i]:offsets[i + 1]]


def list_array(flat: np.ndarray, sizes, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


# --- a fixed-size bitmap of hashes ------------------------------------------------

def bitmap(hashes: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """Bitmap of 2^log2_bits bits with the bit of every hash in ``column`` set.  Bits
    are merged by aggregation into at most 2^log2_bits / 64 rows, so what reaches the
    driver has a fixed bound whatever the number of rows.  It has no false negatives."""
    slot = F.shiftrightunsigned(F.col(column), 64 - log2_bits)
    rows = (hashes.where(F.col(column).isNotNull())
            .select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("k"))
            .select("w", F.expr("shiftleft(1L, k)").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")))
    got = rows.toArrow()
    out = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    log2_bits = int(len(bits)).bit_length() - 1 + 6
    slot = hashes >> np.uint64(64 - log2_bits)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

