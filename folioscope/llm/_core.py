"""Shared machinery of the text operators.

Texts cross from the JVM to Python once, as Arrow binary, and are worked on in
slices of a few MB with numpy over the joined bytes; no Python object is made
per word.  Words are known by 64-bit hashes that depend on their bytes alone,
so every task gives a word the same hash.
"""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


# ---------------------------------------------------------------- tables
def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or on a local master (where it
    may be unset) one temporary folder per session, which is then set as such."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
            held = spark.sparkContext.getCheckpointDir()
        found = held
    return str(found).rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends
    here, and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing that is still to run reads it."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df does not have, by any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- memory of workers
@functools.lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def release() -> None:
    """Gives freed memory back to the system.  Workers outlive their tasks, and several wait
    beside each executor: what each has once used would else stay theirs."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def tidy(run):
    """run, a function of Arrow batches, with a release() at the end of each task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy_group(work, least_bytes: int = 1 << 22):
    """work, a function of the Arrow table of a group, with a release() after each large one."""

    def tidied(table: pa.Table) -> pa.Table:
        size, out = table.nbytes, work(table)
        del table
        if size >= least_bytes:
            release()
        return out

    return tidied


def tidy_stream(work, least_bytes: int = 1 << 22):
    """work, a generator over the batches of a group as they come, with a release() after each large group."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0

        def counted():
            nonlocal size
            for batch in batches:
                size += batch.nbytes
                yield batch

        yield from work(counted())
        if size >= least_bytes:
            release()

    return tidied


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lets batches for Python workers hold `most` bytes at most (a setting of the session, kept
    where it is less): each task holds them twice beside the heap, and its worker once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


# ---------------------------------------------------------------- Arrow maps
def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose `column` holds max_bytes at most (or one row)."""
    n = batch.num_rows
    if n == 0:
        return
    lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)))
    ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def press(texts: pa.Array) -> pa.Array:
    """Texts compressed one by one, each after its length in eight bytes; nulls stay."""
    return pa.array([None if t is None else len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in texts.cast(pa.binary()).to_pylist()], type=pa.binary())


def unpress(texts: list) -> list:
    return [t if t is None else pa.decompress(t[8:], decompressed_size=int.from_bytes(t[:8], "little"), codec="zstd", asbytes=True) for t in texts]


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], ddl: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", max_bytes: int = SLICE_BYTES, pressed: bool = False) -> DataFrame:
    """One Python stage over (keys, text): make() is called once a task and gives a
    function of (columns of keys, texts as bytes or None) to a dict of output columns.
    pressed: the texts are as press() leaves them."""
    schema = arrow_schema(ddl)
    plain = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("__text"))

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, "__text", max_bytes):
                cols = [part.column(i).to_pylist() for i in range(len(keys))]
                texts = part.column(len(keys)).to_pylist()
                out = work(cols, unpress(texts) if pressed else texts)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return plain.mapInArrow(tidy(run), ddl)


# ---------------------------------------------------------------- bytes and words
def _table(drop: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for a, b in drop:
        t[a : b + 1] = False
    return t


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on bytes: every byte of a non-ASCII character counts.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: [^\x20\x09-\x0D]+
SOLID = _table([(0x20, 0x20), (0x09, 0x0D)])
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SEG = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEG, 1 << (max(n, 1) - 1).bit_length())
    if size not in _powers:
        for old in [k for k in _powers if k > _SEG]:
            del _powers[old]
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends]; equal bytes give equal hashes wherever they lie."""
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes of ordered, disjoint spans, a bounded stretch of bytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _SEG - 1, "right")))
        out[at:to] = span_hashes(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def lookup(keys: np.ndarray):
    """A function from 64-bit hashes to their places in the sorted array `keys`, -1 where absent."""
    bits = max(16, min(22, int(len(keys) * 16).bit_length()))
    shift = np.uint64(64 - bits)
    there = np.zeros(1 << bits, dtype=bool)
    there[keys >> shift] = True

    def find(h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int64)
        if len(keys):
            some = np.flatnonzero(there[h >> shift])
            place = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
            hit = keys[place] == h[some]
            out[some[hit]] = place[hit]
        return out

    return find


def unlike(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, places: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Which spans of data are not, byte for byte, those of `other` at places; a bounded stretch at a time."""
    out = sizes != other_sizes
    same = np.flatnonzero(~out & (sizes > 0))
    ends = np.cumsum(sizes[same])
    at = 0
    while at < len(same):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SEG, "right")))
        some = same[at:to]
        n = sizes[some]
        step = runs(n)
        wrong = data[np.repeat(starts[some], n) + step] != other[np.repeat(places[some], n) + step]
        if wrong.any():
            out[np.unique(np.repeat(some, n)[wrong])] = True
        at = to
    return out


class Words:
    """The words of a list of texts: where each lies in the joined bytes, its hash,
    and `first`, with the words of text i at first[i]:first[i+1]."""

    def __init__(self, texts: list, kind: np.ndarray, lower: bool = False, hashes: bool = True):
        lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        joined = b"\n".join(t or b"" for t in texts)
        if lower:
            joined = joined.translate(LOWER)
        self.raw = joined
        self.data = data = np.frombuffer(joined, dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts) + 1]
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = kind[data]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        if hashes:
            self.hash = hash_runs(data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The text each word lies in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def crc_mod(ids: list, n: int) -> np.ndarray:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % n for i in ids), dtype=np.int64, count=len(ids))


def crc_mod_column(column: str, n: int):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % n


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(counts) - counts, counts)


def rewrite_texts(docs: DataFrame, make: Callable[[], Callable[[list, list], tuple[list, list]]], keys: tuple[str, ...] = ("doc_id",), text: str = "text", length: str = "n_chars", max_bytes: int = SLICE_BYTES, out: DataType | None = None) -> DataFrame:
    """docs with new texts: make()(columns of keys, texts) gives the texts as bytes or None
    (the very object where nothing changed) and, for each row, whether it stays.  Columns, their order and types remain; a
    column named `length` follows the new text where the text changed.  With `out`, the
    texts come as press() leaves them, and `out` is the type they had."""
    names = docs.columns
    fields = [StructField(f.name, out, f.nullable) if out and f.name == text else f for f in docs.schema.fields]
    schema = to_arrow_schema(StructType(fields))
    at, key_at, long_at = names.index(text), [names.index(k) for k in keys], names.index(length) if length in names else -1

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, text, max_bytes):
                old = part.column(at).cast(pa.binary()).to_pylist()
                old = unpress(old) if out else old
                new, keep = work([part.column(i).to_pylist() for i in key_at], old)
                cols = [c if out and k == at else c.cast(f.type) for k, (c, f) in enumerate(zip(part.columns, schema))]
                if out or any(x is not y for x, y in zip(new, old)):
                    if long_at >= 0:
                        held = part.column(long_at).to_pylist()
                        cols[long_at] = pa.array([h if x is y else len(x.decode("utf-8", "replace")) for h, x, y in zip(held, new, old)], type=schema.field(long_at).type)
                    cols[at] = pa.array([None if x is None else x.decode("utf-8", "replace") for x in new], type=schema.field(at).type)
                rows = pa.RecordBatch.from_arrays(cols, schema=schema)
                yield rows if all(keep) else rows.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(tidy(run), StructType(fields))
