"""Counts of hashes over all documents, dealt in blobs of sorted hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from . import _core

COUNTS = "bucket int, hashes binary, counts binary"
LEVELS = "bucket int, levels binary"
HELD_HASHES = 1 << 19
HELD_BITS = 24
_U = np.uint64


def bucket_bits(spark) -> int:
    return max(6, (2 * _core.shuffle_parts(spark) - 1).bit_length())


def dealt(hashes: np.ndarray, bits: int):
    """Buckets of sorted hashes, each with its range."""
    edges = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.concatenate([[0], edges, [len(hashes)]])
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), int(edges[k]), int(edges[k + 1])


def merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their summed counts."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, dtype=np.int64)
    return hashes[at], np.add.reduceat(counts, at) if len(at) else counts


def summed(batches, hash_type, count_type) -> tuple[int, np.ndarray, np.ndarray]:
    """The bucket of a group of (bucket, hashes, counts), its distinct hashes, sorted, and their
    summed counts.  Rows are merged as they come, so what is held is about twice the distinct ones."""
    bucket, held, counts, new, waiting = 0, np.empty(0, dtype=hash_type), np.empty(0, dtype=np.int64), [], 0

    def fold():
        h, c = np.concatenate([held, *(x for x, _ in new)]), np.concatenate([counts, *(y for _, y in new)])
        new.clear()
        return merged(h, c)

    for batch in batches:
        for bucket, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
            new.append((np.frombuffer(x, dtype=hash_type), np.frombuffer(y, dtype=count_type)))
            waiting += len(new[-1][0])
            if waiting > max(HELD_HASHES, len(held)):
                held, counts = fold()
                waiting = 0
    held, counts = fold()
    return bucket, held, counts


def levels(plain: DataFrame, make: Callable[[], Callable[[list], np.ndarray]], least: tuple[int, int, int], bits: int, slot_bits: int) -> np.ndarray:
    """A table of two bits for each of 2**slot_bits slots of the hash, four to a byte: how
    many of `least` the most frequent hash of the slot reaches.  plain: (any, text);
    make()(texts) gives hashes, each as often as it counts.  The result has a fixed size."""
    schema, out_schema, low = _core.arrow_schema(COUNTS), _core.arrow_schema(LEVELS), slot_bits - bits

    def gather(batches):
        hashes = make()
        held, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

        def rows():
            found = [(k, ((held[a:b] << _U(bits)) >> _U(32)).astype(np.uint32).tobytes(), np.minimum(counts[a:b], 65535).astype(np.uint16).tobytes()) for k, a, b in dealt(held, bits)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], type=f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for part in _core.slices(batch, "t"):
                h, c = np.unique(hashes(part.column(1).to_pylist()), return_counts=True)
                held, counts = merged(np.concatenate([held, h]), np.concatenate([counts, c]))
                if len(held) > HELD_HASHES:
                    yield rows()
                    held, counts = held[:0], counts[:0]
        yield rows()

    def level(batches):
        bucket, h, c = summed(batches, np.uint32, np.uint16)
        some = c >= least[0]
        slot = np.zeros(1 << low, dtype=np.uint8)
        np.maximum.at(slot, (h[some] >> np.uint32(32 - low)).astype(np.int64), np.searchsorted(least, c[some], "right").astype(np.uint8))
        packed = (slot.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(1).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((bucket, packed), out_schema)], schema=out_schema)

    out = np.zeros(1 << (slot_bits - 2), dtype=np.uint8)
    size = len(out) >> bits
    for r in plain.mapInArrow(_core.tidy(gather), COUNTS).groupBy("bucket").applyInArrow(_core.tidy_stream(level), LEVELS).collect():  # 2**slot_bits / 4 bytes in all
        out[r.bucket * size : (r.bucket + 1) * size] = np.frombuffer(r.levels, dtype=np.uint8)
    return out


def level_of(table: np.ndarray, slot_bits: int, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes >> _U(64 - slot_bits)).astype(np.int64)
    return (table[slot >> 2] >> ((slot & 3) * 2).astype(np.uint8)) & 3


def held_bits(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**HELD_BITS bits in which every value of a long column has its bit."""
    ddl = "part int, x binary"
    schema, low = _core.arrow_schema(ddl), HELD_BITS - 9

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << low, dtype=np.uint8)
        bits[table.column("slot").to_numpy() & ((1 << low) - 1)] = 1
        return pa.table([pa.array([x], type=f.type) for x, f in zip((table.column("part")[0].as_py(), np.packbits(bits).tobytes()), schema)], schema=schema)

    slots = values.select(F.pmod(column, F.lit(1 << HELD_BITS)).cast("int").alias("slot")).distinct()
    out = np.zeros(1 << (HELD_BITS - 3), dtype=np.uint8)
    size = 1 << (low - 3)
    for r in slots.withColumn("part", F.shiftright("slot", low)).groupBy("part").applyInArrow(_core.tidy_group(run), ddl).collect():  # 2**HELD_BITS / 8 bytes at most
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.x, dtype=np.uint8)
    return out


def has_bit(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value has its bit; also some that held_bits was not given."""
    slot = values.astype(np.int64) & ((1 << HELD_BITS) - 1)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def having_bit(batch: pa.RecordBatch, column: str, bitmap: np.ndarray, wanted: bool = True) -> pa.RecordBatch:
    """The rows of a batch whose long `column` has its bit (may be among the values the bitmap
    was made of), or those that have not."""
    there = has_bit(bitmap, batch.column(batch.schema.get_field_index(column)).fill_null(0).to_numpy(zero_copy_only=False))
    return batch.filter(pa.array(there == wanted))


def without_bits(df: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows whose long `column` has no bit."""
    held = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            yield having_bit(batch, column, held.value, False)

    return df.mapInArrow(_core.tidy(run), df.schema)


def with_bits(df: DataFrame, column: str, bitmap: np.ndarray, text_col: str) -> DataFrame:
    """The rows whose long `column` may be among the values the bitmap was made of, their texts
    pressed (as _core.press() does), as they are about to be shuffled."""
    held = df.sparkSession.sparkContext.broadcast(bitmap)
    at = df.columns.index(text_col)
    fields = [StructField(f.name, BinaryType(), f.nullable) if k == at else f for k, f in enumerate(df.schema.fields)]
    schema = to_arrow_schema(StructType(fields))

    def run(batches):
        for batch in batches:
            some = having_bit(batch, column, held.value)
            cols = [_core.press(c) if k == at else c.cast(f.type) for k, (c, f) in enumerate(zip(some.columns, schema))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return df.mapInArrow(_core.tidy(run), StructType(fields))
