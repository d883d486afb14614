"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

A shard holds a range of documents in ascending id order.  Its token ids are ranked
by their frequency in the shard; ranks are written least byte first, without
leading zero bytes, apart from two-bit lengths that lie four to a control byte.  A
numpy table from control bytes to lengths decodes whole blocks at once.

A shard is a list of blocks, rows (shard, block, n_docs, n_tokens, start, payload)
of a Parquet file, so that any store that Spark reads can hold it.  Payload, all
little-endian: magic FTK1; u32 distinct ids d, u64 documents m, u64 tokens n,
u64 code bytes c; then u32 ids by rank [d]; i64 document ids [m]; u8 whether an
id is null [m]; u64 token counts [m]; control bytes [(n+3)/4]; code [c]; u32 crc32
of all before it.

A shard's ids are held until they are ranked; the number of shards follows the bytes of
the texts, so that a shard has about SHARD_BYTES of them.

Cases: a null or empty text has its end id alone; a null document id comes first
and stays null; rows with one id keep an order by their text's hash; ranks of equal
frequency go by id; a long text lies in one block, whole; columns other than the id and
the text are not read; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _core, tokens

MAGIC = b"FTK1"
HEAD = struct.Struct("<4sIQQQ")
BLOCK_TOKENS = 1 << 17
SHARD_BYTES = 64 << 20
HELD_SHARE = 5 / 3  # of chunks a worker holds: nothing else takes its memory here
END = 2

BLOCKS = "shard long, block long, n_docs long, n_tokens long, start long, payload binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Lengths of the four codes a control byte tells of.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_block(doc_ids: list, counts: np.ndarray, ranks: np.ndarray, by_rank: np.ndarray) -> bytes:
    n = len(ranks)
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    control = np.zeros((n + 3) // 4 * 4, dtype=np.uint8)
    control[:n] = size - 1
    control = control.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    code = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]]
    body = b"".join([
        HEAD.pack(MAGIC, len(by_rank), len(doc_ids), n, len(code)), by_rank.astype("<u4").tobytes(),
        np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes(), bytes(i is None for i in doc_ids),
        counts.astype("<u8").tobytes(), control.astype(np.uint8).tobytes(), code.tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all token ids."""
    magic, d, m, n, c = HEAD.unpack_from(payload)
    if magic != MAGIC or struct.unpack("<I", payload[-4:])[0] != zlib.crc32(memoryview(payload)[:-4]):
        raise ValueError("not a sound token block")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    by_rank, ids, null, counts = take("<u4", d), take("<i8", m), take("u1", m), take("<u8", m)
    control, code = take("u1", (n + 3) // 4), take("u1", c)
    size = LENGTHS[control].reshape(-1)[:n]
    ranks = np.zeros((n, 4), dtype=np.uint8)
    ranks[np.arange(4, dtype=np.uint8) < size[:, None]] = code
    ranks = ranks.view("<u4").reshape(-1)
    return [None if z else i for i, z in zip(ids.tolist(), null)], counts.astype(np.int64), by_rank[ranks]


def write(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, shards: int = 0) -> None:
    """Writes the token files of docs under path, `shards` of them (if 0, one for each
    SHARD_BYTES of text, spark.sql.shuffle.partitions at least)."""
    schema = _core.arrow_schema(BLOCKS)

    def run(batches):
        """One shard: its ids stay in memory until their frequencies are known."""
        shard, encoder = TaskContext.get().partitionId() if TaskContext.get() else 0, tokens.encoder(vocabulary, False, HELD_SHARE)
        ids, counts, flat, total = [], [], [], np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in _core.slices(batch, "t"):
                f, c = encoder.encode(part.column(1).to_pylist(), end)
                ids += part.column(0).to_pylist()
                counts.append(c)
                few = np.bincount(f)
                if len(few) > len(total):
                    total = np.concatenate([total, np.zeros(len(few) - len(total), dtype=np.int64)])
                total[: len(few)] += few
                flat.append(f.astype(np.uint16) if len(few) <= 1 << 16 else f)
        if not ids:
            return
        by_rank = np.lexsort((np.arange(len(total)), -total))[: np.count_nonzero(total)]
        rank = np.zeros(len(total), dtype=np.uint32)
        rank[by_rank] = np.arange(len(by_rank))
        counts = np.concatenate(counts)
        ends = np.cumsum(counts)
        flat = np.concatenate(flat)
        a = block = 0
        while a < len(ids):
            start = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, start + BLOCK_TOKENS, "right")))
            own = rank[flat[start : ends[b - 1]]]
            here = np.zeros(len(by_rank), dtype=bool)
            here[own] = True
            used = np.flatnonzero(here)  # a block's dictionary: its ids in the shard's order
            local = np.cumsum(here, dtype=np.uint32) - np.uint32(1)
            payload = encode_block(ids[a:b], counts[a:b], local[own], by_rank[used])
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((shard, block, b - a, len(own), start, payload), schema)], schema=schema)
            a, block = b, block + 1

    spark = docs.sparkSession
    n = shards or max(_core.shuffle_parts(spark), -(-(docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0) // SHARD_BYTES))
    plain = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).withColumn("h", F.xxhash64("t")).withColumn("u", F.monotonically_increasing_id())
    ranged = plain.repartitionByRange(n, "i", "h", "u").sortWithinPartitions("i", "h", "u").select("i", "t")
    ranged.mapInArrow(_core.tidy(run), BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of token files, with `base`: the ids of all shards before a block's."""
    blocks = spark.read.parquet(path)
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    base, sums = 0, {}
    for shard, n in totals:  # as many as there are shards
        sums[shard], base = base, base + n
    held = spark.sparkContext.broadcast(sums)
    schema = _core.arrow_schema(ROWS)

    def run(batches):
        for batch in batches:
            for shard, start, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, counts, flat = decode_block(payload)
                ends = np.cumsum(counts)
                raw = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (ids, held.value[shard] + start + ends - counts, counts, crc)], schema=schema)

    return blocks.select("shard", "start", "payload").mapInArrow(_core.tidy(run), ROWS)


def op8_token_files(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    path = f"{_core.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(_core.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read(spark, path)
