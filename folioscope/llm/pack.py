"""Packing by Karmarkar-Karp multiway differencing.

Every document's ids end with an end id.  Full windows of `capacity` ids are cut
from its front; what is left, in pieces of `max_piece` ids at most, is packed with
others.  Pieces are dealt by a hash into groups of about `group_pieces`; within a
group the differencing method keeps a heap of partial partitions into k windows
and merges the two of widest spread, the fullest windows of one with the emptiest
of the other, until one partition is left.  k begins at the least count that can
hold the group and rises whenever a window would exceed its capacity.  Only
figures about pieces are shuffled, no text and no ids.

Cases: a null or empty text is its end id alone; repeated rows are packed each for
themselves; equal sizes are merged in the order of their piece numbers; a text of
any length is cut; an empty table gives an empty result; columns other than the id
and the text are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _core, tokens

CAPACITY = 2048
MAX_PIECE = 512
GROUP_PIECES = 1024
END = 1

Slots = list  # of (sum, members), fullest first; windows that are empty are left out


def _merged(a: Slots, b: Slots, k: int) -> Slots:
    """Windows of a and b joined in opposite order."""
    out = a + [(0, ())] * max(0, min(k, len(a) + len(b)) - len(a))
    over = len(a) + len(b) - k
    if over <= 0:
        out = a + b
    else:
        for j, (size, members) in enumerate(b):
            held, own = out[k - 1 - j]
            out[k - 1 - j] = (held + size, (own, members) if own else members)
    return sorted(out, key=lambda x: -x[0])


def difference(sizes: list[int], k: int) -> Slots:
    """The partition of all sizes into k windows that differencing ends with."""
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        m = _merged(a, b, k)
        spread = m[0][0] - (m[-1][0] if len(m) == k else 0)
        heapq.heappush(heap, (-spread, n, m))
        n += 1
    return heap[0][2]


def flat(members: tuple) -> list[int]:
    """The piece numbers in a nest of pairs."""
    out, todo = [], [members]
    while todo:
        x = todo.pop()
        (out.append if isinstance(x, int) else todo.extend)(x)
    return sorted(out)


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of near-equal windows, none above capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if found[0][0] <= capacity:
            return [flat(m) for _, m in found]
        k += max(1, k // 400)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
KEPT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def cut(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, max_piece: int, end: int) -> DataFrame:
    def make():
        encoder, number = tokens.encoder(vocabulary, True), [(TaskContext.get().partitionId() if TaskContext.get() else 0) << 33]

        def work(cols, texts):
            ids, counts = encoder.encode(texts, end)
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece")}
            raw, base = ids.tobytes(), 0
            for doc, n in zip(cols[0], counts.tolist()):
                full = n - n % capacity
                places = [*range(0, full, capacity), *range(full, n, max_piece), n]
                for a, b in zip(places, places[1:]):
                    for k, v in (("doc_id", doc), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(raw[4 * (base + a) : 4 * (base + b)])), ("doc_tokens", n), ("piece", number[0])):
                        out[k].append(v)
                    number[0] += 1
                base += n
            return out

        return work

    return _core.map_texts(docs, make, PIECES, (id_col,), text_col)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_piece: int = MAX_PIECE, group_pieces: int = GROUP_PIECES, end: int = END) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence.
    Full windows have even sequence ids, packed ones odd."""
    pieces = _core.materialise(cut(docs, vocabulary, id_col, text_col, capacity, max_piece, end), "pieces")
    whole = pieces.filter(F.col("length") == capacity).select(*KEPT, (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group_pieces))

    def one(table: pa.Table) -> pa.Table:
        length, piece = (table.column(k).to_numpy() for k in ("length", "piece"))
        order = np.lexsort((piece, -length))
        table, length = table.take(order), length[order]
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for k, members in enumerate(windows(length.tolist(), capacity)):
            sequence[members] = k
            offset[members] = np.cumsum(length[members]) - length[members]
        sequence = (table.column("grp")[0].as_py() << 24 | sequence) * 2 + 1
        return table.select(KEPT).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("grp").applyInArrow(_core.tidy_group(one), PACKED))


def op1_pack(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(_core.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
