"""Language-model scores from a subword lattice.

The lattice of a token has an edge for every vocabulary piece that occurs in it; a
piece's weight follows from its existing score -r as 1 / (1 + r), made to sum to one
over the usable pieces, with a small share for single bytes.  A log-space forward
recursion sums over all segmentations.  One more edge spans the whole token; its
weight comes from the training documents.  With c the token's count, N all counts and
V the distinct tokens there, the marginal probability of a token is

    (c + V * lattice) / (N + V)

and a text's is the product over its tokens: words [^\\x20\\x09-\\x0D]+ after A-Z are
lowered, then one end.

Work is dealt in blobs of sorted word hashes.  Counting: every task merges its
counts and sends them to buckets by hash.  The `common` most frequent words, a
bounded number, are broadcast; for all other words a block of texts sends requests
to the buckets, which send the counts back to the block in the order asked.

Training documents: crc32(doc_id as text) mod 10 is not 0.

Cases: a null or empty text is its end alone; a null id counts as the empty text and
stays null; repeated rows are counted and scored each for themselves; a word of any
length is scored; without training documents N and V are 0 and the score is that of
the lattice; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _core
from .frequency import COUNTS, bucket_bits, dealt, merged, summed

FOLDS, HELD_OUT = 10, 0
COMMON = 1 << 17
BYTE_SHARE = 1e-4
END_SHARE = 2e-3
BLOCK_BYTES, ANSWER_BYTES = 8 << 20, 1 << 20
MERGE_ENTRIES = 1 << 20
FLOOR = 0.1  # the base's addition to every count

MESSAGES = "bucket int, kind int, block long, part int, a binary, b binary, c binary"
ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
REQUEST, HOME, COUNT = 0, 1, 2


class Lattice:
    """Log-probabilities of words under all segmentations into pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weights: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i).encode().replace(b"\xe2\x96\x81", b" "), model.get_score(i)
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or score < -1e8 or b" " in piece[1:] or piece != piece.translate(_core.LOWER):
                continue
            weights[piece] = 1 / (1 - score)
        total = sum(weights.values())
        left = 1 - BYTE_SHARE - END_SHARE
        self.log_byte, self.log_end = math.log(BYTE_SHARE / 256), math.log(END_SHARE)
        pieces = sorted(weights)
        joined = b"".join(pieces)
        size = np.array([len(p) for p in pieces])
        ends = np.cumsum(size)
        keys = _core.span_hashes(np.frombuffer(joined, dtype=np.uint8), ends - size, ends)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.logs = np.log(np.array([weights[p] * left / total for p in pieces]))[order]
        self.lengths = sorted(set(size.tolist()))
        self.find = _core.lookup(self.keys)

    def words(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of words; raw[start - 1] stands for the space before each."""
        out = np.empty(len(starts))
        size = ends - starts + 1
        order = np.argsort(size, kind="stable")
        bound = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for a, b in zip(bound[:-1], bound[1:]):
            for at in range(a, b, 1 << 14):
                some = order[at : min(b, at + (1 << 14))]
                out[some] = self._same(raw, starts[some] - 1, int(size[some[0]]))
        return out

    def _same(self, raw: bytes, starts: np.ndarray, n: int) -> np.ndarray:
        """Words of one length; the forward recursion runs over all of them at once."""
        data = np.frombuffer(raw, dtype=np.uint8)[starts[:, None] + np.arange(n)]
        data[:, 0] = 0x20
        flat, words = np.ascontiguousarray(data).reshape(-1), len(starts)
        row = np.arange(words) * n
        alpha = np.full((n + 1, words), -np.inf)
        alpha[0] = 0
        step = max(1, (1 << 20) // max(1, words * len(self.lengths)))  # places whose edges are looked up together
        for begin in range(0, n, step):
            stop = min(n, begin + step)
            edges = self._edges(flat, row, begin, stop, n)
            for place in range(begin, stop):
                into = place + 1
                here = [alpha[place] + self.log_byte] + [alpha[into - k] + e for k, e in edges[place]]
                here = np.stack(here)
                top = here.max(0)
                alpha[into] = top + np.log(np.exp(here - top).sum(0))
        return alpha[n]

    def _edges(self, flat: np.ndarray, row: np.ndarray, begin: int, stop: int, n: int) -> dict[int, list]:
        """For each last place of an edge in begin..stop-1: its lengths and the log-weights of every word."""
        out: dict[int, list] = {p: [] for p in range(begin, stop)}
        for k in self.lengths:
            places = np.arange(max(begin, k - 1), stop)
            if not len(places):
                break
            ends = (row[:, None] + places + 1).reshape(-1)
            found = self.find(_core.span_hashes(flat, ends - k, ends)).reshape(len(row), -1)
            logs = np.where(found >= 0, self.logs[found], -np.inf)
            for i, p in enumerate(places.tolist()):
                if (found[:, i] >= 0).any():
                    out[p].append((k, logs[:, i]))
        return out


@functools.lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def count(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a bucket: the words of the training documents with their counts."""
    bits = bucket_bits(docs.sparkSession)
    schema = _core.arrow_schema(COUNTS)
    plain = docs.filter(_core.crc_mod_column(id_col, FOLDS) != HELD_OUT).select(F.col(text_col).cast("binary").alias("t"))

    def rows(hashes, counts):
        found = [(k, hashes[a:b].tobytes(), counts[a:b].tobytes()) for k, a, b in dealt(hashes, bits)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], type=f.type) for i, f in enumerate(schema)], schema=schema)

    def gather(batches):
        hashes, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        for batch in batches:
            for part in _core.slices(batch, "t"):
                h, c = np.unique(_core.Words(part.column(0).to_pylist(), _core.SOLID, lower=True).hash, return_counts=True)
                hashes, counts = merged(np.concatenate([hashes, h]), np.concatenate([counts, c]))
                if len(hashes) > MERGE_ENTRIES:
                    yield rows(hashes, counts)
                    hashes, counts = hashes[:0], counts[:0]
        yield rows(hashes, counts)

    def merge(batches):
        bucket, h, c = summed(batches, np.uint64, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((bucket, h.tobytes(), c.tobytes()), schema)], schema=schema)

    return plain.mapInArrow(_core.tidy(gather), COUNTS).groupBy("bucket").applyInArrow(_core.tidy_stream(merge), COUNTS)


def summary(counts: DataFrame, common: int, bits: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Tokens and distinct words counted, and the `common` most frequent with their counts."""
    ddl = "tokens long, words long, hashes binary, counts binary"
    schema, each = _core.arrow_schema(ddl), -(-3 * common // (2 << bits))

    def run(batches):
        for batch in batches:
            for h, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                h, c = np.frombuffer(h, dtype=np.uint64), np.frombuffer(c, dtype=np.int64)
                top = np.argsort(-c, kind="stable")[:each]
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((int(c.sum()), len(c), h[top].tobytes(), c[top].tobytes()), schema)], schema=schema)

    rows = counts.mapInArrow(_core.tidy(run), ddl).collect()  # one a bucket, together 1.5 times `common` words at most
    h = np.concatenate([np.frombuffer(r.hashes, dtype=np.uint64) for r in rows] or [np.empty(0, dtype=np.uint64)])
    c = np.concatenate([np.frombuffer(r.counts, dtype=np.int64) for r in rows] or [np.empty(0, dtype=np.int64)])
    top = np.argsort(-c, kind="stable")[:common]
    top = top[np.argsort(h[top])]
    return sum(r.tokens for r in rows), sum(r.words for r in rows), h[top], c[top]


def score(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """Per document its tokens, how many are known, the base score and the model's, both log10."""
    spark = docs.sparkSession
    bits = bucket_bits(spark)
    counts = _core.materialise(count(docs, id_col, text_col), "word-counts")
    trained = docs.filter(_core.crc_mod_column(id_col, FOLDS) != HELD_OUT).count()
    tokens, distinct, top, top_counts = summary(counts, common, bits)
    tokens, distinct = tokens + trained, distinct + (trained > 0)
    held = spark.sparkContext.broadcast((top, top_counts))
    schema, row_schema = _core.arrow_schema(MESSAGES), _core.arrow_schema(ROWS)

    def values(count_: np.ndarray, log_lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.log10((count_ + FLOOR) / (tokens + FLOOR * (distinct + 1)))
        if not distinct:
            return base, log_lattice / math.log(10)
        model = np.logaddexp(np.log(np.maximum(count_, 1e-300)), math.log(distinct) + log_lattice) / math.log(10) - math.log10(tokens + distinct)
        return base, model

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], type=f.type) for i, f in enumerate(schema)], schema=schema)

    def ask(batches):
        """Blocks of texts: what is known here goes home, the rest is asked for."""
        net = lattice(pieces)
        words, word_counts = held.value
        find, logs = _core.lookup(words), np.full(len(words), np.nan)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        end = values(np.array([float(trained)]), np.array([net.log_end]))
        ids, home, asked, size = [], [], [], 0

        def flush():
            nonlocal ids, home, asked, size, number
            h, doc, log = (np.concatenate([x[i] for x in asked]) for i in range(3))
            order = np.argsort(h, kind="stable")
            h, doc, log = h[order], doc[order].astype(np.uint32), log[order].astype(np.float32)
            found = [(k, REQUEST, number, k, h[a:b].tobytes(), doc[a:b].tobytes(), log[a:b].tobytes()) for k, a, b in dealt(h, bits)]
            names = np.array([0 if i is None else i for i in ids], dtype=np.int64).tobytes() + bytes(i is None for i in ids)
            split = _core.crc_mod(ids, FOLDS).astype(np.int64).tobytes()
            found.append((((number >> 32) * 31 + (number & 0xFFFFFFFF) * 7919) % (1 << bits), HOME, number, -1, names, split, np.concatenate(home, axis=1).tobytes()))
            number += 1
            ids, home, asked, size = [], [], [], 0
            return table(found)

        for batch in batches:
            for part in _core.slices(batch, "t"):
                texts = part.column(1).to_pylist()
                w = _core.Words(texts, _core.SOLID, lower=True)
                raw, starts, ends = b" " + w.raw, w.starts + 1, w.ends + 1
                place, owner = find(w.hash), w.owner()
                near = np.flatnonzero(place >= 0)
                new, at = np.unique(place[near], return_index=True)
                fresh = np.isnan(logs[new])
                new, at = new[fresh], near[at[fresh]]
                logs[new] = net.words(raw, starts[at], ends[at])
                n = float(trained > 0)
                figures = np.stack([w.counts + 1, np.full(len(texts), n), np.full(len(texts), end[0][0]), np.full(len(texts), end[1][0])]).astype(np.float64)
                base, model = values(word_counts[place[near]].astype(float), logs[place[near]])
                for k, v in ((1, np.ones(len(near))), (2, base), (3, model)):
                    figures[k] += np.bincount(owner[near], v, len(texts))
                far = np.flatnonzero(place < 0)
                distinct_far, at, back = np.unique(w.hash[far], return_index=True, return_inverse=True)
                log = net.words(raw, starts[far[at]], ends[far[at]])[back]
                asked.append((w.hash[far], owner[far] + len(ids), log))
                home.append(figures)
                ids += part.column(0).to_pylist()
                size += len(w.raw)
                if size >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    def answer(batches):
        """One bucket: its counts, which come first, answer the requests one by one; homes pass through."""
        h, c, out, size = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, k, block, part, a, b, log = (batch.column(j)[i].as_py() for j in range(7))
                if k == COUNT:
                    h, c = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.int64)
                    continue
                if k == REQUEST:
                    asked = np.frombuffer(a, dtype=np.uint64)
                    got = np.zeros(len(asked), dtype=np.int64)
                    if len(h):
                        place = np.minimum(np.searchsorted(h, asked), len(h) - 1)
                        got = np.where(h[place] == asked, c[place], 0)
                    a = got.astype(np.uint32 if got.max(initial=0) < 1 << 32 else np.uint64).tobytes()
                out.append((bucket, k, block, part, a, b, log))
                size += len(a) + len(b) + len(log)
                if size > ANSWER_BYTES:
                    yield table(out)
                    out, size = [], 0
        yield table(out)

    def sum_up(data: pa.Table) -> pa.Table:
        """One block: its texts' figures with all that was answered."""
        rows = sorted(zip(*(data.column(j).to_pylist() for j in (1, 3, 4, 5, 6))), key=lambda r: (-r[0], r[1]))
        _, _, names, split, figures = rows[0]
        n = len(split) // 8
        figures = np.frombuffer(figures, dtype=np.float64).reshape(4, n).copy()
        for _, _, got, doc, log in rows[1:]:
            log = np.frombuffer(log, dtype=np.float32).astype(np.float64)
            got = np.frombuffer(got, dtype=np.uint32 if len(got) == 4 * len(log) else np.uint64).astype(np.float64)
            doc = np.frombuffer(doc, dtype=np.uint32)
            base, model = values(got, log)
            for k, v in ((1, got > 0), (2, base), (3, model)):
                figures[k] += np.bincount(doc, v, n)
        null = np.frombuffer(names, dtype=np.uint8, offset=8 * n).astype(bool)
        ids = pa.array(np.frombuffer(names, dtype=np.int64, count=n), mask=null)
        fold = np.frombuffer(split, dtype=np.int64)
        whole = figures[:2].round().astype(np.int64)
        return pa.table([ids, pa.array(fold == HELD_OUT), whole[0], whole[1], np.full(n, tokens), figures[2], figures[3]], schema=row_schema)

    requests = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).mapInArrow(_core.tidy(ask), MESSAGES)
    none = F.lit(None).cast("binary")
    known = counts.select("bucket", F.lit(COUNT).alias("kind"), F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("part"), F.col("hashes").alias("a"), F.col("counts").alias("b"), none.alias("c"))
    # sorted by kind within a bucket, the counts first
    dealt_out = requests.unionByName(known).repartition("bucket").sortWithinPartitions("bucket", F.col("kind").desc())
    answered = dealt_out.groupBy("bucket").applyInArrow(_core.tidy_stream(answer), MESSAGES)
    return answered.groupBy("block").applyInArrow(_core.tidy_group(sum_up), ROWS)


def op10_lm_score(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return score(_core.read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
