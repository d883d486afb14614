"""Line dedup by content-defined chunks of lines, and by runs up to the edges of passages.

A rolling hash runs over the hashes of a document's lines (those with a word); a
chunk begins where it is divisible by a small number.  Where a chunk begins thus
depends only on the lines around it: text put in before it does not move it.  One
division cuts through some passages, so several, each with its own window and
divisor, are made side by side.  A chunk counts if it has at least two lines and
min_words words; a line of LONG_LINE words or more counts by itself, too.

A chunk's ends depend on the lines next to it, so chunks miss edges of passages, and
short passages whole.  With runs=True the shortest runs of that size count beside them, one
from every line on and one up to every line: they cover every repeated run of lines
that is large enough, to its edges.

Chunks are counted over all documents by hash, in a table of fixed size; those that
may repeat are compared by the hashes of all their lines.  Tasks send the bytes of
these lines, each once, to be compared with other tasks' lines of equal hash; a hash
that stands for different bytes is replaced by a digest of the bytes, so equal
chunks have equal bytes.  Lines and touched texts travel compressed.  The first occurrence, by document id and line, stays; the
lines of all others go.

Cases: a null text stays null, an empty one empty; rows of one id and one text are
the same document and lose the same lines; a null id sorts first; documents without
a repeated chunk keep their text, those of which no word is left go; a text whose only
line with words is a long one stays where the first occurrence is the same whole text
(a copy of a document, left to the join of near duplicates); a text may have
any number of lines; extra columns pass through remove() whatever their names, and
report() does not read them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _core, frequency

#: (lines under the rolling hash, divisor) of each division
DIVISIONS = ((1, 2), (1, 3), (2, 2), (2, 3), (2, 5))
MIN_LINES, MIN_WORDS = 2, 10
#: words from which a single line counts
LONG_LINE = 50
SLOT_BITS = 25
FLUSH_BYTES = 6 << 20

CHUNKS = "kind int, flush long, v long, key long, body binary, doc long, th long, a long, n long, places binary"
VERDICTS = "flush long, v long, doc long, th long, a long"
CHUNK, LINE = 0, 1
GONE = "doc_id long, th long, a long, b long"


class Lines:
    """The lines with words of a slice of texts, by number and by bytes."""

    def __init__(self, texts: list):
        w = _core.Words(texts, _core.SOLID, hashes=False)
        self.raw, self.data = w.raw, w.data
        ends = np.append(np.flatnonzero(w.data == 10), len(w.data)) if texts else np.empty(0, dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        words = np.diff(np.append(np.searchsorted(w.starts, starts), len(w.starts)))
        doc = np.searchsorted(w.offsets, starts, "right") - 1
        number = np.arange(len(starts)) - np.searchsorted(starts, w.offsets[:-1])[doc] if len(starts) else doc
        real = words > 0
        self.starts, self.ends, self.words, self.doc, self.number = (x[real] for x in (starts, ends, words, doc, number))
        self.hash = _core.hash_runs(self.data, self.starts, self.ends)

    def alone(self, k: int) -> bool:
        """Whether line k is the only one with words of its text."""
        return (k == 0 or self.doc[k - 1] != self.doc[k]) and (k + 1 == len(self.doc) or self.doc[k + 1] != self.doc[k])

    def chunks(self, divisions=DIVISIONS, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS):
        """(key, first line, last line) of the chunks of each division."""
        n = len(self.hash)
        if not n:
            return
        new = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        total = np.concatenate([[0], np.cumsum(self.words)])
        for window, divisor in divisions:
            roll = np.zeros(n, dtype=np.uint64)
            for k in range(window):
                roll[k:] += self.hash[: n - k] * np.uint64(2 * k + 1)
            begin = np.flatnonzero(new | (_core.mix(roll + np.uint64(window)) % np.uint64(divisor) == 0))
            last = np.append(begin[1:], n) - 1
            good = (last - begin + 1 >= min_lines) & (total[last + 1] - total[begin] >= min_words)
            begin, last = begin[good], last[good]
            yield _core.hash_runs(self.data, self.starts[begin], self.ends[last]), begin, last

    def shortest(self, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS):
        """(key, first line, last line) of the shortest runs from each line on, and up to each line."""
        n = len(self.hash)
        total, k = np.concatenate([[0], np.cumsum(self.words)]), np.arange(n)
        last = np.maximum(k + min_lines, np.searchsorted(total, total[:-1] + min_words)) - 1
        begin = np.minimum(k - min_lines, np.searchsorted(total, total[1:] - min_words, "right") - 2) + 1
        ahead, back = last < n, begin >= 0
        ahead[ahead] = self.doc[last[ahead]] == self.doc[ahead]
        back[back] = self.doc[begin[back]] == self.doc[back]
        # none lies strictly within another, so both begins and ends are in order
        both = np.unique(np.concatenate([k[ahead] * n + last[ahead], begin[back] * n + k[back]]))
        begin, last = both // max(n, 1), both % max(n, 1)
        return _core.hash_runs(self.data, self.starts[begin], self.ends[last]), begin, last

    def counted(self, runs: bool = False):
        """(key, first line, last line), each once, of all that counts: chunks, if asked for shortest runs, and long lines."""
        found = [*self.chunks(), *([self.shortest()] if runs else [])]
        if found:
            key, begin, last = (np.concatenate(x) for x in zip(*found))
            one = np.unique(begin * len(self.hash) + last, return_index=True)[1]  # divisions and runs have some in common
            yield key[one], begin[one], last[one]
        long = np.flatnonzero(self.words >= LONG_LINE)
        yield self.hash[long], long, long


def _pressed(lines: list[tuple[int, bytes]]) -> bytes:
    """Lines with their hashes in one compressed body."""
    keys, size = np.array([h for h, _ in lines], dtype=np.int64), np.array([len(b) for _, b in lines], dtype=np.int64)
    raw = b"".join([np.int64(len(lines)).tobytes(), keys.tobytes(), size.tobytes(), *(b for _, b in lines)])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpressed(body: bytes):
    """The lines of _pressed()."""
    raw = pa.decompress(body[8:], decompressed_size=int(np.frombuffer(body[:8], dtype=np.int64)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    keys, size = np.frombuffer(raw, dtype=np.int64, count=2 * n, offset=8).reshape(2, n).tolist()
    at = 8 + 16 * n
    for key, k in zip(keys, size):
        yield key, raw[at : at + k]
        at += k


def _hashes(runs: bool):
    def run(texts: list) -> np.ndarray:
        return np.concatenate([np.empty(0, dtype=np.uint64), *(key for key, _, _ in Lines(texts).counted(runs))])

    return run


def _sequence(lines: Lines, x: int, y: int, collided: frozenset) -> bytes:
    """What stands for the bytes of lines x..y: their hashes, or digests where a hash is not enough."""
    hashes = lines.hash[x : y + 1]
    if not collided or not any(h in collided for h in hashes.tolist()):
        return hashes.tobytes()
    body = lambda k: lines.raw[lines.starts[k] : lines.ends[k]]
    return b"".join(bytes(8) + hashlib.sha256(body(k)).digest() if int(lines.hash[k]) in collided else lines.hash[k].tobytes() for k in range(x, y + 1))


def _chunk_rows(plain: DataFrame, table: np.ndarray, slot_bits: int, bits: int, collided: frozenset, runs: bool) -> DataFrame:
    """Chunks that may repeat, one row a flush and chunk with all its places there, and their
    lines, one row a flush and bucket of their hashes (v)."""
    schema, held = _core.arrow_schema(CHUNKS), plain.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        found, bodies, size, number = {}, {}, 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def flush():
            nonlocal size, number
            rows = []
            for v, ((key, body), places) in enumerate(found.items()):
                doc, th, a, *_ = min(places, key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2]))
                flat = np.array([[0 if d is None else d, (d is None) + 2 * alone, t, x, y] for d, t, x, y, alone in places], dtype=np.int64)
                rows.append((CHUNK, number, v, key, body, doc, th, a, len({p[:3] for p in places}), flat.tobytes()))
            dealt: dict[int, list] = {}
            for h, body in sorted(bodies):
                dealt.setdefault((h & (1 << 64) - 1) >> (64 - bits), []).append((h, body))
            rows += [(LINE, number, k, None, _pressed(own), None, None, None, None, None) for k, own in dealt.items()]
            found.clear()
            bodies.clear()
            size, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for part in _core.slices(batch, "t"):
                ids, texts, hashes = (part.column(i).to_pylist() for i in range(3))
                lines = Lines(texts)
                used = np.zeros(len(lines.hash) + 1, dtype=np.int64)
                for keys, first, last in lines.counted(runs):
                    some = np.flatnonzero(frequency.level_of(held.value, slot_bits, keys))
                    np.add.at(used, first[some], 1)
                    np.add.at(used, last[some] + 1, -1)
                    for key, x, y in zip(keys[some].astype(np.int64).tolist(), first[some].tolist(), last[some].tolist()):
                        doc, body = lines.doc[x], _sequence(lines, x, y, collided)
                        size += 64 + len(body)
                        found.setdefault((key, body), []).append((ids[doc], hashes[doc], int(lines.number[x]), int(lines.number[y]), x == y and lines.alone(x)))
                for k in np.flatnonzero(np.cumsum(used[:-1])).tolist():
                    body = lines.raw[lines.starts[k] : lines.ends[k]]
                    if (line := (int(lines.hash[k].astype(np.int64)), body)) not in bodies:
                        bodies[line] = None
                        size += 64 + len(body)
                if size > FLUSH_BYTES:
                    yield flush()
        yield flush()

    return _core.materialise(plain.mapInArrow(_core.tidy(run), CHUNKS), "chunks")


def _collisions(rows: DataFrame) -> frozenset:
    """Hashes that stand for lines of different bytes.  Of n lines n*n / 2**65 are expected:
    none, in practice."""
    schema = _core.arrow_schema("key long")

    def compare(batches):
        seen: dict[int, bytes] = {}
        out = {key for batch in batches for blob in batch.column(1) for key, body in _unpressed(blob.as_py()) if seen.setdefault(key, body) != body}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), type=pa.int64())], schema=schema)

    found = rows.filter(F.col("kind") == LINE).select("v", "body").groupBy("v").applyInArrow(_core.tidy_stream(compare), "key long").collect()
    return frozenset(r.key & (1 << 64) - 1 for r in found)


def repeated(docs: DataFrame, id_col: str, text_col: str, slot_bits: int = SLOT_BITS, collided: frozenset = frozenset(), runs: bool = False) -> DataFrame:
    """The line ranges a..b of documents, by id and hash of the text, that repeat an earlier one."""
    plain = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("binary").alias("t"), F.xxhash64(F.col(f"`{text_col}`")).alias("th")).filter("t is not null")
    bits = min(frequency.bucket_bits(docs.sparkSession), slot_bits - 4)
    table = frequency.levels(plain.select("i", "t"), lambda: _hashes(runs), (2, 1 << 62, 1 << 62), bits, slot_bits)
    verdict_schema, gone_schema = (_core.arrow_schema(x) for x in (VERDICTS, GONE))

    def judge(batches):
        """One bucket of chunks: the first occurrence of each that is found more than once."""
        met: dict[tuple, list] = {}
        for batch in batches:
            for flush, v, key, body, doc, th, a, n in zip(*(batch.column(k).to_pylist() for k in ("flush", "v", "key", "body", "doc", "th", "a", "n"))):
                met.setdefault((key, body), []).append((doc is not None, doc or 0, th, a, flush, v, n))
        out = []
        for rows in met.values():
            if len(rows) > 1 or rows[0][-1] > 1:
                real, doc, th, a, *_ = min(rows)
                out += [(flush, v, doc if real else None, th, a) for *_, flush, v, _ in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(verdict_schema)], schema=verdict_schema)

    rows = _chunk_rows(plain, table, slot_bits, bits, collided, runs)
    if more := _collisions(rows) - collided:
        _core.discard(rows)
        rows = _chunk_rows(plain, table, slot_bits, bits, collided | more, runs)
    # a bucket gets one row a flush and chunk, however often that occurs; its places stay behind
    chunks = rows.filter(F.col("kind") == CHUNK)
    bucket = F.shiftrightunsigned("key", 64 - bits).cast("int").alias("bucket")
    verdicts = chunks.select(bucket, "flush", "v", "key", "body", "doc", "th", "a", "n").groupBy("bucket").applyInArrow(_core.tidy_stream(judge), VERDICTS)
    met = chunks.select("flush", "v", "places").join(verdicts, ["flush", "v"]).select("doc", "th", "a", "places")

    def others(batches):
        for batch in batches:
            out = []
            for doc, th, a, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for d, flags, t, x, y in np.frombuffer(places, dtype=np.int64).reshape(-1, 5).tolist():
                    d = None if flags & 1 else d
                    if (d, t, x) != (doc, th, a) and not (flags & 2 and t == th):
                        out.append((d, t, x, y))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(gone_schema)], schema=gone_schema)

    out = met.mapInArrow(_core.tidy(others), GONE)
    out.chunks = rows  # written, and read when `out` runs
    return out


def drop_lines(text: bytes, ranges: list) -> tuple[bytes, int]:
    """The text without the lines of the ranges (a, b), and how many with words went."""
    lines, gone = text.split(b"\n"), set()
    for a, b in ranges:
        gone.update(range(a, b + 1))
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), sum(bool(lines[i].split()) for i in gone)


def _marked(docs: DataFrame, id_col: str, text_col: str, runs: bool) -> tuple[DataFrame, DataFrame, str]:
    """The documents without a repeat; the others, their texts pressed, with the ranges that go
    from each, by id and text; the name of the column of ranges, which docs does not have.  Only documents that may lose lines, by a bitmap of the texts' hashes, are shuffled to
    meet their ranges."""
    ranges = "array<struct<a:bigint,b:bigint>>"
    of, h, th, gone = _core.new_names(docs, "id_of", "hash_of", "text_hash", "gone")
    found = repeated(docs, id_col, text_col, runs=runs)
    marks = found.groupBy(F.col("doc_id").alias(of), F.col("th").alias(h)).agg(F.collect_set(F.struct("a", "b")).cast(ranges).alias(gone))
    marks = _core.materialise(marks, "gone")
    _core.discard(found.chunks)
    bitmap = frequency.held_bits(marks, h)
    hashed = docs.withColumn(th, F.xxhash64(F.col(f"`{text_col}`")))
    hit = frequency.with_bits(hashed, th, bitmap, text_col)
    hit = hit.join(marks, F.col(f"`{id_col}`").eqNullSafe(F.col(of)) & (F.col(th) == F.col(h)), "left")
    return frequency.without_bits(hashed, th, bitmap).drop(th), hit.drop(of, h, th), gone


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """docs without repeated chunks, and runs if asked for; a document that loses its last word goes."""

    def make():
        def work(cols, texts):
            out, keep = list(texts), [True] * len(texts)
            for i, (gone, t) in enumerate(zip(cols[0], texts)):
                if gone and t is not None:
                    out[i], _ = drop_lines(t, [(g["a"], g["b"]) for g in gone])
                    keep[i] = bool(out[i].split())
            return out, keep

        return work

    clean, hit, gone = _marked(docs, id_col, text_col, runs)
    return clean.unionByName(_core.rewrite_texts(hit, make, (gone,), text_col, out=clean.schema[text_col].dataType).drop(gone))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """Per document: its lines with words, how many went, the ranges of those, and the sha256 of what is left."""

    def make():
        def work(cols, texts):
            out = {"doc_id": cols[0], "n_lines": [], "n_removed": [], "removed": [], "text_sha256": []}
            for gone, t in zip(cols[1], texts):
                ranges = sorted((g["a"], g["b"]) for g in gone or ())
                left, n = drop_lines(t, ranges) if ranges and t is not None else (t, 0)
                out["n_lines"].append(sum(bool(x.split()) for x in (t or b"").split(b"\n")))
                out["n_removed"].append(n)
                out["removed"].append(",".join(f"{a}:{b}" for a, b in ranges))
                out["text_sha256"].append(None if left is None else hashlib.sha256(left).hexdigest())
            return out

        return work

    plain = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    clean, hit, gone = _marked(plain, "i", "t", runs)
    ddl = "doc_id long, n_lines long, n_removed long, removed string, text_sha256 string"
    clean = clean.withColumn(gone, F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    return _core.map_texts(clean, make, ddl, ("i", gone), "t").union(_core.map_texts(hit, make, ddl, ("i", gone), "t", pressed=True))


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    return report(_core.read_table(spark, sf_dir, "documents"), runs=True)
