"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents inside one task.  Its words become symbols, its
suffixes are sorted, and the Burrows-Wheeler transform is held in a wavelet
matrix.  Backward search takes all benchmark windows at once; occurrences are
located by walking back to a sampled suffix position; the spans found in one
document are merged.  Only stretches of benchmark words at least as long as the
shortest window enter the index: no window can occur outside them.

Windows: `width` consecutive words of an item; an item of fewer words, but not
none, is one window.  Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are
lowered.

Cases: null or empty texts and items have no words and match nothing; an item
without an id takes part with its windows, but is not listed; repeated items count
once by their id, repeated documents each for themselves; items that
share a window are all reported; long texts are indexed whole; an empty
benchmark or table gives rows without hits; columns other than the id and the text are
not read, and pass through remove() whatever their names.  The benchmark is read in blocks
of max_block_bytes, each broadcast alone; a worker holds one at a time, whatever the size
of the benchmark, and then takes larger shards, so as to load blocks less often.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _core

WIDTH = 10
MAX_BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20  # of a shard where the benchmark takes several blocks
SAMPLE = 16


class WaveletMatrix:
    """rank and access over an array of symbols below 2**levels, for many queries at once."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often symbol occurs before place."""
        low = np.zeros_like(place)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[low], ones[place]
            low, place = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, place - b)
        return place - low

    def access(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[place]
            bit = ones[place + 1] - a
            out = out * 2 + bit
            place = np.where(bit == 1, zeros + a, place - a)
        return out


class FMIndex:
    """Over symbols 1..sigma-1; symbol 0 ends the text."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.append(text, 0).astype(np.int64)
        n = self.n = len(text)
        rank, reach = text, 1
        order = np.argsort(rank, kind="stable")
        while True:  # each round sorts by twice as many symbols
            key = rank * (int(rank.max()) + 2)
            key[: n - reach] += rank[reach:] + 1
            order = np.argsort(key, kind="stable")
            held = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
            rank = new
            reach *= 2
            if reach >= n or rank[order[-1]] == n - 1:
                break
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        kept = order % sample == 0
        self.sampled, self.position = np.concatenate([[0], np.cumsum(kept)]), order[kept]

    def back(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, place)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """patterns: one a row. Those that occur, with their ranges of suffixes."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[which, k]
            low, high = self.back(symbol, low), self.back(symbol, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, pending, steps = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(pending):
            here = self.sampled[rows + 1] > self.sampled[rows]
            out[pending[here]] = self.position[self.sampled[rows[here]]] + steps
            pending, rows = pending[~here], rows[~here]
            rows = self.back(self.tree.access(rows), rows)
            steps += 1
        return out


class Windows:
    """The distinct windows of a block of items, as word symbols from 2 on (1 parts stretches)."""

    def __init__(self, item_ids: list[str | None], texts: list, width: int = WIDTH):
        w = _core.Words(texts, _core.ALNUM, lower=True)
        self.words, symbol = np.unique(w.hash, return_inverse=True)
        symbol = (symbol + 2).astype(np.int32)
        self.items = sorted({str(x) for x in item_ids if x is not None})
        place = {x: k for k, x in enumerate(self.items)}
        number = np.array([-1 if x is None else place[str(x)] for x in item_ids], dtype=np.int64)
        self.groups = []  # (windows of one length; items of window k at owners[first[k]:first[k+1]])
        size = np.minimum(w.counts, width)
        for length in np.unique(size[size > 0]).tolist():
            some = np.flatnonzero(size == length)
            each = w.counts[some] - length + 1
            at = np.repeat(w.first[some], each) + _core.runs(each)
            rows = np.ascontiguousarray(symbol[at[:, None] + np.arange(length)])
            held, which = np.unique(rows.view([("", rows.dtype)] * length).reshape(-1), return_inverse=True)
            pairs = np.unique(np.stack([which, np.repeat(number[some], each)]), axis=1)
            pairs = pairs[:, pairs[1] >= 0]
            self.groups.append((held.view(rows.dtype).reshape(-1, length), np.searchsorted(pairs[0], np.arange(len(held) + 1)), pairs[1]))
        self.least = int(size[size > 0].min()) if (size > 0).any() else 0

    def scan(self, w: _core.Words, find) -> tuple[np.ndarray, list[set]]:
        """Which words of a slice are hit, and the items found in each text."""
        hit, items = np.zeros(len(w.starts) + 1, dtype=np.int64), [set() for _ in w.counts]
        symbol = find(w.hash) + 2
        inside = symbol > 1
        if not self.least or not inside.any():
            return hit[:-1] > 0, items
        owner = w.owner()
        change = np.flatnonzero(np.concatenate([[True], (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])]))
        size = np.diff(np.append(change, len(inside)))
        good = inside[change] & (size >= self.least)
        if not good.any():
            return hit[:-1] > 0, items
        size, change = size[good], change[good]
        at = np.repeat(change, size + 1) + _core.runs(size + 1)  # each stretch and one place for its separator
        text = np.ones(len(at), dtype=np.int64)
        real = _core.runs(size + 1) < np.repeat(size, size + 1)
        text[real] = symbol[at[real]]
        index = FMIndex(text, len(self.words) + 2)
        there = np.zeros(len(self.words) + 2, dtype=bool)
        there[text] = True
        for patterns, first, owners in self.groups:
            here = np.flatnonzero(there[patterns].all(1))  # windows of which some word is missing can't occur
            which, low, high = index.search(patterns[here])
            which = here[which]
            count = high - low
            start = at[index.locate(np.repeat(low, count) + _core.runs(count))]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + patterns.shape[1], -1)
            for doc, k in {*zip(owner[start].tolist(), np.repeat(which, count).tolist())}:
                items[doc].update(owners[first[k] : first[k + 1]].tolist())
        return np.cumsum(hit[:-1]) > 0, items


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, max_block_bytes: int = MAX_BLOCK_BYTES) -> list:
    """Broadcasts of Windows, each of about max_block_bytes of benchmark text."""
    spark = benchmark.sparkSession
    plain = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    n = 1 + int(plain.agg(F.sum(F.length("t"))).first()[0] or 0) // max_block_bytes
    out = []
    for k in range(n):
        rows = (plain if n == 1 else plain.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).filter("t is not null").collect()
        out.append(spark.sparkContext.broadcast(Windows([r.i for r in rows], [bytes(r.t) for r in rows], width)))
    return out


def _scanner(held: list):
    finds: dict[int, object] = {}

    def scan(texts: list) -> tuple[_core.Words, np.ndarray, list[set]]:
        w = _core.Words(texts, _core.ALNUM, lower=True)
        hit, items = np.zeros(len(w.starts), dtype=bool), [set() for _ in texts]
        for k, b in enumerate(held):
            own = b.value
            if k not in finds:
                finds[k] = _core.lookup(own.words)
            h, found = own.scan(w, finds[k])
            hit |= h
            for i, x in enumerate(found):
                if x:
                    items[i].update(own.items[j] for j in x)
            if len(held) > 1:
                del b._value, finds[k], own  # read anew when it is needed again
        return w, hit, items

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: n_words, n_hit, and the ids of the items found, sorted as strings."""
    held = blocks(benchmark, width=width)

    def make():
        run = _scanner(held)

        def work(cols, texts):
            w, hit, items = run(texts)
            total = np.concatenate([[0], np.cumsum(hit)])
            names = [sorted(x) for x in items]
            return {
                "doc_id": cols[0],
                "n_words": w.counts,
                "n_hit": total[w.first[1:]] - total[w.first[:-1]],
                "n_items": [len(x) for x in names],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
                "items": names,
            }

        return work

    ddl = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>"
    return _core.map_texts(docs, make, ddl, (id_col,), text_col, _shard(held))


def _shard(held: list) -> int:
    return _core.SLICE_BYTES if len(held) == 1 else SHARD_BYTES


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without the merged spans of hit words, each replaced by a newline."""
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    a, b = starts[np.flatnonzero(step == 1)], ends[np.flatnonzero(step == -1) - 1]
    return b"\n".join(text[i:j] for i, j in zip([0, *b], [*a, len(text)]))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs without benchmark passages: merged spans are cut from the texts, again
    where what is left has grown together into a window.  A document of which no
    word is left goes; documents without a hit stay as they are."""
    held = blocks(benchmark, width=width)

    def make():
        run = _scanner(held)

        def work(cols, texts):
            out, keep, todo = list(texts), [True] * len(texts), list(range(len(texts)))
            while todo:
                w, hit, _ = run([out[i] for i in todo])
                again = []
                for k, i in enumerate(todo):
                    a, b = w.first[k], w.first[k + 1]
                    if hit[a:b].any():
                        out[i] = cut(out[i], w.starts[a:b] - w.offsets[k], w.ends[a:b] - w.offsets[k], hit[a:b])
                        keep[i] = not hit[a:b].all()
                        again.append(i)
                todo = again
            return out, keep

        return work

    return _core.rewrite_texts(docs, make, (), text_col, max_bytes=_shard(held))


def op4_decontaminate(spark, sf_dir) -> DataFrame:
    found = scan(_core.read_table(spark, sf_dir, "documents"), _core.read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.col("n_hit") > 0).drop("items")
