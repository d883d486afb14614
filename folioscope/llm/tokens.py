"""Token ids of whole texts, with each distinct chunk encoded once a worker.

The vocabularies here split a text at white space before any merge, so the ids of
a text are those of its chunks, one after another.  Chunks repeat; each task finds
the distinct ones of a slice by hash, compares the bytes of all that share one, and asks
the library only for chunks it has not met.  Texts with a chunk whose hash stands for other
bytes, and texts with rare white space, where a cut could fall differently, go to the
library whole.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

from . import _core

#: White space other than \\x20 and \\x09-\\x0D, in UTF-8.
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: One of these is in every text with such white space.
_ODD_SIGNS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Chunks that are asked for in one text, and the bytes that case and normal forms leave as many as they are.
_TOGETHER = 4096
_STEADY = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\xbf])*")
_SPACE = b" \t\n\v\f\r"
#: Chunks held by a worker before it starts anew; a bound on memory, not on results.
HELD_CHUNKS = 750_000
HELD_IDS = 3_000_000
HELD_BYTES = 12 << 20


class Encoder:
    """ids of texts under a tokenizers file. spaced: a chunk takes in the white space
    before it (byte-level vocabularies); else white space yields no ids.  share: of the bounds on what is held."""

    def __init__(self, path: str, spaced: bool, share: float = 1.0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced, self.share = spaced, share
        # the bytes that each id stands for: a byte-level vocabulary spells a byte as a character
        vocabulary = self.tokenizer.get_vocab()
        close = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for piece, k in vocabulary.items():
            self.bytes[k] = len(piece.removesuffix(close))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)  # sorted hashes of the chunks held
        self.begin, self.size = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint32)
        self.ids, self.used = np.empty(1 << 18, dtype=np.uint32), 0
        self.raw, self.raw_used = np.empty(1 << 18, dtype=np.uint8), 0  # the bytes of the chunks held
        self.raw_at, self.raw_size = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._library([r.decode("utf-8", "replace") for r in raw])
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(size.sum())), size

    def _many(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after another, and how many each has.  Most chunks are encoded
        in one text; the bytes that ids stand for tell where each ends.  Where these do not
        add up to the chunks' own, every chunk is asked for by itself."""
        if self.spaced:  # parted by the white space they begin with
            fits = [r[0] in _SPACE and r[-1] not in _SPACE for r in raw]
        else:
            fits = [_STEADY.fullmatch(r) is not None for r in raw]
        rest = [r for r, x in zip(raw, fits) if x]
        if not rest:
            return self._apart(raw)
        ids = np.array(self._library([(b"" if self.spaced else b" ").join(rest).decode("utf-8", "replace")])[0], dtype=np.uint32)
        ends, want = np.cumsum(self.bytes[ids]), np.cumsum([len(r) for r in rest])
        place = np.searchsorted(ends, want)
        if not len(ids) or ends[-1] != want[-1] or (ends[place] != want).any():
            return self._apart(raw)
        size = np.diff(place, prepend=-1)
        if len(rest) == len(raw):
            return ids, size
        single = np.flatnonzero(~np.array(fits))
        more, own = self._apart([raw[k] for k in single.tolist()])
        at = single - np.arange(len(single))  # where each lies among the others
        before = np.concatenate([[0], np.cumsum(size)])[at]
        return np.insert(ids, np.repeat(before, own), more), np.insert(size, at, own)

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        """Adds chunks; hashes are sorted, and none is held."""
        size = np.empty(len(raw), dtype=np.uint32)
        begin = self.used
        for at in range(0, len(raw), _TOGETHER):
            ids, own = self._many(raw[at : at + _TOGETHER])
            size[at : at + len(own)] = own
            n = len(ids)
            if self.used + n >= len(self.ids):
                self.ids = np.resize(self.ids, max(3 * len(self.ids) // 2, self.used + n + 1))
            self.ids[self.used : self.used + n] = ids
            self.used += n
        joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if self.raw_used + len(joined) + 8 > len(self.raw):
            self.raw = np.resize(self.raw, max(3 * len(self.raw) // 2, self.raw_used + len(joined) + 8))
        self.raw[self.raw_used : self.raw_used + len(joined)] = joined
        raw_size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        raw_at = self.raw_used + np.cumsum(raw_size) - raw_size
        self.raw_used += len(joined)
        at = np.searchsorted(self.keys, hashes)
        self.raw_at, self.raw_size = np.insert(self.raw_at, at, raw_at), np.insert(self.raw_size, at, raw_size)
        self.begin = np.insert(self.begin, at, begin + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.keys = np.insert(self.keys, at, hashes)

    def encode(self, texts: list, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (bytes or None), with `end` after each if given, and how many each has."""
        whole = {}
        if self.spaced and any(x in t for t in texts if t for x in _ODD_SIGNS):
            whole = {i: t for i, t in enumerate(texts) if t and _ODD_SPACE.search(t)}
        w = _core.Words([None if i in whole else t for i, t in enumerate(texts)], _core.SOLID, hashes=False)
        starts, ends, first = w.starts, w.ends, w.first
        if self.spaced:
            # a chunk begins where the one before it ends; white space that closes a text is a chunk too
            a, b = w.offsets[:-1], w.offsets[1:] - 1
            last = np.where(w.counts > 0, ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, a)
            tail = b > last
            new_starts = np.concatenate([[0], ends[:-1]]) if len(ends) else starts
            new_starts[first[:-1][w.counts > 0]] = a[w.counts > 0]
            at = first[1:][tail]
            starts, ends = np.insert(new_starts, at, last[tail]), np.insert(ends, at, b[tail])
            first = first + np.concatenate([[0], np.cumsum(tail)])
        hashes = _core.hash_runs(w.data, starts, ends)
        distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > HELD_CHUNKS * self.share or self.used > HELD_IDS * self.share or self.raw_used > HELD_BYTES * self.share:
            self._clear()
        slots = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        known[slots < len(self.keys)] = True
        known[known] = self.keys[slots[known]] == distinct[known]
        if not known.all():
            self._learn(distinct[~known], [w.raw[a:b] for a, b in zip(starts[place[~known]].tolist(), ends[place[~known]].tolist())])
            slots = np.searchsorted(self.keys, distinct)
        slots = slots[inverse]
        wrong = self._unlike(w.data, starts, ends, slots)
        if len(wrong):  # two chunks of one hash
            whole |= {i: texts[i] for i in set((np.searchsorted(first, wrong, "right") - 1).tolist())}
        return self._flat(slots, first, whole, end)

    def _unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Places of chunks that are not the bytes held under their hash: up to 16 bytes by their
        first and last eight, longer ones byte by byte."""
        size, other = ends - starts, self.raw_size[slots]
        same, at = size == other, self.raw_at[slots]
        if len(data) < 8 or len(self.raw) < 8:
            return np.flatnonzero(_core.unlike(data, starts, size, self.raw, at, other))
        # eight bytes from any place on, by a view of overlapping numbers; what lies behind a short chunk is masked
        eight = lambda x: np.ndarray(len(x) - 7, dtype="<u8", buffer=x, strides=(1,))
        near, held = eight(np.concatenate([data, np.zeros(8, dtype=np.uint8)])), eight(self.raw)
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)[np.minimum(size, 8)]
        same &= (near[starts] ^ held[at]) & mask == 0
        back = np.maximum(size - 8, 0)
        same &= (near[starts + back] ^ held[np.minimum(at + back, len(held) - 1)]) & mask == 0
        long = np.flatnonzero(same & (size > 16))
        if len(long):
            same[long] &= ~_core.unlike(data, starts[long], size[long], self.raw, at[long], other[long])
        return np.flatnonzero(~same)

    def _flat(self, slots: np.ndarray, first: np.ndarray, whole: dict, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, those of `whole` texts by the library, an end id after each text."""
        begin, size = self.begin[slots].astype(np.int64), self.size[slots].astype(np.int64)
        texts = len(first) - 1
        if end is not None:
            self.ids[self.used] = end  # one place is kept free for it
            begin, size = np.insert(begin, first[1:], self.used), np.insert(size, first[1:], 1)
            first = first + np.arange(texts + 1)
        ends = np.cumsum(size)
        flat = np.repeat(begin - ends + size, size)
        flat += np.arange(len(flat))
        flat = self.ids[flat]
        total = np.concatenate([[0], ends])
        counts = total[first[1:]] - total[first[:-1]]
        if whole:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i, t in whole.items():
                parts[i] = np.array(self._library([t.decode("utf-8", "replace")])[0] + ([] if end is None else [end]), dtype=np.uint32)
                counts[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat.astype("<u4", copy=False), counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool, share: float = 1.0) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, spaced) not in _encoders:
        _encoders.clear()
        _encoders[path, spaced] = Encoder(path, spaced, share)
    return _encoders[path, spaced]
