"""Quality rules: a linear-chain conditional random field labels the lines.

Each line is content or boilerplate.  Emission scores are linear in a dozen line
features, transitions join neighbouring lines, Viterbi decoding finds the best
labelling, and the share of words in content lines decides whether a document is
kept.  The field is fitted here by gradient ascent on its log-likelihood, over a
bounded sample: max_fit_docs documents, of each max_fit_chains chains of FIT_LINES lines,
spread over it.  Only the figures of these lines come to the driver, no text.  Lines of
documents labelled good are content; in the others, lines that a plain rule finds noisy
are boilerplate.

Base figures: words [^\\x20\\x09-\\x0D]+, their code points, symbols, lines equal to
an earlier line, and words in 8-word windows found twice or more.

Cases: a null or empty text has no words or lines, fails the base and is not kept;
repeated rows are judged each for themselves; ties in Viterbi go to content; texts
are read whole, however long; without labels the plain rule alone teaches the field, and
without any documents the weights stay at their prior; columns other than the id, the
text and the label are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _core

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 20, 30
MAX_FIT_DOCS = 600
FIT_LINES, MAX_FIT_CHAINS = 64, 4
MIN_CONTENT = 0.4
FEATURES = ("bias", "symbol words", "symbols in bytes", "digits in bytes", "repeated line", "repeated words", "few words", "no lower case", "closed by a mark", "bars", "long words", "same as last word")
CONTENT, BOILERPLATE = 0, 1

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_LOW = np.zeros(256, dtype=bool)
_LOW[0x61:0x7B] = True
_LOW[0x80:] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".!?:;\"')")] = True
_NOT_COUNTED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


class Page:
    """The figures of a slice of texts: base counts of each, and the features of their lines."""

    def __init__(self, texts: list):
        texts = [t or b"" for t in texts]
        w = _core.Words(texts, _core.SOLID)
        self.n_words, owner = w.counts, w.owner()
        self.word_chars = [len(t.translate(None, _NOT_COUNTED)) for t in texts]
        self.n_symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
        self.repeated = self._repeated(w, owner)
        self.n_repeat_words = np.bincount(owner, self.repeated, len(texts)).astype(np.int64)

        ends = np.append(np.flatnonzero(w.data == 10), len(w.data)) if texts else np.empty(0, dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        first = np.searchsorted(w.starts, starts)
        words = np.diff(np.append(first, len(w.starts)))
        real = words > 0
        starts, ends, first, words = starts[real], ends[real], first[real], words[real]
        self.doc = np.searchsorted(w.offsets, starts, "right") - 1
        self.words = words
        earlier = np.zeros(len(starts), dtype=bool)
        line = _core.hash_runs(w.data, starts, ends)
        order = np.lexsort((line, self.doc))
        earlier[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        self.n_dup_lines = np.bincount(self.doc, earlier, len(texts)).astype(np.int64)
        size = np.maximum(ends - starts, 1)
        noisy = _sums(_SYMBOL[w.data], w.starts, w.ends) > 0
        last = first + words
        same = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])]) if len(w.hash) else np.empty(0, dtype=bool)
        closing = _MARK[w.data[w.ends[last - 1] - 1]] if len(starts) else np.empty(0, dtype=bool)
        share = lambda flags: _sums(flags, first, last) / words
        self.features = np.column_stack([
            np.ones(len(starts)),
            share(noisy),
            np.minimum(1, 4 * _sums(_SYMBOL[w.data], starts, ends) / size),
            np.minimum(1, 2 * _sums(_DIGIT[w.data], starts, ends) / size),
            earlier,
            share(self.repeated),
            words < 4,
            _sums(_LOW[w.data], starts, ends) * 2 < size,
            closing,
            np.minimum(1, 3 * _sums(w.data == 0x7C, starts, ends) / words),
            np.minimum(1, np.maximum(0, size / words - 12) / 12),
            share(same),
        ])

    @staticmethod
    def _repeated(w: _core.Words, owner: np.ndarray) -> np.ndarray:
        out = np.zeros(len(w.starts) + 1, dtype=np.int64)
        n = len(w.starts) - WINDOW + 1
        if n > 0:
            key = np.zeros(n, dtype=np.uint64)
            for k in range(WINDOW):
                key = _core.mix(key + w.hash[k : k + n])
            own = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
            key = _core.mix(key[own] ^ (owner[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            order = np.argsort(key, kind="stable")
            held = key[order]
            equal = held[1:] == held[:-1]
            twice = np.zeros(len(own), dtype=bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            at = own[twice]
            out[at] += 1
            np.add.at(out, at + WINDOW, -1)
        return np.cumsum(out[:-1]) > 0

    def noisy_lines(self) -> np.ndarray:
        """The plain rule that teaches where no label does."""
        x = self.features
        return (x[:, 1] > 0.25) | (x[:, 4] > 0) | (x[:, 5] > 0.5) | (x[:, 9] > 0.6)


class Chain:
    """A linear-chain conditional random field with two states."""

    def __init__(self):
        self.weights = np.zeros((len(FEATURES), 2))
        self.weights[0, CONTENT] = 1.0
        self.weights[[1, 5], BOILERPLATE] = 4.0
        self.step = np.array([[0.5, 0.0], [0.0, 0.5]])

    @staticmethod
    def _padded(doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines by document and place, and which places are real."""
        ids, count = np.unique(doc, return_counts=True)
        place = _core.runs(count)
        out = np.zeros((len(ids), int(count.max()), rows.shape[1]))
        there = np.zeros(out.shape[:2], dtype=bool)
        line = np.repeat(np.arange(len(ids)), count)
        out[line, place] = rows
        there[line, place] = True
        return out, there

    def fit(self, doc: np.ndarray, features: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Gradient ascent on the mean log-likelihood of the lines' labels."""
        if not len(doc):
            return
        x, there = self._padded(doc, np.column_stack([features, labels]))
        y, x = x[:, :, -1].astype(int), x[:, :, :-1]
        n, length = there.shape
        total = there.sum()
        truth = np.zeros((n, length, 2))
        truth[np.arange(n)[:, None], np.arange(length), y] = 1
        truth *= there[:, :, None]
        both = there[:, 1:] & there[:, :-1]
        seen = np.einsum("nti,ntj->ij", truth[:, :-1] * both[:, :, None], truth[:, 1:])
        speed = [np.zeros_like(self.weights), np.zeros_like(self.step)]
        for _ in range(rounds):
            e = x @ self.weights * there[:, :, None]
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0]
            for t in range(1, length):
                new = np.logaddexp(forward[:, t - 1, 0, None] + self.step[0], forward[:, t - 1, 1, None] + self.step[1]) + e[:, t]
                forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
            z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            for t in range(length - 2, -1, -1):
                ahead = e[:, t + 1] + backward[:, t + 1]
                new = np.logaddexp(self.step[:, 0] + ahead[:, 0, None], self.step[:, 1] + ahead[:, 1, None])
                backward[:, t] = np.where(there[:, t + 1, None], new, 0)
            p = np.exp(forward + backward - z[:, None, None]) * there[:, :, None]
            pair = np.exp(forward[:, :-1, :, None] + self.step + (e + backward)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            for s, g, v in zip(speed, (np.einsum("ntf,nts->fs", x, truth - p) / total, (seen - pair.sum((0, 1))) / total), (self.weights, self.step)):
                s *= 0.9
                s += rate * (g - decay * v)
                v += s

    def decode(self, doc: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Viterbi: the best state of each line. Documents of like length go together."""
        out = np.zeros(len(doc), dtype=np.int64)
        if not len(doc):
            return out
        score = features @ self.weights
        ids, begin, count = np.unique(doc, return_index=True, return_counts=True)
        scale = np.ceil(np.log2(count)).astype(int)
        for size in np.unique(scale):
            some = np.flatnonzero(scale == size)
            b, c = begin[some], count[some]
            length = int(c.max())
            best, back = score[b], np.zeros((length, len(some), 2), dtype=np.int8)
            for t in range(1, length):
                on = t < c
                way = best[:, :, None] + self.step
                back[t] = way[:, BOILERPLATE] > way[:, CONTENT]
                new = way.max(1) + score[np.minimum(b + t, len(score) - 1)]
                best = np.where(on[:, None], new, best)
            state = (best[:, BOILERPLATE] > best[:, CONTENT]).astype(np.int64)
            for t in range(length - 1, -1, -1):
                on = t < c
                out[(b + t)[on]] = state[on]
                state = np.where(on, back[t, np.arange(len(some)), state], state)
        return out


CHAINS = "i long, h long, chain long, n long, features binary, noisy binary"


def _chains(docs: DataFrame, id_col: str, text_col: str, max_fit_chains: int) -> DataFrame:
    """The figures of the lines of docs, in chains of FIT_LINES at most, max_fit_chains of a document."""

    def make():
        def work(cols, texts):
            page = Page(texts)
            noisy, out = page.noisy_lines(), {k: [] for k in ("i", "h", "chain", "n", "features", "noisy")}
            first = np.searchsorted(page.doc, np.arange(len(texts) + 1))
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                begins = list(range(a, b, FIT_LINES))
                some = begins if len(begins) <= max_fit_chains else [begins[j * len(begins) // max_fit_chains] for j in range(max_fit_chains)]
                for at in some:
                    z = min(at + FIT_LINES, b)
                    for name, v in (("i", cols[0][k]), ("h", cols[1][k]), ("chain", at - a), ("n", z - at), ("features", page.features[at:z].tobytes()), ("noisy", noisy[at:z].tobytes())):
                        out[name].append(v)
            return out

        return work

    return _core.map_texts(docs.withColumn("h", F.xxhash64(text_col)), make, CHAINS, (id_col, "h"), text_col)


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", max_fit_docs: int = MAX_FIT_DOCS, max_fit_chains: int = MAX_FIT_CHAINS) -> Chain:
    """A chain fitted on max_fit_docs documents at most: those of least hashed id,
    labelled ones where labels are given."""
    plain = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    ids = plain.select("i")
    if labels is not None:
        ids = ids.join(labels.filter("quality is not null").select(F.col(f"`{id_col}`").alias("i"), "quality"), "i")
    else:
        ids = ids.withColumn("quality", F.lit(-1))
    ids = ids.filter("i is not null").orderBy(F.xxhash64("i"), "i", "quality").limit(max_fit_docs).collect()
    chain, quality = Chain(), {r.i: r.quality for r in ids}
    if quality:
        # repeated ids: the texts of least hash, so that the number of documents stays bounded
        some = plain.filter(F.col("i").isin(list(quality))).orderBy("i", F.xxhash64("t")).limit(max_fit_docs)
        rows = sorted(_chains(some, "i", "t", max_fit_chains).collect(), key=lambda r: (r.i, r.h, r.chain))
        if rows:
            features = np.concatenate([np.frombuffer(r.features).reshape(r.n, -1) for r in rows])
            noisy = np.concatenate([np.frombuffer(r.noisy, dtype=bool) for r in rows])
            given = np.repeat([quality[r.i] for r in rows], [r.n for r in rows])
            chain.fit(np.repeat(np.arange(len(rows)), [r.n for r in rows]), features, np.where((given != 1) & noisy, BOILERPLATE, CONTENT))
    return chain


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """Per document the base figures, the share of words in content lines, and the verdict."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        def work(cols, texts):
            p = Page(texts)
            state = held.value.decode(p.doc, p.features)
            content = np.bincount(p.doc, p.words * (state == CONTENT), len(texts))
            share = content / np.maximum(p.n_words, 1)
            failed = (p.n_words < MIN_WORDS) | (100 * p.n_repeat_words > MAX_REPEAT * p.n_words)
            return {
                "doc_id": cols[0], "n_words": p.n_words, "word_chars": p.word_chars, "n_symbols": p.n_symbols, "n_dup_lines": p.n_dup_lines,
                "n_repeat_words": p.n_repeat_words, "base_failed": failed, "kept": ~failed & (share >= min_content), "content_share": share,
            }

        return work

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return _core.map_texts(docs, make, ddl, (id_col,), text_col)


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    docs = _core.read_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, _core.read_table(spark, sf_dir, "labels")))
