"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one reading forward and one backward, run over the
bytes of a text; a softmax layer labels every position from both states, and a
document's probabilities pool the log-probabilities of its positions.  The
network is written in numpy and trained here by backpropagation through time.

Whole texts are read.  They are cut into rows of `span` bytes with fresh states at
each row's ends, so a text of any length takes bounded memory and many rows run
side by side.

Training: documents whose crc32(doc_id as text) mod 4 is not 2, with a text and a
language; at most `fit_docs` of each language, those of least hashed id, and of
each `fit_rows` rows of `span` bytes spread over the text.  The network's `least` is the
lowest score of a training document, by these rows, that gets its own label, and
MOST_LEAST at most: a lower score says that no language is likelier than all others
together, or than in any clean document.

Cases: a text that is null or has no letter (Unicode's category L) is `und` with score 0;
without training rows every text is; repeated rows get equal labels; ties go to the
language that sorts first; a text of any length is read whole, in rows; columns other
than the id, the text and, to learn, the language are not read, and pass through
keep_known() whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _core

HIDDEN = 8
SPAN = 64
FIT_DOCS = 150
FIT_ROWS = 8
FOLDS, HELD_OUT = 4, 2
MOST_LEAST = 0.5
COLUMNS = 2048  # rows of bytes that run side by side
_LETTER = regex.compile(r"\p{L}")


class Direction:
    """One gated recurrent layer; arrays are (units, rows)."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.p = {
            "table": rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32),  # input weights and bias of each byte
            "u": rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32),
            "b": np.zeros((hidden, 1), dtype=np.float32),
        }

    def forward(self, x: np.ndarray, out: np.ndarray, keep: list | None = None) -> None:
        """x: bytes (steps, rows); out: states (steps, units, rows). keep: what backward() needs."""
        h, (table, u, b) = self.h, (self.p[k] for k in ("table", "u", "b"))
        steps, n = x.shape
        state = np.zeros((h, n), dtype=np.float32)
        gi, gh, r = np.empty((3 * h, n), dtype=np.float32), np.empty((3 * h, n), dtype=np.float32), np.empty((h, n), dtype=np.float32)
        for t in range(steps):
            np.take(table, x[t], axis=1, out=gi, mode="clip")
            np.matmul(u, state, out=gh)
            gates = gi[: 2 * h]
            gates += gh[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)  # a logistic function by way of tanh
            gates += 1
            gates *= 0.5
            inner = gh[2 * h :]
            inner += b
            np.multiply(gates[:h], inner, out=r)
            new = gi[2 * h :]
            new += r
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((x[t], state.copy(), gates.copy(), inner.copy(), new.copy()))
            state -= new
            state *= gates[h:]
            state += new
            out[t] = state

    def backward(self, keep: list, grads: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters, through time; grads as out of forward()."""
        h, u = self.h, self.p["u"]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        flow = np.zeros_like(grads[0])
        for t in reversed(range(len(keep))):
            x, before, gates, inner, new = keep[t]
            flow = flow + grads[t]
            reset, update = gates[:h], gates[h:]
            dn = flow * (1 - update) * (1 - new * new)
            du = flow * (before - new) * update * (1 - update)
            dr = dn * inner * reset * (1 - reset)
            into = np.concatenate([dr, du, dn])
            onto = np.concatenate([dr, du, dn * reset])
            for k in range(3 * h):
                g["table"][k] += np.bincount(x, into[k], 256)
            g["u"] += onto @ before.T
            g["b"] += (dn * reset).sum(1, keepdims=True)
            flow = flow * update + u.T @ onto
        return g


class Network:
    """Both directions and the softmax over languages."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden, self.least = languages, hidden, 0.0
        self.ahead, self.back = Direction(hidden, rng), Direction(hidden, rng)
        self.out = {"w": rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32), "c": np.zeros((len(languages), 1), dtype=np.float32)}

    def states(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        steps, n = x.shape
        both = np.empty((steps, 2 * self.hidden, n), dtype=np.float32)
        self.ahead.forward(x, both[:, : self.hidden], keep and keep[0])
        self.back.forward(x[::-1], both[::-1, self.hidden :], keep and keep[1])
        return both

    def positions(self, both: np.ndarray) -> np.ndarray:
        """Log-probabilities (steps, languages, rows)."""
        z = np.matmul(self.out["w"], both)
        z += self.out["c"]
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return z

    def fit(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, steps: int = 160, batch: int = 192, rate: float = 0.02) -> None:
        """x, real: (rows, span) bytes and which are text; y: the language of each row."""
        rng = np.random.default_rng(11)
        parts = [self.ahead.p, self.back.p, self.out]
        first, second = ([{k: np.zeros_like(v) for k, v in p.items()} for p in parts] for _ in range(2))
        for step in range(1, steps + 1):
            some = rng.integers(0, len(x), batch)
            bytes_, there, want = np.ascontiguousarray(x[some].T), real[some].T, y[some]
            keep: tuple[list, list] = ([], [])
            both = self.states(bytes_, keep)
            wrong = np.exp(self.positions(both))
            wrong[:, want, np.arange(batch)] -= 1
            wrong *= there[:, None, :] / max(1, there.sum())
            into = np.matmul(self.out["w"].T, wrong)
            grads = [
                self.ahead.backward(keep[0], into[:, : self.hidden]),
                self.back.backward(keep[1], into[::-1, self.hidden :]),
                {"w": np.einsum("tcn,thn->ch", wrong, both), "c": wrong.sum((0, 2))[:, None]},
            ]
            size = np.sqrt(sum(float((g * g).sum()) for own in grads for g in own.values()))
            for p, g, a, b in zip(parts, grads, first, second):
                for k in p:
                    d = g[k] * min(1, 1 / (size + 1e-12))
                    a[k] = 0.9 * a[k] + 0.1 * d
                    b[k] = 0.99 * b[k] + 0.01 * d * d
                    p[k] -= rate * (1 - step / (steps + 1)) * (a[k] / (1 - 0.9**step)) / (np.sqrt(b[k] / (1 - 0.99**step)) + 1e-8)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled log-probabilities (texts, languages): means over all positions."""
        x, real, owner = cut(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(x), COLUMNS):
            z = self.positions(self.states(np.ascontiguousarray(x[a : a + COLUMNS].T)))
            z *= real[a : a + COLUMNS].T[:, None, :]
            for k, row in enumerate(z.sum(0)):
                total[:, k] += np.bincount(owner[a : a + COLUMNS], row, len(texts))
        return total / np.maximum([len(t) for t in texts], 1)[:, None]


def cut(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes as rows of `span`: the bytes, which of them are text, and each row's text."""
    rows = np.array([-(-len(t) // span) for t in texts], dtype=np.int64)
    x = np.frombuffer(b"".join(t.ljust(int(r) * span, b" ") for t, r in zip(texts, rows)), dtype=np.uint8).reshape(-1, span)
    owner = np.repeat(np.arange(len(texts)), rows)
    left = np.array([len(t) for t in texts], dtype=np.int64)[owner] - _core.runs(rows) * span
    return x, np.arange(span) < left[:, None], owner


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_rows: int = FIT_ROWS) -> Network | None:
    """The network, from a bounded sample: fit_docs texts of each language."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).cast("binary").alias("t"))
    rows = rows.filter((_core.crc_mod_column("i", FOLDS) != HELD_OUT) & F.col("l").isNotNull() & (F.length("t") > 0))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # a share of each language that is expected to hold twice what is needed, by the hash of the id
    share = F.coalesce(*[F.when(F.col("l") == l, F.lit(2 * fit_docs / n)) for l, n in sorted(counts.items())], F.lit(0.0))
    some = rows.withColumn("h", F.pmod(F.xxhash64("i"), F.lit(1 << 40))).filter(F.col("h") < share * (1 << 40))

    def make():
        def work(cols, texts):
            """Of each text fit_rows rows, spread over it."""
            x, real, owner = cut(texts)
            count = np.bincount(owner, minlength=len(texts))
            use = _core.runs(count) * fit_rows // np.maximum(count, fit_rows)[owner]
            use = np.concatenate([[True], (use[1:] != use[:-1]) | (owner[1:] != owner[:-1])]) | (count[owner] <= fit_rows)
            own = owner[use]
            return {"l": [cols[0][k] for k in own], "h": [cols[1][k] for k in own], "i": [cols[2][k] for k in own], "x": [r.tobytes() for r in x[use]], "n": real[use].sum(1)}

        return work

    found: dict[str, list] = {}
    bodies: dict[tuple, bytes] = {}
    for r in sorted(_core.map_texts(some, make, "l string, h long, i long, x binary, n long", ("l", "h", "i"), "t").collect(), key=lambda r: (r.h, r.i)):
        own = found.setdefault(r.l, [])
        if len(own) < fit_docs * fit_rows:
            own.append((np.frombuffer(r.x, dtype=np.uint8), np.arange(SPAN) < r.n))
            bodies[r.l, r.h, r.i] = bodies.get((r.l, r.h, r.i), b"") + r.x[: r.n]
    if not found:
        return None
    net = Network(sorted(found))
    x, real = ([np.array([r[k] for r in found[l]]) for l in net.languages] for k in (0, 1))
    y = [np.full(len(v), k) for k, v in enumerate(x)]
    per = max(len(v) for v in y)  # every language weighs the same
    at = [np.resize(np.arange(len(v)), per) for v in y]
    net.fit(np.concatenate([v[a] for v, a in zip(x, at)]), np.concatenate([v[a] for v, a in zip(real, at)]), np.concatenate([v[a] for v, a in zip(y, at)]))
    labels, scores = verdicts(net, list(bodies.values()))
    net.least = min([s for (own, *_), l, s in zip(bodies, labels, scores) if l == own] + [MOST_LEAST])
    return net


def verdicts(net: Network | None, texts: list) -> tuple[list[str], list[float]]:
    labels, scores = ["und"] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if t and net and _LETTER.search(t.decode("utf-8", "replace"))]
    if some:
        z = net.documents([texts[i] for i in some])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, k, row in zip(some, z.argmax(1).tolist(), p):
            labels[i], scores[i] = net.languages[k], float(row[k])
    return labels, scores


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        def work(cols, texts):
            labels, scores = verdicts(held.value, texts)
            return {"doc_id": cols[0], "held_out": _core.crc_mod(cols[0], FOLDS) == HELD_OUT, "lang_pred": labels, "score": scores}

        return work

    return _core.map_texts(docs, make, "doc_id long, held_out boolean, lang_pred string, score double", (id_col,), text_col)


def keep_known(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """docs without those that are `und` or score below `least`."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        def work(_, texts):
            labels, scores = verdicts(held.value, texts)
            return texts, [l != "und" and s >= least for l, s in zip(labels, scores)]

        return work

    return _core.rewrite_texts(docs, make, (), text_col)


def op6_language_id(spark, sf_dir) -> DataFrame:
    docs = _core.read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
