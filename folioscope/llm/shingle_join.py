"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct five-word shingles; two documents link when
100 * |A & B| >= 80 * |A | B|.  Equal sets form one class; links are sought between
classes.

Frequency levels: every shingle is counted over all documents, and a table of fixed
size (two bits for each of 2**SLOT_BITS slots of the hash) tells its level: once,
rare, frequent, very frequent.  A slot takes the highest level that falls into it,
which can only cost time.

Signatures: shingles are ordered by level and hash.  A prefix is extended until it
can lose no link: a set of n shingles may miss floor(n/5) of them, so a prefix whose
signatures can only all be missed by floor(n/5)+1 absent shingles is enough.  Rare
shingles are signatures by themselves.  Frequent ones are signed in combinations of
two, very frequent ones of three, within parts given by their hash; of the m prefix
shingles of a part, all but one (two) must be absent before no combination is left.
The number of parts follows from the size band of the set, and a set is signed for
its own band and the next, as a partner is at most 5/4 as large.

Candidates: classes that share a signature.  Two sets that share a rare shingle meet
by it; where two meet by a combination, their shingles in common may thus be taken
to be no more than the lesser count of shingles that are not rare, and pairs whose
sizes ask for more are left out.  (Texts of one template, each with a few words of
its own, are no pairs by this.)  A signature of less than GROUP classes gives all
pairs that are left.  A larger one is parted so that all such pairs lie within a
part; there, each class is first paired with the least class and its neighbour;
after components are known, classes of one part that still lie apart meet in blocks
(settle), so no link is lost.  Parity bitmaps, whose distance never exceeds the
symmetric difference, discard most pairs; exact intersection of the sets decides
the rest.

Words are [^\\x20\\x09-\\x0D]+ after A-Z are lowered, taken by 64-bit hashes.

Cases: null, empty or wordless texts have an empty set and link with nothing; fewer
than five words are one shingle; repeated rows share a class; a null id takes part
but is never a component's name (null if a component has no other); long texts are
taken whole; ties in level go by the hash; columns other than the id and the text are
not read by join(), and pass through keep_first() whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _core, frequency
from .components import FOREST_NODES, components
from .frequency import bucket_bits, dealt

WIDTH = 5
SLOT_BITS = 25
RARE, FREQUENT = 32, 1024  # documents from which a shingle is frequent, very frequent
GROUP = 32
BLOCK = 512  # classes of a cluster that meet as many others in one task
SMALL = 16  # bands below this size sign single shingles only
FLUSH_SIGNS = 1 << 19

_EDGES = [-(-(Fraction(5, 4) ** j).numerator // (Fraction(5, 4) ** j).denominator) for j in range(120)]
_U = np.uint64


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes."""
    w = _core.Words(texts, _core.SOLID, lower=True)
    n = len(w.hash)
    key = np.zeros(n, dtype=np.uint64)
    if n >= WIDTH:
        key = np.zeros(n - WIDTH + 1, dtype=np.uint64)
        for k in range(WIDTH):
            key = _core.mix(key + w.hash[k : n - WIDTH + 1 + k])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(key[a : b - WIDTH + 1]))
        elif b > a:
            h = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                h = _core.mix(h * _U(3) + w.hash[k])
            out.append(h)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A name of the set itself, as a signed 64-bit number."""
    return int(_core.mix(np.add.reduce(_core.mix(s ^ _U(0xA5A5A5A55A5A5A5A)), dtype=np.uint64, keepdims=True) + _U(len(s)))[0].astype(np.int64))


def band(n: int) -> int:
    """The greatest j with (5/4)**j <= n."""
    return bisect_right(_EDGES, n) - 1


def parts_of(j: int) -> int:
    """Parts in band j, or 0 if it signs single shingles only."""
    return 0 if _EDGES[j] < SMALL else max(1, (_EDGES[j] // 5 + 1) // 4)


def signatures(s: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a sorted set, given each shingle's level, and with each how many
    shingles at most two sets have in common that meet by it first."""
    need = len(s) // 5 + 1
    ordered = s[np.argsort(level, kind="stable")]
    rare = int((level <= 1).sum())
    if rare >= need:
        single = np.unique(_core.mix(ordered[:need] ^ _U(1)))
        return single, np.full(len(single), len(s), dtype=np.uint32)
    single, out = np.unique(_core.mix(ordered[:rare] ^ _U(1))), []
    for j in (band(len(s)), band(len(s)) + 1):
        parts = parts_of(j)
        if not parts:
            out.append(_core.mix(ordered[rare:need] ^ _U(1)))
            continue
        left = need - rare
        for k, own in ((2, s[level == 2]), (3, s[level == 3])):
            if left <= 0 or not len(own):
                continue
            part = (_core.mix(own) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            nth = np.empty(len(own), dtype=np.int64)
            nth[order] = _core.runs(np.unique(part, return_counts=True)[1])
            gain = np.cumsum(nth >= k - 1)
            take = min(len(own), int(np.searchsorted(gain, left)) + 1)
            left -= int(gain[take - 1])
            found = []
            for p in np.unique(part[:take]):
                for c in itertools.combinations(own[:take][part[:take] == p], k):
                    found.append(c)
            if found:
                h = np.full(len(found), 64 * j + k, dtype=np.uint64)
                for column in np.array(found, dtype=np.uint64).T:
                    h = _core.mix(h * _U(5) + column)
                out.append(h)
    out = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *out]))
    return np.concatenate([single, out]), np.repeat(np.array([len(s), len(s) - rare], dtype=np.uint32), [len(single), len(out)])


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of at least two bits a shingle, each set if an odd number fall on it."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def may_link(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
    """Whether the bitmaps of sets of n and m shingles leave a link possible."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= n + m  # |A ^ B| <= (|A| + |B|) / 9


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= 80 * (len(x) + len(y) - both)


MEMBERS = "doc_id long, n_shingles long, class long"
MESSAGES = "bucket int, kind int, a long, b long, x binary, y binary, z binary"
SIGNED, PROFILE, PAIR, GROUPED = 0, 1, 2, 3


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))


def members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def make():
        def work(cols, texts):
            sets = shingle_sets(texts)
            return {"doc_id": cols[0], "n_shingles": [len(s) for s in sets], "class": [class_of(s) for s in sets]}

        return work

    return _core.map_texts(docs, make, MEMBERS, (id_col,), text_col)


def sign(plain: DataFrame, table: np.ndarray, bits: int, slot_bits: int) -> DataFrame:
    """Messages to buckets: (signature, class, size), and each class's bitmap."""
    schema, held = _core.arrow_schema(MESSAGES), plain.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        seen, rows, found = set(), [], []

        def flush():
            signs = np.concatenate([f[0] for f in found]) if found else np.empty(0, dtype=np.uint64)
            size = [len(f[0]) for f in found]
            names = np.repeat(np.array([f[1] for f in found], dtype=np.int64), size)
            n = np.repeat(np.array([f[2] for f in found], dtype=np.uint32), size)
            rare = n - np.concatenate([np.empty(0, dtype=np.uint32), *(f[3] for f in found)])
            order = np.argsort(signs, kind="stable")
            signs, names, n, rare = (x[order] for x in (signs, names, n, rare))
            out = rows + [(k, SIGNED, 0, 0, signs[a:b].tobytes(), names[a:b].tobytes(), np.stack([n[a:b], rare[a:b]]).tobytes()) for k, a, b in dealt(signs, bits)]
            rows.clear()
            found.clear()
            return _batch(out, schema)

        total = 0
        for batch in batches:
            for part in _core.slices(batch, "t"):
                for s in shingle_sets(part.column(1).to_pylist()):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        signs, most = signatures(s, frequency.level_of(held.value, slot_bits, s))
                        found.append((signs, c, len(s), most))
                        rows.append((c % (1 << bits), PROFILE, c, len(s), parity(s).tobytes(), None, None))
                        total += len(found[-1][0])
                if total > FLUSH_SIGNS:
                    yield flush()
                    total = 0
        yield flush()

    return plain.mapInArrow(_core.tidy(run), MESSAGES)


def _near(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sizes allow a link."""
    return 100 * np.minimum(n, m).astype(np.int64) >= 80 * np.maximum(n, m)


def _fit(n: np.ndarray, f: np.ndarray, m: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles of which min(f, g) at most are shared may link."""
    return 9 * np.minimum(f, g) >= 4 * (n + m)


def parted(n: np.ndarray, f: np.ndarray) -> np.ndarray:
    """A number for each set of a group, -1 for those that fit with none: sets that fit with
    one another get the same number.

    With c = (9f - 4n) // 4, two sets fit if each has n no greater than the other's c.  For two
    with n <= c that is to say that the ranges n..c meet; a set with c < n fits only with
    such whose range covers c..n, and two of them never fit."""
    c, out = (9 * f - 4 * n) // 4, np.full(len(n), -1, dtype=np.int64)
    wide = np.flatnonzero(c >= n)
    if not len(wide):
        return out
    order = wide[np.argsort(n[wide], kind="stable")]
    reach = np.maximum.accumulate(c[order])
    new = np.concatenate([[True], n[order][1:] > reach[:-1]])
    out[order] = np.cumsum(new) - 1
    low, high = n[order][new], reach[np.append(np.flatnonzero(new)[1:], len(order)) - 1]
    rest = np.flatnonzero(c < n)
    at = np.searchsorted(low, c[rest], "right") - 1
    inside = (at >= 0) & (n[rest] <= high[np.maximum(at, 0)])
    out[rest[inside]] = at[inside]
    return out


def candidates(signed: DataFrame, bits: int) -> DataFrame:
    """Pairs of classes that share a signature, larger groups whole, and the bitmaps."""
    schema = _core.arrow_schema(MESSAGES)

    def run(data: pa.Table) -> pa.Table:
        bucket = data.column("bucket")[0].as_py()
        kind = np.asarray(data.column("kind").to_numpy())
        own = data.filter(pa.array(kind == SIGNED))
        signs, names = (np.concatenate([np.empty(0, dtype=k)] + [np.frombuffer(x, dtype=k) for x in own.column(c).to_pylist()]) for c, k in (("x", np.uint64), ("y", np.int64)))
        n, f = np.concatenate([np.empty((2, 0), dtype=np.int64)] + [np.frombuffer(x, dtype=np.uint32).reshape(2, -1).astype(np.int64) for x in own.column("z").to_pylist()], axis=1)
        f = n - f
        order = np.lexsort((names, signs))
        order = order[np.concatenate([[True], (signs[order][1:] != signs[order][:-1]) | (names[order][1:] != names[order][:-1])])] if len(order) else order
        signs, names, n, f = (x[order] for x in (signs, names, n, f))
        begin = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]])) if len(signs) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(begin, len(signs)))
        left, right, groups = [], [], {}
        for k in np.unique(size[(size > 1) & (size < GROUP)]).tolist():
            at = begin[size == k]
            i, j = np.triu_indices(k, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
        for b, k in zip(begin[size >= GROUP].tolist(), size[size >= GROUP].tolist()):
            part = parted(n[b : b + k], f[b : b + k])
            order = np.argsort(part, kind="stable")  # within a part by class
            edges = np.searchsorted(part[order], np.arange(part.max() + 2))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                some = b + order[a:z]
                if len(some) > 1:
                    left += [np.full(len(some) - 1, some[0]), some[:-1]]
                    right += [some[1:], some[1:]]
                if len(some) > 2:
                    groups.setdefault(names[some].tobytes())  # a group of the same classes once
        left, right = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (left, right))
        fits = _fit(n[left], f[left], n[right], f[right])
        pairs = np.unique(np.stack([names[left[fits]], names[right[fits]]], axis=1), axis=0) if fits.any() else np.empty((0, 2), dtype=np.int64)
        out = [_batch([(bucket, GROUPED, 0, 0, x, None, None) for x in groups], schema)]
        none = pa.nulls(len(pairs), pa.binary())
        out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), bucket), type=pa.int32()), pa.array(np.full(len(pairs), PAIR), type=pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none], schema=schema))
        profiles = data.filter(pa.array(kind == PROFILE)).cast(schema)
        return pa.Table.from_batches(out + profiles.to_batches(), schema=schema)

    return signed.groupBy("bucket").applyInArrow(_core.tidy_group(run), MESSAGES)


def both_sides(pairs: DataFrame, table: DataFrame, decide) -> DataFrame:
    """Pairs (a, b) that decide(n, x, m, y) holds for, with (c, n, x) of each from table."""
    schema = _core.arrow_schema("a long, b long")
    joined = pairs.join(table.select(F.col("c").alias("a"), "n", "x"), "a").join(table.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("x").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = [(a, b) for a, n, x, b, m, y in zip(*(batch.column(i).to_pylist() for i in range(6))) if decide(n, x, m, y)]
            if keep:
                yield _batch(keep, schema)

    return joined.select("a", "n", "x", "b", "m", "y").mapInArrow(_core.tidy(run), "a long, b long")


def _bitmaps_meet(n, x, m, y) -> bool:
    return may_link(n, np.frombuffer(x, dtype=np.uint8), m, np.frombuffer(y, dtype=np.uint8))


def _sets_meet(n, x, m, y) -> bool:
    return linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))


def sets_of(plain: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, n, x): the sets of the classes in column c of `classes`, and a few others; written."""
    held = plain.sparkSession.sparkContext.broadcast(frequency.held_bits(classes, "c"))
    schema = _core.arrow_schema("c long, n long, x binary")

    def run(batches):
        seen = set()
        for batch in batches:
            for part in _core.slices(batch, "t"):
                sets = [s for s in shingle_sets(part.column(1).to_pylist()) if len(s)]
                names = np.array([class_of(s) for s in sets], dtype=np.int64)
                rows = []
                for k in np.flatnonzero(frequency.has_bit(held.value, names)).tolist():
                    if (c := int(names[k])) not in seen:
                        seen.add(c)
                        rows.append((c, len(sets[k]), sets[k].tobytes()))
                if rows:
                    yield _batch(rows, schema)

    return _core.materialise(plain.mapInArrow(_core.tidy(run), "c long, n long, x binary").groupBy("c", "n").agg(F.first("x").alias("x")), "sets")


def verify(pairs: DataFrame, profiles: DataFrame, plain: DataFrame) -> DataFrame:
    """The pairs that link, written."""
    some = _core.materialise(both_sides(pairs, profiles, _bitmaps_meet), "pairs")
    sets = sets_of(plain, some.select(F.col("a").alias("c")).union(some.select("b")))
    links = _core.materialise(both_sides(some, sets, _sets_meet), "links")
    _core.discard(some, sets)
    return links


class _Bitmaps:
    """Bitmaps of several sizes, compared with one at a time."""

    def __init__(self, maps: list[bytes], n: np.ndarray):
        size = np.array([len(x) for x in maps])
        self.n, self.by_size = n, {int(k): np.flatnonzero(size == k) for k in np.unique(size)}
        self.held = {(k, k): np.stack([np.frombuffer(maps[i], dtype=np.uint64) for i in at]) for k, at in self.by_size.items()}

    def near(self, n: int, x: np.ndarray) -> np.ndarray:
        """Places whose sizes and bitmaps allow a link with (n, x), nearest first."""
        found, gaps = [], []
        for k, at in self.by_size.items():
            to = min(k, 8 * len(x))
            if (k, to) not in self.held:
                self.held[k, to] = np.bitwise_xor.reduce(self.held[k, k].reshape(len(at), -1, to // 8), axis=1)
            y = np.bitwise_xor.reduce(x.reshape(-1, to // 8), axis=0)
            fits = np.flatnonzero(_near(self.n[at], np.int64(n)))
            gap = np.bitwise_count(self.held[k, to][fits] ^ y).sum(1, dtype=np.int64)
            good = 9 * gap <= self.n[at[fits]] + n
            found.append(at[fits[good]])
            gaps.append(gap[good])
        found, gaps = np.concatenate(found), np.concatenate(gaps)
        return found[np.argsort(gaps, kind="stable")]


MEETING = "w long, i int, j int, side int, c long, n long, x binary, s binary, l long"


def _meet(table: pa.Table) -> pa.Table:
    """The classes of side 1 against those of side 0: links that join components, once each."""
    side = table.column("side").to_numpy()
    (c, n, x, s, l), (c1, n1, x1, s1, l1) = ([part.column(k).to_pylist() for k in ("c", "n", "x", "s", "l")] for part in (table.filter(pa.array(side == k)) for k in (0, 1)))
    out, parent = [], {}

    def root(v: int) -> int:
        while (p := parent.get(v, v)) != v:
            v = p
        return v

    if c and c1:
        maps, label = _Bitmaps(x, np.array(n, dtype=np.int64)), np.array(l)
        for ci, ni, xi, si, li in zip(c1, n1, x1, s1, l1):
            mine = np.frombuffer(si, dtype=np.uint64)
            near = maps.near(ni, np.frombuffer(xi, dtype=np.uint64))
            for k in near[label[near] != li].tolist():
                a, b = root(li), root(l[k])
                if a != b and linked(mine, np.frombuffer(s[k], dtype=np.uint64)):
                    parent[max(a, b)] = min(a, b)
                    out.append((ci, c[k]))
    return pa.table([pa.array([r[i] for r in out], type=pa.int64()) for i in (0, 1)], names=["a", "b"])


TREES = "first long, x binary"


def _trees(batches):
    """Groups that share classes taken together, as far as a task sees: one row a tree, its least class and all."""
    schema, of, trees = pa.schema([("first", pa.int64()), ("x", pa.binary())]), {}, {}

    def flush():
        rows = [(int(c.min()), c.tobytes()) for c in (np.array(tree, dtype=np.int64) for tree in trees.values())]
        of.clear()
        trees.clear()
        return _batch(rows, schema)

    for batch in batches:
        for x in batch.column(0).to_pylist():
            c = np.frombuffer(x, dtype=np.int64).tolist()
            met = set(map(of.get, c))
            if len(met) > 1 or None in met:
                met.discard(None)
                root = max(met, key=lambda r: len(trees[r]), default=c[0])
                new = [v for v in c if v not in of]
                for r in met - {root}:  # smaller trees go to the largest
                    new += trees.pop(r)
                of.update(zip(new, itertools.repeat(root)))
                trees.setdefault(root, []).extend(new)
                if len(of) > FOREST_NODES:
                    yield flush()
    yield flush()


def _stars(batches):
    """(first class, class) of trees in order of their first class, each pair once."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for first, own in itertools.groupby(rows, lambda row: row[0]):
        held = np.empty(0, dtype=np.int64)
        for _, x in own:
            held = np.union1d(held, np.frombuffer(x, dtype=np.int64))
        held = held[held != first]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), first, dtype=np.int64)), pa.array(held)], names=["a", "b"])


def gathered(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes by which all classes of a group, and of groups that share one, are
    connected.  A task gives one row a tree whatever its size.  Trees of one cluster mostly
    have the same least class and meet by it, so there are about as many pairs as classes."""
    trees = groups.select("x").mapInArrow(_core.tidy(_trees), TREES).repartition("first").sortWithinPartitions("first")
    return trees.mapInArrow(_core.tidy(_stars), "a long, b long")


def settle(groups: DataFrame, labels: DataFrame, profiles: DataFrame, plain: DataFrame) -> DataFrame | None:
    """Links still missing between classes of larger groups, None if there can be none.

    Only groups that hold several components matter: their components are taken together, as
    a cluster, so no pair meets twice.  Of a cluster, the classes outside its largest
    component meet all its classes, in blocks of BLOCK by BLOCK; of what meets, only links
    that join components are given out."""
    stars = gathered(groups)
    named = labels.select("node", F.col("label").alias("l"))
    for end in ("a", "b"):
        stars = stars.join(named.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("l", end)).drop("l")
    apart = _core.materialise(stars.filter("a != b").distinct(), "apart")  # labels whose classes share a group
    if apart.isEmpty():
        _core.discard(apart)
        return None
    joined = components(apart)
    clusters = joined.select(F.col("node").alias("l"), F.col("label").alias("w"))
    alone = clusters.join(labels.select(F.col("node").alias("l")), "l", "left_anti").select(F.col("l").alias("c"), "w", "l")
    nodes = labels.select(F.col("node").alias("c"), F.col("label").alias("l")).join(clusters, "l").select("c", "w", "l").union(alone)
    own = _core.materialise(nodes.join(profiles, "c").select("w", "c", "n", "x", "l"), "clusters")
    _core.discard(apart, joined)
    sizes = own.groupBy("w", "l").agg(F.count("*").alias("k")).groupBy("w").agg(F.sum("k").alias("total"), F.max("k").alias("most"), F.max_by("l", F.struct("k", "l")).alias("main"))
    left = _core.materialise(own.join(sizes.filter("total > most"), "w"), "clusters")
    _core.discard(own)
    if left.isEmpty():
        _core.discard(left)
        return None
    sets = sets_of(plain, left.select("c"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = left.join(sets.select("c", F.col("x").alias("s")), "c").withColumn("of", blocks(F.col("total"))).withColumn("against", blocks(F.col("total") - F.col("most")))
    block = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = [x.split()[0] for x in MEETING.split(", ")]
    one = rows.withColumn("i", block("of")).withColumn("j", each("against")).withColumn("side", F.lit(0)).select(*names)
    other = rows.filter("l != main").withColumn("j", block("against")).withColumn("i", each("of")).withColumn("side", F.lit(1)).select(*names)
    links = _core.materialise(one.union(other).groupBy("w", "i", "j").applyInArrow(_core.tidy_group(_meet), "a long, b long"), "links")
    _core.discard(left, sets)
    return links


def _distinct_sets():
    """Of each task, the sets of the classes it has not met."""
    seen: set[int] = set()

    def hashes(texts: list) -> np.ndarray:
        new = [s for s in shingle_sets(texts) if len(s) and (c := class_of(s)) not in seen and not seen.add(c)]
        return np.concatenate([np.empty(0, dtype=np.uint64), *new])

    return hashes


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = SLOT_BITS) -> DataFrame:
    """Per document its class, the size of its set, its component by the links, and the class of
    the document the component is named after (`first`; one id may stand on several texts)."""
    bits = min(bucket_bits(docs.sparkSession), slot_bits - 4)
    plain = _texts(docs, id_col, text_col)
    own = _core.materialise(members(docs, id_col, text_col), "members")
    signed = sign(plain, frequency.levels(plain, _distinct_sets, (2, RARE, FREQUENT), bits, slot_bits), bits, slot_bits)
    found = _core.materialise(candidates(signed, bits), "candidates")
    profiles = found.filter(F.col("kind") == PROFILE).select(F.col("a").alias("c"), F.col("b").alias("n"), "x").dropDuplicates(["c"])
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    links = verify(pairs, profiles, plain)
    labels = components(links)
    groups = found.filter(F.col("kind") == GROUPED).select(F.xxhash64("x").alias("g"), "x").dropDuplicates(["g"])
    more = None if groups.isEmpty() else settle(groups, labels, profiles, plain)
    if more is not None:
        _core.discard(labels)
        labels = components(links.union(more))
        _core.discard(more)
    _core.discard(found, links)
    classes = own.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("m"))
    classes = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = F.min(F.when(F.col("m").isNotNull(), F.struct("m", F.col("class").alias("c"))))
    names = classes.groupBy("label").agg(least.alias("x")).select("label", F.col("x.m").alias("component_id"), F.col("x.c").alias("first"))
    named = classes.select("class", "label").join(names, "label").select("class", "component_id", "first")
    filled = own.filter("n_shingles > 0").join(named, "class").select("doc_id", "n_shingles", "component_id", "class", "first")
    return filled.union(own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "class", F.col("class").alias("first")))


def _classed(docs: DataFrame, id_col: str, text_col: str, name: str, bitmap: np.ndarray) -> DataFrame:
    """The rows of docs whose id may be in the bitmap, with the class of each text as column `name`."""
    out = docs.withColumn(name, F.lit(0).cast("long"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = _core.arrow_schema("x long")

    def run(batches):
        for batch in batches:
            for part in _core.slices(frequency.having_bit(batch, id_col, held.value), text_col):
                texts = part.column(part.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
                own = pa.array([class_of(s) for s in shingle_sets(texts)], type=schema.field(0).type)
                yield part.set_column(part.schema.get_field_index(name), name, own)

    return out.mapInArrow(_core.tidy(run), out.schema)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the least id; documents
    without words and those without an id stay.  A document is known by its id and class:
    of rows that repeat both, one stays, that of the least text; of several texts under one
    id each is judged by itself.  Only documents that may go, by a bitmap of the ids, are
    shuffled."""
    found = join(docs, id_col, text_col).filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    of, other, goes, nth = _core.new_names(docs, "id", "class", "goes", "nth")
    # the class as text: rows are dealt by both columns anew, not as the join before, by class
    found = found.withColumn("c", F.col("class").cast("string")).withColumn("goes", (F.col("component_id") < F.col("doc_id")) | (F.col("first") != F.col("class")))
    marks = found.groupBy("doc_id", "c").agg(F.max("goes").alias(goes), F.count("*").alias("n")).filter(f"{goes} or n > 1")
    gone = _core.materialise(marks.select(F.col("doc_id").alias(of), F.col("c").cast("long").alias(other), goes), "gone")
    bitmap = frequency.held_bits(gone, of)
    stay = frequency.without_bits(docs, id_col, bitmap)
    own = _core.new_names(docs, "own")[0]
    rest = _classed(docs, id_col, text_col, own, bitmap)
    rest = rest.join(gone, (F.col(f"`{id_col}`") == F.col(of)) & (F.col(own) == F.col(other)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = stay.unionByName(rest.filter(F.col(goes).isNull()).select(*columns))
    if gone.filter(~F.col(goes)).isEmpty():
        return out
    one = rest.filter(~F.col(goes)).withColumn(nth, F.row_number().over(Window.partitionBy(of, other).orderBy(F.col(f"`{text_col}`"))))
    return out.unionByName(one.filter(F.col(nth) == 1).select(*columns))


def op7_shingle_join(spark, sf_dir) -> DataFrame:
    return join(_core.read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
