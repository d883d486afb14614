import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import components as C
from folioscope.llm import shingle_join as S

from .conftest import lowered, words


def brute(rows):
    """Component names by comparing every pair of sets."""
    sets = []
    for i, text in rows:
        w = [x for x in lowered(text).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = collections.defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least[root(k)], 1 << 60 if i is None else i)
    return sorted((i is not None, i or 0, len(s), None if least[root(k)] == 1 << 60 else least[root(k)]) for k, (i, s) in enumerate(sets))


def found(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect())


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"]
    return out


def test_mixed_rows(make_docs, mixed_rows):
    assert found(S.join(make_docs(mixed_rows))) == brute(mixed_rows)


def test_large_group_of_near_copies(make_docs, monkeypatch):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(9)))) for i in range(150)]
    passage = [f"p{k}" for k in range(60)]
    rows += [(1000 + i, " ".join(words(rng, rng.randrange(2, 14)) + passage + words(rng, rng.randrange(2, 14)))) for i in range(100)]
    rows += [(2000 + i, " ".join(words(rng, rng.randrange(1, 12), 6))) for i in range(200)]
    want = brute(rows)
    docs = make_docs(rows)
    assert found(S.join(docs)) == want
    monkeypatch.setattr(S, "BLOCK", 16)  # many blocks to a cluster
    assert found(S.join(docs)) == want


def test_rows_of_a_large_group_of_near_copies(spark, make_docs, monkeypatch):
    """Over many tasks no stage in Python gives out rows by the square of the group, and no link is lost."""
    rng, made = random.Random(14), {}
    base = [f"b{k}" for k in range(120)]
    rows = [(k, " ".join(edited(rng, base, 1 + rng.randrange(8)))) for k in range(400)]
    plain = S._core.tidy

    def counting(run):
        n = made.setdefault(run.__qualname__, spark.sparkContext.accumulator(0))
        inner = plain(run)

        def counted(batches):
            for batch in inner(batches):
                n.add(batch.num_rows)
                yield batch

        return counted

    monkeypatch.setattr(S._core, "tidy", counting)
    new = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: spark.conf.get(key) for key in new}
    for key, value in new.items():
        spark.conf.set(key, value)
    try:
        assert found(S.join(make_docs(rows))) == brute(rows)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    counts = {name: n.value for name, n in made.items()}
    assert counts["_stars"] and max(counts.values()) <= 8 * len(rows), counts


@pytest.mark.parametrize("most", [8, 1 << 18])
def test_trees_connect_what_groups_do(monkeypatch, most):
    """However often a task gives out its trees."""
    monkeypatch.setattr(S, "FOREST_NODES", most)
    rng = random.Random(most)
    groups = [sorted(100 * k + v for v in rng.sample(range(30), rng.randrange(3, 9))) for k in range(20) for _ in range(6)]
    rng.shuffle(groups)
    batches = [pa.RecordBatch.from_arrays([pa.array([np.array(g, dtype=np.int64).tobytes() for g in groups[a : a + 7]])], names=["x"]) for a in range(0, len(groups), 7)]
    trees = sorted((t["first"], t["x"]) for b in S._trees(iter(batches)) for t in b.to_pylist())
    assert most == 8 or len({v for _, x in trees for v in np.frombuffer(x, dtype=np.int64).tolist()}) == sum(len(x) // 8 for _, x in trees)
    a, b = C.Forest(), C.Forest()
    for g in groups:
        for v in g:
            a.join(g[0], v)
    for rows in S._stars([pa.RecordBatch.from_arrays([pa.array([t[0] for t in trees]), pa.array([t[1] for t in trees])], names=["first", "x"])]):
        for x in rows.to_pylist():
            b.join(x["a"], x["b"])
    nodes = {v for g in groups for v in g}
    assert {v: a.root(v) for v in nodes} == {v: b.root(v) for v in nodes}


def test_empty_table_and_clashing_columns(make_docs):
    docs = make_docs([])
    assert S.join(docs).collect() == []
    assert S.keep_first(docs).columns == docs.columns


def test_keep_first(make_docs, mixed_rows):
    docs = make_docs(mixed_rows)
    kept = {r.doc_id for r in S.keep_first(docs).collect()}
    assert kept == {i for real, i, _, c in brute(mixed_rows) if real and (c is None or i <= c)} | {None}


def test_keep_first_with_repeated_ids(make_docs):
    """Of repeated rows one stays; of several texts under one id only copies go."""
    a, b, c, d = (" ".join(f"{k}{n}" for n in range(30)) for k in "abcd")
    rows = [(1, a), (1, a), (1, a.upper()), (3, b), (7, b), (7, c), (8, d), (8, d), (9, d), (5, None), (5, None), (None, c), (None, c), (1, b + " end")]
    kept = sorted(((r.doc_id or 0, r.text or "") for r in S.keep_first(make_docs(rows)).collect()))
    assert kept == sorted([(1, a.upper()), (1, b + " end"), (7, c), (8, d), (5, ""), (5, ""), (0, c), (0, c)])


def test_signatures_lose_no_link():
    """Sets at the threshold share a signature, whatever the levels."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        miss = int(rng.integers(0, len(x) // 5 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[miss:], rng.integers(0, 1 << 62, int(rng.integers(0, miss + 2)), dtype=np.uint64)]))
        if not len(y) or not S.linked(x, y):
            continue
        both = np.unique(np.concatenate([x, y]))
        level = dict(zip(both.tolist(), rng.integers(0, 4, len(both)).tolist()))
        (sx, fx), (sy, fy) = (S.signatures(s, np.array([level[v] for v in s.tolist()])) for s in (x, y))
        _, i, j = np.intersect1d(sx, sy, return_indices=True)
        assert S._fit(len(x), fx[i].astype(int), len(y), fy[j].astype(int)).any()
        assert S.may_link(len(x), S.parity(x), len(y), S.parity(y))


def test_parts_hold_all_pairs_that_fit():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = rng.integers(1, int(rng.integers(3, 120)), int(rng.integers(1, 60)))
        f = n - rng.integers(0, 1 + n // 3)
        part = S.parted(n, f)
        fits = S._fit(n[:, None], f[:, None], n, f)
        np.fill_diagonal(fits, False)
        a, b = np.nonzero(fits)
        assert (part[a] == part[b]).all() and (part[a] >= 0).all()


def thanks(rng, k, own=2):
    """A short text of one template with `own` words at its end that no other has."""
    return "thank you for your order we hope to see you again soon in one of our shops near you " + " ".join(f"o{k}x{j}{rng.randrange(10**6)}" for j in range(own))


def test_texts_of_one_template(spark, make_docs):
    """They share most shingles but do not link: no pairs come of it, however many there are."""
    rng = random.Random(9)
    rows = [(k, thanks(rng, k, rng.randrange(2, 6))) for k in range(120)] + [(200 + k, thanks(rng, 0, 0) + f" x{k % 4}") for k in range(40)]
    assert found(S.join(make_docs(rows))) == brute(rows)
    docs = make_docs([(k, thanks(rng, k, 3)) for k in range(3000)])
    plain, bits = S._texts(docs, "doc_id", "text"), S.bucket_bits(spark)
    table = S.frequency.levels(plain, S._distinct_sets, (2, S.RARE, S.FREQUENT), bits, 20)
    assert S.candidates(S.sign(plain, table, bits, 20), bits).filter(f"kind in ({S.PAIR}, {S.GROUPED})").count() == 0


def test_names_that_clash(spark, mixed_rows):
    """Columns named as those an operator adds stay as they are."""
    names = ["id", "class", "goes", "nth", "own", "Class", "goes_"]
    docs = spark.createDataFrame([(i, t, *["x"] * 7) for i, t, *_ in mixed_rows], "doc_id long, text string, " + ", ".join(f"`{c}{'2' if c == 'Class' else ''}` string" for c in names))
    out = S.keep_first(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for real, i, _, c in brute([r[:2] for r in mixed_rows]) if real and (c is None or i <= c)} | {None}
    assert all(set(r[2:]) == {"x"} for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(200)]
    links = [(a, b) for a, b in links if a != b]
    parent = {v: v for x in links for v in x}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent}
