"""The pipeline's stages on small tables, each against what its operator should leave."""

import random

import pytest

import corpus_pipeline
from folioscope.llm import line_dedup, shingle_join

from .conftest import words
from .test_operators import brute_hits, plain_runs, windows_of
from .test_shingle_join import brute, edited


@pytest.fixture(scope="module")
def tables(spark, make_docs, tmp_path_factory):
    rng = random.Random(12)
    text = lambda n: " ".join(words(rng, n, 4000))
    items = [(k, text(25)) for k in range(6)]
    rows = [(0, None), (1, ""), (2, "12 34 ..."), (3, items[0][1])]
    base = text(80).split()
    passage = [text(20) for _ in range(4)]
    for k in range(10, 50):
        rows.append((k, "\n".join(text(rng.randrange(8, 40)) for _ in range(3))))
    rows += [(60 + k, " ".join(edited(rng, base, rng.randrange(3)))) for k in range(10)]
    rows += [(80 + k, "\n".join([text(30), *passage, text(30)])) for k in range(6)]
    rows += [(100 + k, text(30) + " " + items[k][1] + " " + text(30)) for k in range(6)] + [rows[20][:0] + (200, rows[20][1])]
    d = str(tmp_path_factory.mktemp("tables"))
    make_docs(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_stages(spark, tables):
    d, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = f"{d}/stage-{name}"
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = before, docs.collect()
        if name != "pack":
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert {r.doc_id for r in after} == {i for i, _ in before} - {0, 1, 2}
    before, after = seen["line_dedup"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted((i, t) for i, t, c in plain_runs(before) if not c or t.split())
    before, after = seen["shingle_join"]
    assert {r.doc_id for r in after} == {i for _, i, _, c in brute(before) if i <= c}
    assert len(after) < len(before)
    before, after = seen["decontaminate"]
    found = windows_of(items)
    assert all(brute_hits(r.text, found)[1] == 0 for r in after)
    assert {(r.doc_id, r.text) for r in after} >= {(i, t) for i, t in before if brute_hits(t, found)[1] == 0}
    before, after = seen["pack"]
    assert {r.doc_id for r in after} == {i for i, _ in before}


def test_run_equals_its_stages(spark, tables):
    d, _ = tables
    a = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, d).collect()}
    b = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in spark.read.parquet(f"{d}/stage-pack").collect()}
    assert a and a == b


def test_text_in_no_language_goes(spark, make_docs):
    """The network's score decides: text of all languages' letters goes, clean documents stay."""
    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "ghijk", "dd": "lmnop"}
    word = lambda own: "".join(rng.choice(own) for _ in range(rng.randrange(2, 8)))
    rows = [(k, " ".join(word(letters[l]) for _ in range(rng.randrange(4, 60))), l) for k in range(320) for l in [rng.choice(list(letters))]]
    mixed = [(1000 + k, " ".join("".join(rng.choice("".join(letters.values())) for _ in range(6)) for _ in range(200)), None) for k in range(20)]
    docs = make_docs(rows + mixed)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept >= {r[0] for r in rows}
    assert sum(r[0] not in kept for r in mixed) >= 10


def test_line_dedup_counts_chunks(spark, make_docs, monkeypatch):
    """Every repeated content-defined chunk is sent to be judged, beside the runs that reach the edges."""
    rng = random.Random(31)
    passage = [" ".join(words(rng, 8, 4000)) for _ in range(12)]
    rows = [(k, "\n".join([" ".join(words(rng, 9, 4000)), *passage, " ".join(words(rng, 9, 4000))])) for k in range(2)]
    sent, make = set(), line_dedup._chunk_rows

    def rows_of(*args):
        out = make(*args)
        sent.update(r.key for r in out.filter(f"kind = {line_dedup.CHUNK}").select("key").collect())
        return out

    monkeypatch.setattr(line_dedup, "_chunk_rows", rows_of)
    left = {r.doc_id: r.text for r in corpus_pipeline.new_lines(spark, make_docs(rows), "").collect()}
    one, two = ({int(k) for keys, a, b in line_dedup.Lines([t.encode()]).chunks() for k in keys[b - a > 2].astype("int64")} for _, t in rows)
    assert one & two and sent >= one & two  # of more lines than any shortest run has here
    assert left == {0: rows[0][1], 1: "\n".join([rows[1][1].split("\n")[0], rows[1][1].split("\n")[-1]])}
    _, first, last = next(line_dedup.Lines([t.encode() for _, t in rows]).counted(True))
    assert len(set(zip(first.tolist(), last.tolist()))) == len(first)


def test_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_leave_one(make_docs):
    rng = random.Random(1)
    base = words(rng, 100, 5000)
    rows = [(k, " ".join(edited(rng, base, 1))) for k in range(20)] + [(99, " ".join(words(rng, 50, 5000)))]
    assert {r.doc_id for r in shingle_join.keep_first(make_docs(rows)).collect()} == {0, 99}
