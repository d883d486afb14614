"""The registered text queries on the small tables: whole results, and equal to SQL where that is given."""

import os

import duckdb
import pytest

from folioscope.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "op1_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_line_dedup": "doc_id n_lines n_removed removed text_sha256",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_shingle_join": "doc_id n_shingles component_id",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLE_SQL) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = df.collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    assert set(ids) == {r.doc_id for r in rows} and (name == "op1_pack" or len(rows) == len(ids))
    if name in queries.ORACLE_SQL:
        duck = duckdb.connect()
        for t in ("documents", "benchmark"):
            duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        columns = sorted(df.columns)
        found = duck.execute(queries.ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        plain = lambda v: round(v, 9) if isinstance(v, float) else v
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == want


OP2_BASE = r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
 len(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]{14,}')) AS n_access, len(regexp_extract_all(coalesce(text, ''), '[0-9a-f]{16,}')) AS n_hex FROM documents"""
OP9_BASE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
 l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""


@pytest.mark.parametrize(("name", "sql"), [("op2_secret_scan", OP2_BASE), ("op9_quality_rules", OP9_BASE)])
def test_base_columns_in_sql(spark, name, sql):
    """The base figures of queries whose own method SQL can't say."""
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    want = sorted(tuple(r) for r in found.fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, DATA).select(*names).collect()) == want
