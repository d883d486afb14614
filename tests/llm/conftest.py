import random
import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Documents with columns whose names operators use inside.
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), *[StructField(k, StringType()) for k in ("i", "t", "class", "label", "__text", "bucket", "key")]])


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def words(rng, n, size=400):
    return [f"w{int(rng.paretovariate(0.6)) % size}" for _ in range(n)]


@pytest.fixture(scope="session")
def mixed_rows():
    """Nulls, empty and blank texts, repeated rows, copies, near copies, a very long text."""
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, "a text without an id of its own"), (4, "One two"), (4, "One two"), (5, "ONE two"), (6, "é É ß 日本 — x")]
    for i in range(10, 70):
        lines = [" ".join(words(rng, rng.randrange(3, 30))).capitalize() + "." for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(lines)))
    rows += [(i + 100, rows[10 + i][1]) for i in range(5)]
    rows.append((300, " ".join(words(rng, 30_000, 5000))))
    return rows
