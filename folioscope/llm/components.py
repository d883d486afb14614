"""Connected components of a link table, as tables throughout.

Every round hooks each label onto the least label it is linked with, shortens the
hooks by pointer jumping, and carries links and labels over.  Tasks first replace
the links they hold by a spanning forest, so what is shuffled stays near the number
of linked nodes.  Nothing is collected; each round ends in a written table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _core

LINKS = "a long, b long"
FOREST_NODES = 1 << 18


class Forest:
    """What a task knows of components: links come in, stars around least nodes go out."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self) -> pa.RecordBatch:
        rows = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        self.parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.int64()) for i in (0, 1)], names=["a", "b"])


def spanning(pairs):
    """Stars that span the pairs, given out whenever FOREST_NODES nodes are held."""
    forest = Forest()
    for a, b in pairs:
        forest.join(a, b)
        if len(forest.parent) > FOREST_NODES:
            yield forest.stars()
    yield forest.stars()


def _forest(batches):
    return spanning(x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b), written: label is the least node reachable."""
    links = _core.materialise(links.mapInArrow(_core.tidy(_forest), LINKS), "links")
    labels = _core.materialise(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while not links.isEmpty():
        hooks = _core.materialise(links.groupBy(F.greatest("a", "b").alias("c")).agg(F.min(F.least("a", "b")).alias("p"), F.lit(True).alias("moved")), "hooks")
        while not hooks.filter("moved").isEmpty():  # until every hook ends at a label that hooks onto none
            up = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            new = _core.materialise(hooks.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "hooks")
            _core.discard(hooks)
            hooks = new
        ends = hooks.drop("moved")
        moved = _core.materialise(labels.join(ends, labels.label == ends.c, "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        left = links
        for end in ("a", "b"):
            left = left.join(ends.withColumnRenamed("c", end), end, "left").withColumn(end, F.coalesce("p", end)).drop("p")
        left = _core.materialise(left.filter("a != b").select("a", "b").mapInArrow(_core.tidy(_forest), LINKS).distinct(), "links")
        _core.discard(labels, links, hooks)
        labels, links = moved, left
    _core.discard(links)
    return labels
