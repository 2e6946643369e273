"""Connected components of an edge table, without collecting edges or components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import materialize

_FOREST = "src long, dst long"


def _local_forest(batches):
    """Edges of a partition contracted to (node, least node of its local component)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def rows():
        nodes = np.fromiter(parent, np.int64, len(parent))
        tops = np.fromiter((root(n) for n in list(parent)), np.int64, len(parent))
        parent.clear()
        keep = nodes != tops
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(tops[keep])], ["src", "dst"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                parent[high] = low
                parent.setdefault(low, low)
        if len(parent) > 500_000:
            yield rows()
    yield rows()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``src, dst`` long): the least node it reaches.

    Alternates large-star and small-star steps until nothing changes.  A star step takes a
    minimum per node, pre-aggregated before the shuffle, and joins it back; no node's
    neighbours are ever gathered.  Loops (src = dst) and repeated edges do no harm.
    """
    edges = edges.where("src <> dst").mapInArrow(_local_forest, _FOREST)
    edges = materialize(edges.distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        edges = materialize(small.where("src <> dst").union(low.select("src", F.col("low").alias("dst"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
