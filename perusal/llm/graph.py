"""Connected components of an edge table, wholly distributed.

Alternating large-star and small-star steps: every round rewires each node's neighbours to
the least of them, so the graph turns into stars around each component's least node. Rows
never outnumber the edges; hubs are dealt by skew-splitting joins, as each step is an
aggregate (with map-side combine) and a join with one row per node on the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LONG = np.int64


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning stars of each Arrow batch's edges: fewer edges, the same components."""
    for b in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            at = x
            while (p := up.setdefault(at, at)) != at:
                up[at] = up.setdefault(p, p)
                at = up[at]
            return at

        for x, y in zip(b["a"].tolist(), b["b"].tolist()):
            p, q = root(x), root(y)
            if p != q:
                up[max(p, q)] = min(p, q)
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pd.DataFrame({"a": np.array([x for x, _ in pairs], LONG), "b": np.array([r for _, r in pairs], LONG)})


def _rewire(e: DataFrame, large: bool) -> DataFrame:
    """One step; rows (a, b) with a > b in and out."""
    if large:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        out = e.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b")
    return out.distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge (a, b: long); root is the component's least node."""
    e = edges.mapInPandas(forest, "a long, b long").distinct()
    e = scratch.keep(e, "forest")
    mark = _mark(e)
    while True:
        nxt = scratch.keep(_rewire(_rewire(e, True), False), "stars")
        was, mark = mark, _mark(nxt)
        scratch.drop(e)
        e = nxt
        if mark == was:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
