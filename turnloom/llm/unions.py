"""Connected components with a union-find in parts of bounded size, and stars between the parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.components import components
from turnloom.session import durable

#: Edges that one task unites: what it holds is a few times as many numbers or digests.
PART = 1 << 20


class Forest:
    """Trees of nodes that can be compared; a root is the least node of its tree."""

    def __init__(self) -> None:
        self.above: dict = {}

    def root(self, node):
        path = []
        while (up := self.above.get(node, node)) != node:
            path.append(node)
            node = up
        for below in path:
            self.above[below] = node
        return node

    def unite(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.above.setdefault(low, low)
            self.above[high] = low


def united(edges: DataFrame, part: int = PART) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``edges(a, b)`` that is not itself the least.

    Direction, repeats and loops do not matter; edges with a null end are ignored. Edges are dealt in parts of ``part``,
    each part becomes a forest of one edge per node, and where there are several parts their forests are joined by
    ``components``. No edges give no rows.
    """
    edges = durable(edges.where("a <> b").select("a", "b"))
    kind = edges.schema["a"].dataType.simpleString()
    parts = max(1, -(-edges.count() // part))

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch["a"].to_list(), batch["b"].to_list(), strict=True):
                forest.unite(a, b)
        nodes = [n for n, up in forest.above.items() if n != up]
        for start in range(0, len(nodes), 50_000):
            some = nodes[start : start + 50_000]
            yield pd.DataFrame({"a": some, "b": [forest.root(n) for n in some]})

    forests = durable(edges.repartition(parts).mapInPandas(unite, f"a {kind}, b {kind}"))
    return forests.select(F.col("a").alias("node"), F.col("b").alias("component")) if parts == 1 else components(forests)
