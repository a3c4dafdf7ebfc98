"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common

#: So many edges, or fewer, are what one task joins at last.
LAST = 200_000


def joined(batches):
    """(node, to) for all edges that are left: to is some node of the component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([find(x) for x in nodes], np.int64))], ["node", "to"])


def connected_components(edges: DataFrame) -> DataFrame:
    """A row (node, root) for every node of edges (a long, b long); root is some node of its component.

    In each round every node moves to the node of least random priority among itself and its neighbours, then the
    graph is contracted to where its nodes moved; a fixed part of the nodes goes in each round on average, whatever the
    shape. The last edges, LAST at most, are joined in one task, as rounds of so few cost more than they do. No edges give an empty result; repeated edges and loops do no harm.
    """
    links = common.stored(edges.select("a", "b"), "links")
    loops = links.filter("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    edges = common.stored(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select("b", "a")).distinct(), "edges")
    moves = []
    while n := edges.count():
        if n <= LAST:
            moves.append(common.stored(edges.coalesce(1).mapInArrow(joined, "node long, to long"), "moves"))
            break
        first = lambda node: F.struct(F.xxhash64(F.lit(len(moves)), node).alias("priority"), node.alias("node"))
        move = common.stored(edges.groupBy("a").agg(F.least(F.min(first(F.col("b"))), first(F.col("a")))["node"].alias("to")).select(F.col("a").alias("node"), "to"), "moves")
        moves.append(move)
        a, b = move.select(F.col("node").alias("a"), F.col("to").alias("a_to")), move.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        before, edges = edges, common.stored(edges.join(a, "a").join(b, "b").filter("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "edges")
        common.forget(before)

    def earlier(later: DataFrame, move: DataFrame) -> DataFrame:
        return move.join(later.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))

    if moves:
        found = reduce(earlier, reversed(moves[:-1]), moves[-1].select("node", F.col("to").alias("root")))
        found = found.union(loops.distinct().join(found, "node", "left_anti"))
    else:
        found = loops.distinct()
    found = common.stored(found, "roots")
    common.forget(links, edges, *moves)
    return found
