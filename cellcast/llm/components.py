"""Connected components of an edge table, without ever gathering it on the driver.

Tasks first contract the edges they hold, by themselves and without a shuffle, to a spanning
forest.  While more than ``ONE_TASK`` edges are left, rounds over the cluster follow: each hooks
every node to its smallest neighbour, follows the hooks to their roots by pointer jumping, and
contracts the edges to the roots.  Nodes and edges shrink from round to round; every step is a
grouped minimum (combined before the shuffle, so hubs are harmless) or a join whose skewed
partitions adaptive execution may split.  What is left, a table of counted size, is solved by one
task.  Both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import SharedTables

ONE_TASK = 1 << 20  # edges of 16 bytes that one task may hold
CHUNK = 1 << 18  # edges that a task contracts at a time

EDGES = "a long, b long"


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the smallest node that each can reach."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _solved(parts: list[tuple[np.ndarray, np.ndarray]], loops: bool) -> pa.RecordBatch:
    nodes, roots = smallest_reachable(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    keep = np.ones(len(nodes), bool) if loops else nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each chunk of edges: every node with its smallest reachable one."""
    parts, held = [], 0
    for batch in batches:
        parts.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        held += batch.num_rows
        if held >= CHUNK:
            yield _solved(parts, False)
            parts, held = [], 0
    if held:
        yield _solved(parts, False)


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if parts:
        yield _solved(parts, True)


def connected_components(edges: DataFrame, shared: SharedTables, label: str, one_task: int = ONE_TASK) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of edges ``a``, ``b``.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    found = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(contract, EDGES)
    edges = shared.write(found, f"{label}-edges-0")
    result = None
    turn = 0
    while edges.count() > one_task:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("node", "other")
        hooks = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"))
        hooks = shared.write(hooks, f"{label}-hooks-{turn}-0")
        jump = 0
        while True:
            to = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = shared.write(hooks.join(to, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), f"{label}-hooks-{turn}-{jump + 1}")
            shared.drop(f"{label}-hooks-{turn}-{jump}")
            hooks, jump = jumped.select("node", "root"), jump + 1
            if jumped.where("moved").isEmpty():
                break
        at_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = edges.join(at_a, "a").join(at_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges, last = shared.write(contracted.distinct().mapInArrow(contract, EDGES), f"{label}-edges-{turn + 1}"), turn
        result = shared.write(hooks if result is None else _follow(result, hooks), f"{label}-result-{turn}")
        shared.drop(f"{label}-hooks-{turn}-{jump}")
        shared.drop(f"{label}-edges-{last}")
        if turn:
            shared.drop(f"{label}-result-{turn - 1}")
        turn += 1
    solved = shared.write(edges.coalesce(1).mapInArrow(solve, EDGES).toDF("node", "root"), f"{label}-roots")
    shared.drop(f"{label}-edges-{turn}")
    if result is not None:
        solved = _follow(result, solved)
    return solved.select("node", F.col("root").alias("component"))


def _follow(result: DataFrame, hooks: DataFrame) -> DataFrame:
    """Roots of roots; a root that is in no later edge stays."""
    later = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return result.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
