"""Connected components of a distributed edge list, by spanning forests and contraction.

Each task first thins its edges to a spanning forest of them (copies and cycles go, stars stay), so a round starts with
no more edges than a task has nodes. As long as many edges are left, every node hooks to its smallest neighbour, hooks
are followed to their ends by doubling, and the edges are renamed; chains and hubs alike shrink by a constant factor at
least, so rounds and doublings grow with the logarithm of the longest path. SMALL edges or fewer, a number that doesn't
grow with the data, are finished by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import Scratch

#: Edges that one task finishes, and edges that a task holds while it thins them.
SMALL, HELD = 1 << 20, 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (a, b), and the smallest node of each one's component."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(node))
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, hi, lo)
        while True:
            far = root[root]
            if (far == root).all():
                break
            root = far
        a, b = root[a], root[b]
        left = a != b
        a, b = a[left], b[left]
    return node, node[root]


def _thin(batches):
    """A spanning forest of what the task has, as stars, in runs of at most HELD edges."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch["a"].to_numpy(np.int64)])
        b = np.concatenate([b, batch["b"].to_numpy(np.int64)])
        if len(a) > HELD:
            b, a = forest(a, b)
            off = a != b
            a, b = a[off], b[off]
            if 2 * len(a) > HELD:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = a[:0], b[:0]
    if len(a):
        b, a = forest(a, b)
        yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def _finish(batches):
    parts = [(batch["a"].to_numpy(np.int64), batch["b"].to_numpy(np.int64)) for batch in batches]
    if parts:
        node, low = forest(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        yield pd.DataFrame({"node": node, "component": low})


def components(edges: DataFrame, scratch: Scratch, name: str, small: int = SMALL) -> DataFrame:
    """(node, component) for each node of an edge (a, b) of two nodes; component is the smallest reachable node."""
    hooks: list[DataFrame] = []
    left = edges.select("a", "b").filter("a <> b")
    while True:
        left = scratch.table(left.mapInPandas(_thin, "a long, b long"), f"{name}-edges{len(hooks)}")
        if left.count() <= small:
            break
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), f"{name}-hook{len(hooks)}")
        for turn in range(64):  # 2**64 steps are more than there are nodes
            on = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
            hook = scratch.table(hook.join(on, "to").select("node", "to", "far"), f"{name}-jump{len(hooks)}-{turn}")
            moved = not hook.filter("to <> far").isEmpty()
            hook = hook.select("node", F.col("far").alias("to"))
            if not moved:
                break
        hooks.append(hook)
        one = hook.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        two = hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = left.join(one, "a").join(two, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct()
    out = left.coalesce(1).mapInPandas(_finish, "node long, component long")
    for hook in reversed(hooks):
        end = out.select(F.col("node").alias("to"), "component")
        out = hook.join(end, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return scratch.table(out, f"{name}-components")
