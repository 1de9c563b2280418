"""Groups of linked rows: local forests first, then the component loop on what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papertrail.llm.common import ddl, longs
from papertrail.operators.components import connected_components

EDGES = longs("a", "b")
#: Edges that a task joins before it passes the forest on.
_HELD = 1 << 20


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the least of its tree, with the least node of its tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        for side in (left, right):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        while not np.array_equal(root, above := root[root]):
            root = above
        if np.array_equal(before, root):
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _forests(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: the trees of what a task reads become stars, as many edges at a time as its
    memory is meant for. Only these move to other tasks."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            a, b = spanning_forest(table["a"].to_numpy(), table["b"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGES)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > _HELD:
                yield stars()
                held, size = [], 0
        if held:
            yield stars()

    return edges.select("a", "b").mapInArrow(join, ddl(EDGES))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that ``edges`` (a, b, longs) connect a node with. Nodes without an edge have no row."""
    return connected_components(_forests(edges))
