"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import materialize, release


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) with the same components as the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """edges (u, v) of one orderable type -> node, root: root is the smallest node that node reaches; isolated nodes are not in edges.

    Each round halves long paths at least; every round's edges are written to the shared folder, so
    a lost executor costs one round.  A star's centre may have any number of neighbours: only its
    minimum is computed per centre, with partial aggregation, and the join back to its neighbours can be
    split by adaptive execution.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), label)
    state = _fingerprint(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        old, edges = edges, materialize(small.distinct(), label)
        before, state = state, _fingerprint(edges)
        release(old)
        if state == before:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
