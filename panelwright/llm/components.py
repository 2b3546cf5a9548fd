"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that is not the smallest of its component, and that smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (up := label[label] != label).any():
            label[up] = label[label[up]]
        if (label[x] == label[y]).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        a, b = forest(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Each round deals edges by their larger end, lets every task find the components of the edges it has, and then
    points each node to what its own target points to, until every node points once, to a node that points nowhere.
    The number of rounds grows with the logarithm of the longest path. Rounds are written to the shared folder, so
    lineage stays short. Loops and repeated edges are allowed; an empty table gives an empty table.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    for _ in range(max_rounds):
        current = written(ends.repartition("a").mapInArrow(_forests, "a long, b long"), "edges")
        if _settled(current):
            break
        up = current.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("up"))
        ends = current.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b")).distinct()
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``comps`` after more links: only the links between different components are looked at."""
    now = comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(now[0], "a", "left").join(now[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between.where("a != b"))
    step = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
    moved = comps.join(step, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return written(moved.unionByName(joined.join(comps.select("node"), "node", "left_anti")), "components")


def _settled(edges: DataFrame) -> bool:
    """Whether every node points once, to a node that points nowhere."""
    onward = edges.select(F.col("b").alias("a")).distinct().withColumn("n", F.lit(1)).unionByName(edges.select("a", F.lit(1).alias("n")))
    return not onward.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").take(1)
