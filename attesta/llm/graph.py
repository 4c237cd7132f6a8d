"""Connected components on Spark by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from attesta.llm.session import cut_narrow

#: Up to this many links (16 bytes each) are folded by one task, which takes one pass; more go through steps over all of them.
FOLD = 1_000_000


def _cut_and_sum(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, dict]:
    """The edges, cut, and their number and checksum, observed in the same job."""
    seen = Observation()
    kept = cut_narrow(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum")), most)
    return kept, seen.get


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all nodes of the links (hi, lo), FOLD at most."""
    links = pa.Table.from_batches(list(batches), pa.schema([("hi", pa.int64()), ("lo", pa.int64())]))
    node, code = np.unique(np.concatenate([links[c].to_numpy() for c in ("hi", "lo")]), return_inverse=True)
    a, b = np.split(code, 2)
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_pydict({"node": node, "component": node[root]})


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) for every node with a link to another.

    ``edges`` holds two long columns; self links and rows with nulls are ignored,
    direction and repetition do not matter. Each step shuffles at most one row per
    edge and aggregates with map-side combining; the driver sees only two numbers. The
    least neighbours are cut before the join, so adaptive execution can split the links of one large star over tasks. A graph of up to
    FOLD links takes one pass of a single task instead, with the same result.
    """
    a, b = F.col(left), F.col(right)
    stars, seen = _cut_and_sum(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    if seen["n"] <= FOLD:
        return stars.coalesce(1).mapInArrow(_folded, "node long, component long")
    while True:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
        least = cut_narrow(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * seen["n"])
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars, now = _cut_and_sum(moved.union(least.select("hi", "m")).distinct(), 2 * seen["n"])
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label: the smallest node of its class) after ``links`` (u, v) between nodes of it, cut."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    between = links.join(at("u"), "u").join(at("v"), "v")
    found = connected_components(between, "u_label", "v_label").withColumnRenamed("node", "label")
    return cut_narrow(labels.join(cut_narrow(found), "label", "left").select("node", F.coalesce("component", "label").alias("label")))
