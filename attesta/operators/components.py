"""Connected components over links between rows that share keys."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Links of a page that is folded as one row.
FOLD = 4096


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the cluster names, so that later steps don't depend on executors that may be lost.

    Only in local mode, where none is named, a temporary folder serves.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="attesta-checkpoint-"))
    return df.checkpoint(eager=True)


def _cut_and_sum(links: DataFrame, columns: list[str]) -> tuple[DataFrame, dict]:
    seen = Observation()
    kept = cut(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum")))
    return kept, seen.get


def tied(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the numbers 0..n-1 the least one that it hangs together with through links between ``a`` and ``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, node and root of whole pages, a row of which has the page's links as its last column."""
    for batch in batches:
        keys, links = batch.columns[:-1], batch.column(batch.num_columns - 1)
        ends = links.flatten()
        node = np.concatenate([ends.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        page = np.tile(np.repeat(np.arange(batch.num_rows), links.value_lengths().to_numpy()), 2)
        order = np.lexsort((node, page))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(node[order]) != 0) | (np.diff(page[order]) != 0)
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        a, b = np.split(code, 2)
        root = tied(a, b, int(new.sum()))
        first = order[new]
        yield pa.RecordBatch.from_arrays([*(k.take(pa.array(page[first])) for k in keys), pa.array(node[first]), pa.array(node[first][root])], [*batch.schema.names[:-1], "node", "root"])


def components(links: DataFrame, keys: list[str], a: str, b: str, fold: int = FOLD) -> DataFrame:
    """keys, ``node`` and ``root`` (the least node reachable within the keys) for every node with a link to another one.

    ``links`` holds the keys (a document, a page; the columns may not be called hi, lo, u, v, m, node or root) and two columns of whole numbers. Direction and repetition
    don't matter; links of a node to itself and links with nulls, in a key too, are ignored. Pages of up to ``fold`` links are folded in a row each, many
    pages at once. Larger ones go through alternating steps over all their links, which tie every node's larger neighbours, then its smaller ones, to the
    least of them, until nothing moves: few rounds, each a shuffle of at most two rows per link, so that neither a large page nor a
    component has to fit a task. The driver sees three numbers.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    whole = links.where((x != y) & F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    whole = cut(whole.select(*keys, F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")))
    large = whole.groupBy(*keys).count().where(F.col("count") > fold).select(*keys)
    some = large.count()
    schema = StructType([*(whole.schema[k] for k in keys), StructField("node", LongType()), StructField("root", LongType())])
    rows = whole.join(large, keys, "left_anti") if some else whole
    folded = rows.groupBy(*keys).agg(F.collect_list(F.struct("hi", "lo")).alias("links")).mapInArrow(_folded, schema)
    return folded.union(_starred(whole.join(large, keys, "left_semi"), keys)) if some else folded


def _starred(whole: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, "hi", "lo"]
    stars, seen = _cut_and_sum(whole.distinct(), columns)
    while True:
        both = stars.select(*keys, F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(*keys, "lo", "hi"))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy(*keys, "hi").agg(F.min("lo").alias("m"))
        small = large.join(least, [*keys, "hi"]).where("lo <> m").select(*keys, F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars, now = _cut_and_sum(small.union(least.select(*keys, "hi", "m")).distinct(), columns)
        if now == seen:
            break
        seen = now
    roots = stars.select(*keys, F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return stars.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
