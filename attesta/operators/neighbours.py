"""Neighbours: names that contain a name, and the nearest and second nearest of every vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, each of which meets every other once; rows of a strip of one comparison.
BLOCK_ROWS, STRIP_ROWS = 4096, 512
#: Neighbours of a strip that are measured again by their differences.
NEAREST = 8
_NEAR = "rep long, near long, d double"
#: Letters of the runs through which names meet.
GRAM = 3


def _grams(name: Column, size: Column) -> Column:
    """Distinct runs of ``size`` letters of a name."""
    last = F.length(name) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(name, i, size)))


def containing(rows: DataFrame, name: str, listed: DataFrame, listed_name: str) -> DataFrame:
    """Each pair of a row and a listed one whose name contains the row's, in any case: both sides' columns (their names differ).

    Null and blank names match nothing. A name holds every run of letters that a name inside it has, so
    a row need only meet the listed names that have its rarest run of three letters (a shorter name is its
    own run); a row with a run that no listed name has meets none. So common words bring few pairs together.
    """
    small = F.lower(name)
    asked = rows.where(F.trim(name) != "").select(F.struct(*rows.columns).alias("__row"), small.alias("__name"))
    # Runs are looked at once for each different name; equal rows stay rows of their own.
    names = asked.select("__name").distinct().select("__name", F.explode(_grams(F.col("__name"), F.least(F.lit(GRAM), F.length("__name")))).alias("__gram"))
    whole = F.lower(listed_name)
    runs = F.array_union(F.array_union(_grams(whole, F.lit(1)), _grams(whole, F.lit(2))), _grams(whole, F.lit(GRAM)))
    held = listed.select(F.struct(*listed.columns).alias("__listed"), whole.alias("__whole"), F.explode(runs).alias("__gram"))
    often = held.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = names.join(often, "__gram", "left").groupBy("__name").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__least"))
    met = asked.join(rarest.select("__name", F.col("__least.__gram").alias("__gram")), "__name").join(held, "__gram")
    return met.where(F.contains("__whole", "__name")).select("__row.*", "__listed.*")


def _pack(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    return pa.table({"wide": group["wide"][:1], "block": group["block"][:1], "ids": pa.array([group["rep"].to_numpy().tobytes()], pa.binary()), "data": pa.array([group["e"].combine_chunks().flatten().to_numpy().tobytes()], pa.binary())})


def two_nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``q`` the two nearest rows of ``c`` with other ids (as many as there are): ids and Euclidean distances.

    Products of whole blocks say which rows come into question; distances are taken from
    differences. Where rounding of the products could hide a nearer row, all that are close enough are measured.
    """
    norm = (c * c).sum(axis=1)
    out = []
    for i in range(0, len(q), STRIP_ROWS):
        x, ids = q[i : i + STRIP_ROWS], q_ids[i : i + STRIP_ROWS]
        own = (x * x).sum(axis=1)
        rough = own[:, None] + norm - 2 * (x @ c.T)
        rough[ids[:, None] == c_ids] = np.inf
        k = min(NEAREST, len(c))
        at = np.argpartition(rough, k - 1, axis=1)[:, :k]
        square = ((x[:, None, :] - c[at]) ** 2).sum(axis=2)
        square[np.isinf(np.take_along_axis(rough, at, axis=1))] = np.inf
        order = np.argsort(square, axis=1, kind="stable")[:, :2]
        best, d = np.take_along_axis(at, order, axis=1), np.take_along_axis(square, order, axis=1)
        if k < len(c):
            slack = 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (own + norm.max())
            reach = np.minimum(d[:, -1] + slack, np.finfo(np.float64).max)
            for r in np.flatnonzero(np.take_along_axis(rough, at, axis=1).max(axis=1) <= reach):
                some = np.flatnonzero(rough[r] <= reach[r])
                every = ((x[r] - c[some]) ** 2).sum(axis=1)
                two = np.argsort(every, kind="stable")[:2]
                best[r, : len(two)], d[r, : len(two)] = some[two], every[two]
        row, column = np.nonzero(np.isfinite(d))
        out.append((ids[row], c_ids[best[row, column]], np.sqrt(d[row, column])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _compare(group: pa.Table) -> pa.Table:
    sides = []
    for row in group.sort_by("block").to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        sides.append((ids, np.frombuffer(row["data"], np.float64).reshape(len(ids), row["wide"])))
    a, b = sides[0], sides[-1]
    found = [two_nearest(*a, *b)] + ([two_nearest(*b, *a)] if len(sides) > 1 else [])
    rep, near, d = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"rep": rep, "near": near, "d": d})


def ratio_pairs(vectors: DataFrame, ratio: float = 0.74) -> DataFrame:
    """Pairs a < b of ``vectors`` (vec_id long, embedding array) where b is nearest to a and nearer than ``ratio`` times a's second nearest; and their distance.

    Every vector is held against every other of its length. One that is null, empty or has null or
    non-finite components is left out, and so is one with less than two others. vec_id is unique.

    Equal vectors are folded into one first: of three or more none has a nearest that is
    nearer than its second, and neither has a vector whose nearest is one of them. The
    rest are dealt into blocks that meet pairwise; each meeting gives a row's two nearest there, and the two of all meetings are merged.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    good = vectors.select("vec_id", e.alias("e")).where(F.col("vec_id").isNotNull() & (F.size("e") > 0)).where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    folded = good.groupBy("e").agg(F.min("vec_id").cast("long").alias("rep"), F.max("vec_id").cast("long").alias("last"), F.count("*").alias("n"))
    blocks = max(1, -(-good.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    packed = folded.select(F.size("e").alias("wide"), block.alias("block"), "rep", "e").groupBy("wide", "block").applyInArrow(_pack, "wide int, block int, ids binary, data binary")
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = met.groupBy("wide", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).applyInArrow(_compare, _NEAR)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("d", "near"))).where("r <= 2")
    two = ranked.groupBy("rep").agg(F.max(F.when(F.col("r") == 1, F.col("near"))).alias("near"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("second"))
    counted = folded.select("rep", "last", "n").join(two, "rep")
    twins = counted.where("n = 2 AND d > 0").select(F.col("rep").alias("a"), F.col("last").alias("b"), F.lit(0.0).alias("distance"))
    single = counted.where((F.col("n") == 1) & (F.col("rep") < F.col("near")) & (F.col("d") < ratio * F.col("second")))
    alone = folded.where("n = 1").select(F.col("rep").alias("near"))
    return twins.unionByName(single.join(alone, "near", "left_semi").select(F.col("rep").alias("a"), F.col("near").alias("b"), F.col("d").alias("distance")))
