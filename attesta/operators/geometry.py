"""Boxes, their overlaps, and regions merged by overlap within a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.components import components, cut, tied

#: Overlap of the smaller box from which regions belong together, and the two measures of the page-wise engine.
SMALLER_OVERLAP, IOU, CONTAINMENT = 0.3, 0.30, 0.40
#: Detectors that can't carry a high severity alone.
UNRELIABLE = ("ela", "noise", "stamp")
_BOX = ("x", "y", "w", "h")
#: Regions of a page that are held against each other without a grid, and sides of the grids otherwise: a box uses the first that is no smaller than it.
PAGE = 64
GRIDS = (64, 256, 1024, 4096)
#: Pairs of boxes that a task holds at once.
PAIRS = 500_000


def intersection(a: str, b: str) -> Column:
    """Area two boxes share; ``a`` and ``b`` are prefixes of the columns x, y, w, h."""
    side = lambda p, s: F.greatest(F.least(F.col(f"{a}{p}") + F.col(f"{a}{s}"), F.col(f"{b}{p}") + F.col(f"{b}{s}")) - F.greatest(f"{a}{p}", f"{b}{p}"), F.lit(0))
    return side("x", "w") * side("y", "h")


def area(p: str) -> Column:
    return F.col(f"{p}w") * F.col(f"{p}h")


def smaller_overlap(a: str, b: str) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    both = area(a) + area(b) - intersection(a, b)
    return F.when(both > 0, intersection(a, b) / both).otherwise(0.0)


def _cells(side: Column) -> Column:
    """The grid cells of the given side that a box (o_x, o_y, o_w, o_h) has a part in."""
    along = lambda at, size: F.sequence(F.floor(F.col(at) / side), F.floor((F.col(at) + F.col(size) - 1) / side))
    return F.flatten(F.transform(along("o_x", "o_w"), lambda i: F.transform(along("o_y", "o_h"), lambda j: F.struct(side.alias("grid"), i.alias("i"), j.alias("j")))))


def overlapping_pairs(regions: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """Pairs (a_id < b_id) of regions (id, x, y, w, h in whole numbers) with equal ``keys`` that share an area and pass ``test`` over the prefixes a_ and b_.

    The regions of a page (what has equal keys) of up to PAGE regions meet all with all, others through grid cells: a box lies in a few cells of the grid that fits its
    size, and looks up boxes of its size and larger ones in the cells of their grids. A pair is reported in the one cell where its shared area
    begins. So work follows boxes that are near each other, whatever a page holds. Empty boxes and null keys meet nothing.
    """
    boxes = regions.where("w > 0 AND h > 0 AND x IS NOT NULL AND y IS NOT NULL").select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("id", *_BOX)])
    crowded = boxes.groupBy(*keys).count().where(F.col("count") > PAGE).select(*keys, F.lit(True).alias("o_crowded"))
    longest = F.greatest("o_w", "o_h")
    sized = boxes.join(crowded, keys, "left").withColumn("o_side", F.when(F.col("o_crowded"), F.coalesce(*[F.when(longest <= side, side) for side in GRIDS[:-1]], F.lit(GRIDS[-1]))).otherwise(0))
    whole = F.array(F.struct(F.lit(0).alias("grid"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    own = F.when(F.col("o_side") == 0, whole).otherwise(_cells(F.col("o_side")))
    looks = F.when(F.col("o_side") == 0, whole).otherwise(F.flatten(F.array(*[F.when(F.col("o_side") <= g, _cells(F.lit(g))).otherwise(F.array().cast("array<struct<grid:int,i:bigint,j:bigint>>")) for g in GRIDS])))
    placed = lambda cells, p: sized.withColumn("cell", F.explode(cells)).select(*keys, *[F.col(f"o_{c}").alias(f"{p}{c}") for c in ("id", *_BOX, "side")], "cell.*")
    met = placed(looks, "p_").join(placed(own, "q_"), [*keys, "grid", "i", "j"])
    begins = (F.col("grid") == 0) | (F.floor(F.greatest("p_x", "q_x") / F.col("grid")) == F.col("i")) & (F.floor(F.greatest("p_y", "q_y") / F.col("grid")) == F.col("j"))
    # Boxes of one size look each other up both ways.
    once = F.when(F.col("p_side") == F.col("q_side"), F.col("p_id") < F.col("q_id")).otherwise(F.col("p_side") < F.col("q_side"))
    first = F.col("p_id") < F.col("q_id")
    sides = [F.when(first, F.col(f"{x}{c}")).otherwise(F.col(f"{y}{c}")).alias(f"{z}{c}") for z, x, y in (("a_", "p_", "q_"), ("b_", "q_", "p_")) for c in ("id", *_BOX)]
    return met.where(once & (F.col("p_id") != F.col("q_id")) & begins & (intersection("p_", "q_") > 0)).select(*keys, *sides).where(test)


def page_pairs(lengths: np.ndarray, box: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of boxes (x, y, w, h) within pages of the given lengths, which follow each other: places of both, the area they share, which is none for no pair, and their own areas."""
    x, y, w, h = box
    ends = np.repeat(np.cumsum(lengths), lengths)
    later = ends - np.arange(len(x)) - 1
    parts = np.cumsum(later) // PAIRS
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    for low, high in zip(starts, [*starts[1:], len(x)], strict=True):
        n = later[low:high]
        a = np.repeat(np.arange(low, high), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        wide = np.minimum(x[a] + w[a], x[b] + w[b]) - np.maximum(x[a], x[b])
        high_ = np.minimum(y[a] + h[a], y[b] + h[b]) - np.maximum(y[a], y[b])
        met = (wide > 0) & (high_ > 0)
        a, b, shared = a[met], b[met], (wide * high_)[met]
        yield a, b, shared, w[a] * h[a], w[b] * h[b]


def page_boxes(*columns: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of pages and their values in a row, of lists of whole numbers that are equally long; nulls are 0, and where one is null the box is empty."""
    flat = [c.flatten() for c in columns]
    whole = np.ones(len(flat[0]), bool)
    for c in flat:
        whole &= c.is_valid().to_numpy(zero_copy_only=False)
    return columns[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [np.where(whole | (i == 0), c.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64) for i, c in enumerate(flat)]


def _roots(near: Callable[..., np.ndarray]):
    @F.arrow_udf("array<bigint>")
    def roots(ids: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        lengths, (own, *box) = page_boxes(ids, x, y, w, h)
        page = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((own, page))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(own[order]) != 0) | (np.diff(page[order]) != 0)
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        links = [np.empty((2, 0), np.int64)]
        for a, b, shared, s, t in page_pairs(lengths, box):
            held = near(shared, s, t)
            links.append(np.stack([code[a[held]], code[b[held]]]))
        root = own[order][new][tied(*np.concatenate(links, 1), int(new.sum()))][code]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(root, pa.int64()))

    return roots


def split_pages(regions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The regions of pages of up to PAGE regions, and those of larger ones; None where there are none."""
    crowded = cut(regions.groupBy(*keys).count().where(F.col("count") > PAGE).select(*[F.col(k).alias(f"__{k}") for k in keys]))
    if crowded.isEmpty():
        return regions, None
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return regions.join(crowded, same, "left_anti"), regions.join(crowded, same, "left_semi")


def rooted(regions: DataFrame, keys: list[str], near: Callable[..., np.ndarray], test: Column) -> DataFrame:
    """``regions`` (keys, id, x, y, w, h in whole numbers and more) with ``root``: the least id that a region hangs together with through pairs of a page that are near each other.

    ``near`` tells that of arrays of shared areas and both areas, ``test`` is the same over the prefixes a_ and b_. Pages of up to PAGE regions are a row each, which lies where the
    keys put it: rows that are dealt out by the keys, or by some of them, aren't moved again for it; what groups the result by document moves it once more. Larger pages go by ``overlapping_pairs`` and ``components``. Empty boxes, and those with nulls in key, id or place, meet nothing.
    """
    small, crowded = split_pages(regions, keys)
    pages = small.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in regions.columns if c not in keys])).alias("__rows"))
    # A page without a key is none.
    whole = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    parts = [F.transform(F.col(f"__rows.{c}"), lambda v: v.cast("long")) if dict(regions.dtypes)[c] != "bigint" else F.col(f"__rows.{c}") for c in ("id", *_BOX)]
    told = pages.withColumn("__roots", _roots(near)(*parts))
    flat = told.select(*keys, F.explode(F.arrays_zip("__rows", "__roots")).alias("__r"))
    found = flat.select(*[F.col(c) if c in keys else F.col(f"__r.__rows.{c}").alias(c) for c in regions.columns], F.col("__r.__roots").alias("root"))
    found = found.withColumn("root", F.when(whole & F.col("id").isNotNull(), F.col("root")).otherwise(F.col("id").cast("long")))
    if crowded is None:
        return found
    roots = components(overlapping_pairs(crowded, keys, test), keys, "a_id", "b_id").withColumnRenamed("node", "id")
    rest = crowded.join(roots, [*keys, "id"], "left").withColumn("root", F.coalesce("root", "id"))
    return found.unionByName(rest)


def merged_regions(regions: DataFrame, document: str) -> DataFrame:
    """Regions (id, x, y, w, h, score, severity, source) of a document merged through chains of overlaps.

    One row per merged region: the box around it, the highest score and severity (HIGH counts
    as MEDIUM when a single unreliable detector is behind it), sorted sources and the number of regions.
    """
    near = lambda shared, s, t: shared / np.minimum(s, t) > SMALLER_OVERLAP
    flat = rooted(regions, [document], near, smaller_overlap("a_", "b_") > SMALLER_OVERLAP)
    rank = F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    merged = flat.groupBy(document, "root").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.max("score").alias("score"), F.max(rank).alias("rank"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n_regions"),
    )
    alone = (F.size("sources") == 1) & F.col("sources")[0].isin(*UNRELIABLE)
    final = F.when(alone, F.least("rank", F.lit(2))).otherwise(F.col("rank"))
    return merged.select(
        document, "root", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "score",
        F.when(final == 3, "HIGH").when(final == 2, "MEDIUM").otherwise("LOW").alias("severity"), F.array_join("sources", "+").alias("source"), "n_regions",
    )
