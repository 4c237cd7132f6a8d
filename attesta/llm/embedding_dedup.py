"""Near-duplicate vectors by collision counting over many sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.graph import connected_components
from attesta.llm.session import cut

#: Seed of the projections.
SEED = 7
#: A projection end with more rows than this is split into blocks, each pair of which is one task's work.
BLOCK = 1024
#: Up to this many overfull ends are broadcast; more are joined.
BROADCAST_ENDS = 100_000
_SIDE = 1 << 32


@dataclass(frozen=True)
class Calibration:
    """How many projections, where their ends begin, how wide windows are, and how many collisions a candidate has."""

    projections: int
    tail: float
    window: float
    collisions: int


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def _quantile(upper: float) -> float:
    """The value a standard normal variable exceeds with probability ``upper``."""
    lo, hi = 0.0, 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(mid / math.sqrt(2)) > upper else (lo, mid)
    return lo


def calibrate(rows: int, threshold: float = 0.9, recall: float = 0.999, collisions: int = 3) -> Calibration:
    """Projections so that a pair at exactly ``threshold`` reaches ``collisions`` with probability ``recall``.

    A Gaussian projection of two unit vectors is a pair of standard normals with their
    cosine as correlation, so the chance of a collision (both beyond ``tail`` at the
    same end and within ``window``) does not depend on the data. An end holds about
    max(256, 2 sqrt(rows)) rows, which balances projecting against comparing. Beyond the tail places fall
    off as exp(-tail * excess), so a window of 2 / tail leaves out an eighth of an end's unrelated pairs at every size.
    """
    share = min(0.1, max(256.0, 2 * math.sqrt(rows)) / max(rows, 1))
    tail, spread = _quantile(share), math.sqrt(max(1 - threshold**2, 1e-12))
    window = 2 / tail
    x = np.linspace(tail, tail + 8, 4001)
    inside = _normal_cdf((x + window - threshold * x) / spread) - _normal_cdf((np.maximum(tail, x - window) - threshold * x) / spread)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * np.maximum(inside, 0)
    chance = 2 * float(((density[1:] + density[:-1]) / 2).sum() * (x[1] - x[0]))
    expected = float(collisions)
    while math.exp(-expected) * sum(expected**k / math.factorial(k) for k in range(collisions)) > 1 - recall:
        expected += 0.01
    return Calibration(math.ceil(expected / chance), tail, window, collisions)


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _projector(c: Calibration):
    """The ends each vector lies in: end ids (two for a projection) and its places there."""
    matrices: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                vectors = batch.column("embedding")
                sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
                begins = np.concatenate([[0], np.cumsum(sizes)])
                ends: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
                places: list[np.ndarray] = [np.zeros(0)] * batch.num_rows
                for size in np.unique(sizes):
                    if size not in matrices:
                        matrices[size] = np.random.Generator(np.random.PCG64([SEED, int(size)])).standard_normal((size, c.projections))
                    rows = np.flatnonzero(sizes == size)
                    h = _unit(flat[begins[rows][:, None] + np.arange(size)]) @ matrices[size]
                    r, p = np.nonzero(np.abs(h) > c.tail)
                    value, cuts = h[r, p], np.searchsorted(r, np.arange(1, len(rows)))
                    for row, e, v in zip(rows, np.split(int(size) * _SIDE + 2 * p + (value > 0), cuts), np.split(np.abs(value), cuts), strict=True):
                        ends[row], places[row] = e, v
                lengths = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
                listed = lambda parts, kind: pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(parts), kind))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), vectors, listed(ends, pa.int64()), listed(places, pa.float64()).cast(pa.list_(pa.float32()))], ["node", "copies", "embedding", "ends", "places"])

    return run


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _linker(c: Calibration, threshold: float):
    """Links among one end's rows (or two of its blocks): for each linked row the copies linked and a row it hangs together with."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n, end = group.num_rows, group["end"][0].as_py()
        side = group["side"].to_numpy()
        across = group["low"][0].as_py() != group["high"][0].as_py()
        lists, values = group["ends"].combine_chunks(), group["places"].combine_chunks()
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        end_of, place = lists.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64)
        order = np.lexsort((place, end_of))
        row, end_of, place = row[order], end_of[order], place[order]
        # Windows: from each entry of a sorted end up to `window` further; the entry is the centre for those on either side.
        code = np.unique(end_of, return_inverse=True)[1] * 64.0 + place
        upto = np.minimum(np.searchsorted(code, code + c.window, "right"), np.searchsorted(end_of, end_of, "right"))
        more = upto - np.arange(len(code)) - 1
        a = np.repeat(np.arange(len(code)), more)
        b = a + 1 + _ranges(more)
        if across:
            keep = side[row[a]] != side[row[b]]
            a, b = a[keep], b[keep]
        pair = np.minimum(row[a], row[b]) * n + np.maximum(row[a], row[b])
        pair, first, count = np.unique(pair, return_index=True, return_counts=True)
        # Of the ends where a pair collides, the first one answers for it.
        pair = pair[(count >= c.collisions) & (end_of[a[first]] == end)]
        u, v = pair // n, pair % n
        vectors = group["embedding"].combine_chunks()
        unit = _unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
        close = np.concatenate([np.einsum("ij,ij->i", unit[u[i : i + BLOCK * 64]], unit[v[i : i + BLOCK * 64]]) >= threshold for i in range(0, max(len(u), 1), BLOCK * 64)])
        u, v = u[close], v[close]
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        links = np.bincount(u, copies[v], n) + np.bincount(v, copies[u], n)
        root = node.copy()
        while True:
            low = np.minimum(root[u], root[v])
            if (root[u] == low).all() and (root[v] == low).all():
                break
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
        linked = np.flatnonzero(links)
        return pa.Table.from_pydict({"node": node[linked], "links": links[linked].astype(np.int64), "root": root[linked]})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999) -> DataFrame:
    """One row per row of ``vectors`` (vec_id long, embedding array): vec_id, n_links, component_id, kept.

    Two vectors are linked when their cosine in double precision is at least
    ``threshold``. ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest vec_id reachable by links (itself included), ``kept`` says whether that
    is the row's own. Rows that are null, empty or zero, or hold null or non-finite
    components, link with nothing, as do rows without vec_id (their component_id is
    null, and they are kept). Vectors of different lengths don't link. Repeated rows
    link like any other copies; rows that share a vec_id but not a vector each have the links of their
    own vector. Further columns are ignored, an empty table gives an empty result.

    Equal vectors are first folded into one with a count, so groups of exact copies cost
    nothing further. Each distinct vector is projected on Gaussian directions and keeps the ends
    of the sorted projections it lies in; the rows of an end come together, window
    collisions are counted for each pair over all ends the two share, and pairs that reach the
    calibrated count are verified. A pair is answered for by the first end where
    it collides, so links are counted without bringing pairs together. An end that a
    cluster fills is split into blocks. Tasks send on one row per linked
    vector, never pairs. Projecting and comparing both grow as rows ** 1.5, the shuffle as rows.
    """
    kind = dict(vectors.dtypes)["embedding"]
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select("vec_id", "embedding")
    fit = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    fit_rows = own.where(fit)
    reps = cut(fit_rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))).withColumn("node", F.monotonically_increasing_id())
    c = calibrate(reps.count(), threshold, recall)
    tails = cut(reps.select("node", "copies", "embedding").mapInArrow(_projector(c), f"node long, copies long, embedding {kind}, ends array<long>, places array<float>"))
    full = cut(tails.select(F.explode("ends").alias("end")).groupBy("end").count().where(F.col("count") > BLOCK).select("end", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    if full.count() <= BROADCAST_ENDS:
        full = F.broadcast(full)
    spread = tails.withColumn("end", F.explode("ends")).join(full, "end", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other", "blocks")
    found = cut(spread.groupBy("end", "low", "high").applyInArrow(_linker(c, threshold), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found, "node", "root")
    classed = cut(reps.join(links, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = cut(classed.groupBy("component").agg(F.min("rep").alias("component_id")))
    # Both sides cut, so that adaptive execution can split a large class or group of copies over tasks.
    known = cut(classed.join(least, "component").select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    linked = fit_rows.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = own.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
