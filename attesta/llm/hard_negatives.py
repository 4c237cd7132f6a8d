"""Hard negatives from k-means inverted lists, searched by Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm import textops
from attesta.llm.session import cut
from attesta.llm.topk import MOST, matrix, scores

#: Centroids, and the rows they are fitted on at most; neither bounds which rows are indexed, nor changes the result.
LISTS, SAMPLE_ROWS, SAMPLE_BYTES = 64, 8192, 16 << 20
#: Rows whose lists are cut at a time, and rows of a block of a list at most.
GATHERED, BLOCK_ROWS = 65_536, 1024
#: Anchors of one pass over the lists, and bytes of their vectors at most; both bound what is broadcast and collected.
WAVE_ANCHORS, WAVE_BYTES = 16_384, 32 << 20
#: Blocks that a task searches together, and targets of one matrix of scores.
TOGETHER, TARGET_ROWS = 64, 512
#: One block in so many is searched first, for scores that the others must reach.
SCOUT = 64
_NONE = -MOST - 1


def padded(q: np.ndarray, wide: int) -> np.ndarray:
    return q if q.shape[1] >= wide else np.pad(q, ((0, 0), (0, wide - q.shape[1])))


def fit(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """At most k centroids of the sample, rounded to integers; which ones only decides how fast the search is."""
    x = sample.astype(float)
    c = x[:: max(1, len(x) // k)][:k]
    for _ in range(rounds):
        own = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        used = np.unique(own)
        c = np.array([x[own == i].mean(axis=0) for i in used])
    return np.clip(np.round(c), -(2.0**62), 2.0**62).astype(np.int64)


def _indexer(sent, block_rows: int):
    """The task's rows as blocks of lists: nearest centroid, distance of the farthest row, ids, labels and packed vectors."""

    def blocks(ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> Iterator[dict]:
        wide = max(q.shape[1], sent.value.shape[1])
        c, q = padded(sent.value, wide).astype(float), padded(q, wide)
        x = q.astype(float)
        own = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        away = np.sqrt(((x - c[own]) ** 2).sum(axis=1))
        order = np.lexsort((away, own))
        cuts = np.flatnonzero(np.diff(own[order], prepend=-1))
        for start, stop in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            for i in range(start, stop, block_rows):
                rows = order[i : min(i + block_rows, stop)]
                most = max(abs(int(q[rows].max(initial=0))), abs(int(q[rows].min(initial=0))))
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                yield {"list": int(own[rows[0]]), "radius": float(away[rows].max()), "width": width, "ids": ids[rows].astype("<i8").tobytes(), "labels": labels[rows].astype("<i8").tobytes(), "vectors": q[rows].astype(f"<i{width}").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("list", pa.int32()), ("radius", pa.float64()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            wide = max(q.shape[1] for _, _, q in waiting)
            parts = [np.concatenate(x) for x in zip(*((i, labels, padded(q, wide)) for i, labels, q in waiting), strict=True)]
            waiting.clear()
            for block in blocks(*parts):
                yield pa.RecordBatch.from_pylist([block], schema)

        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))))
            if sum(len(i) for i, *_ in waiting) >= GATHERED:
                yield from flushed()
        if waiting:
            yield from flushed()

    return textops.returning(run)


@dataclass
class Targets:
    """What is looked for in one pass: for each target an anchor, the scores allowed, those the best must reach so far, and whether rows of the anchor's own label or of others."""

    centroids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    same: bool
    k: int

    def search(self, blocks: list[dict], best: tuple[np.ndarray, np.ndarray]) -> None:
        """Better rows of the blocks go into ``best`` (scores and ids, k for each target, by score descending, then id)."""
        if not len(self.anchor):
            return
        vectors = [np.frombuffer(b["vectors"], f"<i{b['width']}").reshape(len(b["ids"]) // 8, -1).astype(np.int64) for b in blocks]
        wide = max(self.q.shape[1], self.centroids.shape[1], max(v.shape[1] for v in vectors))
        a, c = padded(self.q, wide).astype(float), padded(self.centroids, wide).astype(float)
        which, radius = np.array([b["list"] for b in blocks]), np.array([b["radius"] for b in blocks])
        lengths = np.sqrt((a * a).sum(axis=1))[:, None]
        middle, reach = (a @ c.T)[:, which], lengths * radius
        # A row x of a list around c has a.x = a.c + a.(x - c), and |a.(x - c)| <= |a| |x - c|. The slack covers rounding.
        slack = 1e-9 * (lengths * np.sqrt((c * c).sum(axis=1))[which] + reach) + 1
        most, least = middle + reach + slack, middle - reach - slack
        visits = np.argsort(-most, axis=1)
        alive = np.ones(len(self.anchor), bool)
        for step in range(len(blocks)):
            block = visits[self.anchor, step]
            # Bounds fall from visit to visit: strictly below the window or the k-th score the search stops.
            alive &= most[self.anchor, block] >= np.maximum(np.maximum(self.low, self.floor), best[0][:, -1])
            if not alive.any():
                break
            visiting = np.flatnonzero(alive & (least[self.anchor, block] <= self.high))
            for b in np.unique(block[visiting]):
                those = visiting[block[visiting] == b]
                for i in range(0, len(those), TARGET_ROWS):
                    self._read(those[i : i + TARGET_ROWS], blocks[b], vectors[b], best)

    def _read(self, those: np.ndarray, block: dict, vectors: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> None:
        ids, labels = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["labels"], "<i8")
        anchors, at = np.unique(self.anchor[those], return_inverse=True)
        s = scores(self.q[anchors], vectors)[at]
        own = self.anchor[those]
        need = np.maximum(np.maximum(self.low, self.floor), best[0][:, -1])[those]
        fits = (s >= need[:, None]) & (s <= self.high[those, None]) & ((labels == self.labels[own, None]) == self.same) & (ids != self.ids[own, None])
        if self.k < len(ids):  # of each target no more than the k best scores and those equal to the last
            last = np.partition(np.where(fits, s, _NONE), len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            fits &= s >= last[:, None]
        t, r = np.nonzero(fits)
        if not len(t):
            return
        new = np.unique(t)
        have = best[0][those[new]] > _NONE
        t0, r0 = np.nonzero(have)
        t, ids_, s_ = np.concatenate([new[t0], t]), np.concatenate([best[1][those[new]][t0, r0], ids[r]]), np.concatenate([best[0][those[new]][t0, r0], s[t, r]])
        order = np.lexsort((ids_, -s_, t))
        t, ids_, s_ = t[order], ids_[order], s_[order]
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        keep = rank < self.k
        best[0][those[t[keep]], rank[keep]], best[1][those[t[keep]], rank[keep]] = s_[keep], ids_[keep]


def _searcher(sent):
    """The task's best rows for each target: its number, vec_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = sent.value
        best = (np.full((len(targets.anchor), targets.k), _NONE), np.zeros((len(targets.anchor), targets.k), np.int64))
        waiting: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                waiting.append(row)
                if len(waiting) == TOGETHER:
                    targets.search(waiting, best)
                    waiting.clear()
        if waiting:
            targets.search(waiting, best)
        t, r = np.nonzero(best[0] > _NONE)
        if len(t):
            yield pa.RecordBatch.from_pydict({"target": t.astype(np.int32), "vec_id": best[1][t, r], "score": best[0][t, r]})

    return textops.returning(run)


def _ranked(blocks: DataFrame, targets: Targets) -> DataFrame:
    """target, rank (int, from 1), vec_id, score: the k best rows for each target."""
    order = Window.partitionBy("target").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = blocks.mapInArrow(_searcher(blocks.sparkSession.sparkContext.broadcast(targets)), "target int, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= targets.k)


def _searched(blocks: DataFrame, targets: Targets) -> DataFrame:
    """``_ranked``, after a look at one block in SCOUT: the k-th score there is one that the others must reach."""
    scouted = _ranked(blocks.where(F.pmod(F.xxhash64("ids"), F.lit(SCOUT)) == 0), targets).where(F.col("rank") == targets.k)
    for r in scouted.collect():  # a row per target of the wave
        targets.floor[r.target] = r.score
    return _ranked(blocks, targets)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its positives the best-scoring rows of other labels with low % to high % of the positive's score.

    ``vectors`` holds vec_id (long), label (whole number) and q (long[]), as made by ``quantised``; ``anchors`` is a condition on them. Rows with a
    null vec_id, label or q take no part; further columns are ignored. A row's score is its integer inner product with the anchor
    (vectors of different lengths are compared over the shorter one); higher scores come first, ties by smaller vec_id. An anchor's positives are its
    first ``positives`` other rows of the same label, all if there are fewer. A positive's negatives are the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score (none where that score is negative). Rows with the anchor's vec_id are not
    candidates; a vec_id that is repeated counts once per row, of a repeated anchor one row counts, that with the least label and q. Columns: anchor_id,
    positive_id, rank (int, from 1), negative_id, positive_score, negative_score. Empty tables give an empty result. Scores beyond a long are given as the
    nearest that fits.

    Centroids are fitted on SAMPLE_ROWS rows at most; every row goes to the inverted list of its nearest centroid, in blocks that hold the distance of their
    farthest row. Blocks are cut where the rows lie, without a shuffle, so that no list, however full, comes together, and are written once. Anchors
    pass over them in waves of bounded size. In a task each anchor visits blocks by descending bound, centroid score plus |anchor| times
    radius; blocks wholly outside the window are skipped, and the search stops when the bound falls strictly below the k-th score, which one block in SCOUT
    has given a start. Tasks send on k rows for each target at most.
    """
    spark = vectors.sparkSession
    own = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "q", F.coalesce(anchors, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    asked = cut(own.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q"))
    n, wide = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    all_wide = own.agg(F.max(F.size("q"))).first()[0] or 0
    sample = own.select("q").orderBy(F.xxhash64("vec_id"), "q").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(all_wide, 1))))).collect()
    points = matrix(pa.array([r.q for r in sample], pa.list_(pa.int64()))) if sample else np.zeros((1, 1), np.int64)
    centroids = fit(points, LISTS)
    blocks = cut(own.select("vec_id", "label", "q").mapInArrow(_indexer(spark.sparkContext.broadcast(centroids), BLOCK_ROWS), "list int, radius double, width int, ids binary, labels binary, vectors binary"))
    waves = max(1, -(-n // max(1, min(WAVE_ANCHORS, WAVE_BYTES // (8 * max(wide or 0, 1))))))
    mined = [_mined(blocks, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w), centroids, positives, negatives, low, high) for w in range(waves)]
    return reduce(DataFrame.union, mined)


def _mined(blocks: DataFrame, asked: DataFrame, centroids: np.ndarray, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of one wave of anchors."""
    spark = blocks.sparkSession
    rows = asked.orderBy("vec_id").collect()  # at most about WAVE_ANCHORS
    ids, labels = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label"))
    q = matrix(pa.array([r.q for r in rows], pa.list_(pa.int64())))
    open_ = lambda size, value: np.full(size, value, np.int64)
    targets = Targets(centroids, ids, labels, q, np.arange(len(rows)), open_(len(rows), _NONE + 1), open_(len(rows), MOST), open_(len(rows), _NONE + 1), True, positives)
    near = _searched(blocks, targets).orderBy("target", "rank").collect()  # ``positives`` rows per anchor of the wave
    near = [r for r in near if r.score >= 0]
    bounds = [(-(-low * r.score // 100), high * r.score // 100) for r in near]
    targets = Targets(centroids, ids, labels, q, np.array([r.target for r in near], np.int64), np.array([b for b, _ in bounds], np.int64), np.array([b for _, b in bounds], np.int64), open_(len(near), _NONE + 1), False, negatives)
    pairs = spark.createDataFrame([(i, int(ids[r.target]), r.vec_id, r.score) for i, r in enumerate(near)], "target int, anchor_id long, positive_id long, positive_score long")
    found = _searched(blocks, targets).join(F.broadcast(pairs), "target")  # as many rows as targets
    return cut(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
