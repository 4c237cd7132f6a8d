"""Exact top-k by inner product, selected through refined histograms of all scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.session import cut

#: Queries of one pass over the candidates, and bytes of their vectors at most; both bound what is broadcast.
WAVE_QUERIES, WAVE_BYTES = 16_384, 32 << 20
#: Queries and candidates of a matrix of scores, which takes 8 bytes a score.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 4096
#: Bits of a score that one round settles: a histogram has 2 ** BITS bins.
BITS = 9
#: Sums below the first are exact in double precision, below the second in 64-bit integers.
EXACT, WIDE = 2**53, 2**63
#: Scores beyond this are given as this (and its negative); it leaves room for their difference in 64 bits.
MOST = 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 256, carry: Sequence[Column] = ()) -> DataFrame:
    """vec_id, what is carried and q = floor(scale * component) as long[]; rows that are null or hold null or non-finite components are left out.

    Components beyond the range of a long saturate there.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.select("vec_id", *carry, "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    top = float(2**63)

    def whole_number(x):
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(y >= top, F.lit(MOST)).when(y < -top, F.lit(-MOST - 1)).otherwise(F.floor(F.when((y >= -top) & (y < top), y)))

    return whole.withColumn("q", F.transform("embedding", whole_number)).drop("embedding")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter rows are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``q`` with all of ``c`` over the shorter length, exact; beyond 64 bits they saturate."""
    wide = min(q.shape[1], c.shape[1])
    q, c = q[:, :wide], c[:, :wide]
    # By Cauchy-Schwarz no partial sum of absolute products is above the product of the norms.
    norms = [float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0))) for x in (q, c)]
    bound = norms[0] * norms[1] * 1.001
    if bound < EXACT:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if bound < WIDE:
        return q @ c.T
    wide_sums = q.astype(object) @ c.astype(object).T
    return np.clip(wide_sums, -MOST, MOST).astype(np.int64)


@dataclass
class Wave:
    """Queries of one pass: ids and vectors by id, the lower end of each one's interval, how many of its k scores lie in or below it, and block sizes."""

    ids: np.ndarray
    q: np.ndarray
    low: np.ndarray
    need: np.ndarray
    query_rows: int
    candidate_rows: int

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First query of a block, the candidates' ids, scores[query, candidate], and which of these are in a query's interval or above (its own row is not)."""
        for batch in batches:
            for i in range(0, batch.num_rows, self.candidate_rows):
                part = batch.slice(i, self.candidate_rows)
                ids, c = part.column(0).to_numpy(), matrix(part.column(1))
                for at in range(0, len(self.ids), self.query_rows):
                    block = slice(at, at + self.query_rows)
                    s = scores(self.q[block], c)
                    yield at, ids, s, (s >= self.low[block, None]) & (self.ids[block, None] != ids)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k candidates of ``vectors`` with the highest integer inner product for each row of ``queries``.

    Both hold vec_id (long) and q (long[]), as made by ``quantised``. A query's own
    vec_id is no candidate. Ties go to the smaller vec_id; a query with fewer
    candidates gets all of them, one with none gets no row. Vectors of different
    lengths are compared over the shorter one. A vec_id that is repeated as a candidate
    counts once per row; of a repeated query one row counts, that with the least q. Rows
    without vec_id take no part; empty tables give an empty result; further columns are ignored. Sums are exact whatever the
    components; a score that does not fit a long is given as the nearest that does, and ties there
    go by vec_id. Columns: query_id, rank (int, from 1), vec_id, score (long).

    Candidates stay where they are, unshuffled; queries pass over them in waves of bounded size. In
    each round of a wave every candidate is scored against every query, and each task counts
    all scores of a query's interval in 2 ** BITS bins. The summed histograms tell the bin that
    holds the k-th score, which is the next interval, until a bin is a single score. Scoring again
    costs less than keeping 8 bytes for each pair; unit vectors take two rounds. Then the scores
    at or above the k-th are read off, ties there cut to the k smallest ids of each task, and ranked.
    """
    candidates = vectors.select("vec_id", "q").where("vec_id IS NOT NULL")
    asked = cut(queries.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("q").alias("q")))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, wide, q_norm = asked.agg(F.count("*"), F.max(F.size("q")), F.max(norm)).first()
    c_norm = candidates.agg(F.max(norm)).first()[0]
    span = min(MOST, int((q_norm or 0.0) * (c_norm or 0.0) * 1.001) + 1)  # no |score| is above it
    waves = max(1, -(-n // min(WAVE_QUERIES, max(1, WAVE_BYTES // (8 * max(wide or 0, 1))))))
    return reduce(DataFrame.union, [_top(candidates, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w), k, span) for w in range(waves)])


def _top(candidates: DataFrame, asked: DataFrame, k: int, span: int) -> DataFrame:
    """Ranked candidates of one wave of queries."""
    context = candidates.sparkSession.sparkContext
    rows = asked.orderBy("vec_id").collect()  # at most about WAVE_QUERIES
    ids = np.array([r.vec_id for r in rows], np.int64)
    wave = Wave(ids, matrix(pa.array([r.q for r in rows], pa.list_(pa.int64()))), np.full(len(ids), -span), np.full(len(ids), k), QUERY_ROWS, CANDIDATE_ROWS)
    shift = (2 * span).bit_length()
    while shift:
        settled = min(BITS, shift)
        shift -= settled
        sent = context.broadcast(wave)
        counts = candidates.mapInArrow(_counter(sent, shift, settled), "query int, bin int, n long, need long")
        totals = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        down = Window.partitionBy("query").orderBy(F.col("bin").desc())
        above = totals.withColumn("above", F.sum("n").over(down) - F.col("n"))
        # The k-th score is in the highest bin that makes up the number; with fewer scores in all, in the lowest bin.
        hit = above.where(F.col("above") < F.col("need")).groupBy("query").agg(F.min("bin").alias("bin"), F.max("above").alias("above"))
        for r in hit.collect():  # a row per query of the wave
            wave.low[r.query] = int(wave.low[r.query]) + (r.bin << shift)
            wave.need[r.query] -= r.above
    best = candidates.mapInArrow(_reader(context.broadcast(wave), k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return cut(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _counter(sent, shift: int, settled: int):
    """Histograms of all scores in each query's interval, summed over the task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = sent.value
        bins = 1 << settled
        totals: dict[int, np.ndarray] = {}
        for at, _, s, counts in wave.blocks(batches):
            low = wave.low[at : at + len(s), None]
            place = (s.view(np.uint64) - low.view(np.uint64)) >> np.uint64(shift)  # wraps where s < low, which is left out
            place = np.where(counts, np.minimum(place, np.uint64(bins)), np.uint64(bins)).astype(np.int64)
            place += np.arange(len(s))[:, None] * (bins + 1)
            found = np.bincount(place.ravel(), minlength=len(s) * (bins + 1)).reshape(len(s), bins + 1)[:, :bins]
            totals[at] = totals[at] + found if at in totals else found
        for at, total in totals.items():
            q, cell = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"query": (at + q).astype(np.int32), "bin": cell.astype(np.int32), "n": total[q, cell].astype(np.int64), "need": wave.need[at + q]})

    return run


def _reader(sent, k: int):
    """Candidates at or above each query's k-th score, cut to the best k of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = sent.value
        parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for at, ids, s, counts in wave.blocks(batches):
            q, c = np.nonzero(counts)
            found = (q, ids[c], s[q, c])
            q, ids_, s_ = (np.concatenate(x) for x in zip(parts[at], found, strict=True)) if at in parts else found
            order = np.lexsort((ids_, -s_, q))
            q, ids_, s_ = q[order], ids_[order], s_[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            parts[at] = (q[keep], ids_[keep], s_[keep])
        for at, (q, ids_, s_) in parts.items():
            yield pa.RecordBatch.from_pydict({"query_id": wave.ids[at + q], "vec_id": ids_, "score": s_})

    return run
