"""Regions of a document's images against each other: overlaps, suppression, order, neighbours and text cues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Severities from weak to strong.
SEVERITIES = ("LOW", "MEDIUM", "HIGH")
#: Overlap of an anomaly that counts for a stamp; covered share that makes a stamp or a splice a repetition.
STAMP_OVERLAP, STAMP_COVERED, SPLICE_COVERED = 0.2, 0.8, 0.5
#: Smallest side and correlation of a cloned seal, and the score both get.
SEAL_SIDE, SEAL_ALIKE, SEAL_SCORE = 65, 0.70, 0.85

#: Gap in x that boxes of a text region leave at most; scores from which a region is HIGH or MEDIUM.
TEXT_GAP, TEXT_HIGH, TEXT_MEDIUM = 25, 0.65, 0.45


#: Boxes of an island of text boxes that is merged together with others.
ISLAND = 64


def severity_rank(severity: Column) -> Column:
    """1 to 3; 0 for any other value or null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)).cast("int")


def _shared(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes (x, y, w, h) share."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0)).cast("double")


def _box(of) -> dict[str, Column]:
    return {k: of[k] for k in "xywh"}


def overlap_ratio(a, b) -> Column:
    """Share of box ``b`` that box ``a`` covers; 0 for an empty ``b``. Boxes are structs or mappings with x, y, w and h."""
    area = b["w"] * b["h"]
    return F.coalesce(F.when(area > 0, _shared(_box(a), _box(b)) / area), F.lit(0.0))


def overlap_severity(stamps: DataFrame, anomalies: DataFrame, keys: list[str], least: float = STAMP_OVERLAP) -> DataFrame:
    """``stamps`` (keys, id, x, y, w, h) with the highest severity of the ``anomalies`` (keys, x, y, w, h, severity) they cover by more than ``least`` each; null without one.

    An anomaly of a severity that is none of the three counts only where no other does. Keys name the
    document and the page; regions of different ones don't meet. Null keys meet nothing.
    """
    other = anomalies.select(*keys, F.struct("x", "y", "w", "h").alias("__other"), F.struct(severity_rank(F.col("severity")).alias("r"), F.col("severity").alias("s")).alias("__severity"))
    met = stamps.select(*keys, "id", F.struct("x", "y", "w", "h").alias("__own")).join(other, keys)
    found = met.where(overlap_ratio(F.col("__own"), F.col("__other")) > least).groupBy(*keys, "id").agg(F.max("__severity")["s"].alias("severity"))
    return stamps.drop("severity").join(found, [*keys, "id"], "left")


def _append(kept: Column, r: Column) -> Column:
    return F.concat(kept, F.array(r))


def without_nested(regions: Column, covered: float = STAMP_COVERED) -> Column:
    """Of an array of regions (id, x, y, w, h, ...) those that no larger one kept before covers by more than ``covered``; largest first, equal ones by id."""
    n = lambda r: (-r["w"] * r["h"]).cast("double")
    order = F.array_sort(F.transform(regions, lambda r: F.struct(n(r).alias("k"), r["id"].alias("i"), r.alias("r"))))
    ordered = F.transform(order, lambda x: x["r"])
    none = F.filter(ordered, lambda r: F.lit(False))
    return F.aggregate(ordered, none, lambda kept, r: F.when(F.exists(kept, lambda k: overlap_ratio(k, r) > covered), kept).otherwise(_append(kept, r)))


def folded_splices(regions: Column, covered: float = SPLICE_COVERED) -> Column:
    """Of an array of regions (x, y, w, h, score, severity, ...), in its order, those that share no more than ``covered`` of the smaller box with one kept before.

    The first kept one that a dropped one meets takes over its score and severity where that score is higher. The result goes by falling score, equal ones in order.
    """
    meets = lambda k, r: _shared(_box(k), _box(r)) > covered * F.least(k["w"] * k["h"], r["w"] * r["h"])
    none = F.filter(regions, lambda r: F.lit(False))

    def add(kept: Column, r: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: meets(k, r)), F.lit(True))
        lift = lambda k, i: F.when((i + 1 == hit) & (r["score"] > k["score"]), k.withField("score", r["score"]).withField("severity", r["severity"])).otherwise(k)
        return F.when(hit == 0, _append(kept, r)).otherwise(F.transform(kept, lift))

    folded = F.aggregate(regions, none, add)
    order = F.array_sort(F.transform(folded, lambda r, i: F.struct((-r["score"]).alias("k"), i.alias("i"), r.alias("r"))))
    return F.transform(order, lambda x: x["r"])


def numbered(regions: Column) -> Column:
    """An array of regions (severity, detectors, signal, ...) in order of severity, number of detectors and strongest signal, highest first, with region_id R001, R002, ...; equal ones keep their order."""
    key = lambda r, i: F.struct((-severity_rank(r["severity"])).alias("s"), (-r["detectors"]).alias("d"), (-r["signal"]).alias("m"), i.alias("i"), r.alias("r"))
    return F.transform(F.array_sort(F.transform(regions, key)), lambda x, i: x["r"].withField("region_id", F.format_string("R%03d", i + 1)))


def cloned_seals(stamps: DataFrame, alike: DataFrame, keys: list[str]) -> DataFrame:
    """``stamps`` (keys, id, w, h, score, severity) after ``alike`` (keys, a, b, correlation): both of a pair of large, alike seals are HIGH, with a score of 0.85 at least, and point at each other.

    Adds target_id, null without a twin; of several twins the one of the largest (a, b) counts, as the last pair compared decides.
    """
    large = stamps.where((F.col("w") >= SEAL_SIDE) & (F.col("h") >= SEAL_SIDE)).select(*keys, "id")
    pairs = alike.where(F.col("correlation") >= SEAL_ALIKE).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = pairs.join(large.withColumnRenamed("id", "a"), [*keys, "a"], "left_semi").join(large.withColumnRenamed("id", "b"), [*keys, "b"], "left_semi")
    ends = pairs.select(*keys, F.col("a").alias("id"), F.struct("a", "b", F.col("b").alias("to")).alias("p")).union(pairs.select(*keys, F.col("b").alias("id"), F.struct("a", "b", F.col("a").alias("to")).alias("p")))
    twins = ends.groupBy(*keys, "id").agg(F.max("p")["to"].alias("target_id"))
    found = stamps.join(twins, [*keys, "id"], "left")
    has = F.col("target_id").isNotNull()
    return found.withColumn("score", F.when(has, F.greatest("score", F.lit(SEAL_SCORE))).otherwise(F.col("score"))).withColumn("severity", F.when(has, "HIGH").otherwise(F.col("severity")))


def text_neighbours(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` (keys, id, x, y, w, h, sharp, ela) with near_sharp and near_ela: medians over the box's neighbours, or over the document's larger boxes where it has none.

    Neighbours lie on the line (y closer than the height, 20 at least), within 220 in x, and are of similar
    height. Larger boxes are at least 20 wide and 10 high; a document without any takes all. Boxes
    meet by stripes of x, so a long document isn't held against itself whole.
    """
    stripe = F.floor(F.col("x") / 220)
    own = boxes.select(*keys, F.col("id").alias("__id"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("h").alias("__h"), F.explode(F.array(stripe - 1, stripe, stripe + 1)).alias("__stripe"))
    met = own.join(boxes.withColumn("__stripe", stripe), [*keys, "__stripe"])
    h = F.col("__h")
    near = (F.col("id") != F.col("__id")) & (F.abs(F.col("y") - F.col("__y")) < F.greatest(F.lit(20), h)) & (F.abs(F.col("x") - F.col("__x")) < 220) & (F.abs(F.col("h") - h) < F.greatest(F.lit(8.0), 0.4 * h))
    medians = lambda suffix: [F.expr(f"percentile({c}, 0.5)").alias(f"__{c}_{suffix}") for c in ("sharp", "ela")]
    beside = met.where(near).groupBy(*keys, F.col("__id").alias("id")).agg(*medians("near"))
    large = "w >= 20 AND h >= 10"
    whole = boxes.groupBy(*keys).agg(*[F.expr(f"coalesce(percentile(CASE WHEN {large} THEN {c} END, 0.5), percentile({c}, 0.5))").alias(f"__{c}_all") for c in ("sharp", "ela")])
    found = boxes.join(beside, [*keys, "id"], "left").join(whole, keys)
    return found.select(*boxes.columns, F.coalesce("__sharp_near", "__sharp_all").alias("near_sharp"), F.coalesce("__ela_near", "__ela_all").alias("near_ela"), F.col("__sharp_near").isNotNull().alias("has_neighbours"))


def _cues(f: dict[str, Column]) -> list[tuple[Column, Column]]:
    """The five cues of a text box, each as its condition and its uncapped score. The numbers are fixed values."""
    noisy, void, gap, step, std = f["noisy"], f["void"], f["background_gap"], f["background_step"], f["background_std"]
    ela, apart, w, h = f["ela"], F.abs(f["ela"] - f["near_ela"]), f["w"], f["h"]
    return [
        (noisy & ((void >= 0.50) | ((void >= 0.40) & (gap >= 3.0))) & (std < 3.5), 0.45 + 0.55 * void),
        (((f["ela_gap"] >= 1.6) & (ela >= 7.0) & (apart >= 3.5)) | ((ela >= 10.0) & (f["ela_gap"] >= 1.8)), 0.45 + 0.35 * f["ela_gap"]),
        ((f["sharp_gap"] >= 0.55) & ((f["sharp"] > 40.0) | (f["near_sharp"] > 40.0)) & ((ela >= 5.0) | (void >= 0.30) | (gap >= 3.5)), 0.35 + 0.45 * f["sharp_gap"]),
        ((step >= 3.0) & noisy & (w >= 35) & (h >= 15) & (f["background_pixels"] >= 60), 0.40 + 0.10 * step),
        ((f["border"] > 160.0) & (w >= 30) & (h >= 16) & (f["background_pixels"] >= 35) & (gap >= 3.0), f["border"] / 400.0),
    ]


def cue_score(f: dict[str, Column]) -> Column:
    """Score of a text box from its cues, null where they don't suffice.

    ``f`` has noisy (the document's paper has noise), void, background_gap (absolute), background_step, background_std, paper_std,
    background_pixels, ela, near_ela, ela_gap, sharp, near_sharp, sharp_gap, border, w and h. The numbers are fixed values.
    """
    noisy, void, gap, step, std = f["noisy"], f["void"], f["background_gap"], f["background_step"], f["background_std"]
    ela, apart, w, h = f["ela"], F.abs(f["ela"] - f["near_ela"]), f["w"], f["h"]
    capped = lambda x: F.least(F.lit(1.0), x)
    scores = F.filter(F.array(*[F.when(on, capped(x)) for on, x in _cues(f)]), lambda x: x.isNotNull())
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    strong = noisy & ((void >= 0.55) | ((void >= 0.45) & (gap >= 3.0))) & (std < 3.2)
    anomaly = noisy & (ela >= 14.0) & (f["ela_gap"] >= 2.5) & (apart >= 8.0) & (w >= 30) & (h >= 14)
    patch = noisy & (step >= 4.0) & (w >= 40) & (h >= 16) & (std <= f["paper_std"])
    several = (n >= 2) & ((void >= 0.40) | (gap >= 3.0) | (noisy & (f["ela_gap"] >= 1.5) & (ela >= 6.0)))
    base = F.when(n > 0, mean).otherwise(0.70)
    score = F.when(n >= 2, capped(base + 0.12 * (n - 1))).when(strong, capped(0.45 + 0.55 * void)).when(patch, capped(0.50 + 0.10 * step)).otherwise(base)
    return F.when(strong | anomaly | patch | several, score)


def cue_reasons(f: dict[str, Column]) -> Column:
    """The sentences of the cues that ``cue_score`` counts, in its order; empty where none holds.

    ``f`` is that of ``cue_score`` with paper_mean and background_mean besides. Numbers are rounded half to
    even in their shortest decimal form. A cue with a null feature doesn't hold. The sentences are fixed values.
    """
    n = lambda x, digits: F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits))
    held = [
        F.concat(F.lit("Substrate noise void around text (void: "), n(f["void"] * 100, 0), F.lit("%, local bg std: "), n(f["background_std"], 2), F.lit(" vs doc: "), n(f["paper_std"], 2), F.lit(")")),
        F.concat(F.lit("Local ELA compression disparity ("), n(f["ela_gap"], 2), F.lit("x relative to neighboring text)")),
        F.concat(F.lit("Stroke rendering disparity ("), n(f["sharp_gap"], 2), F.lit("x relative to neighboring text)")),
        F.concat(F.lit("Substrate brightness step in text patch ("), n(f["background_mean"], 1), F.lit(" vs doc: "), n(f["paper_mean"], 1), F.lit(")")),
        F.concat(F.lit("Paste / erasure perimeter boundary step ("), n(f["border"], 1), F.lit(")")),
    ]
    return F.filter(F.array(*[F.when(on, text) for (on, _), text in zip(_cues(f), held, strict=True)]), lambda x: x.isNotNull())


def _touches(c: list, x: float, y: float, w: float, h: float) -> bool:
    return abs(y - c[1]) < max(h, c[3]) and x <= c[0] + c[2] + TEXT_GAP and c[0] <= x + w + TEXT_GAP


def _joined(begin: np.ndarray, n: np.ndarray, box: list[np.ndarray]) -> np.ndarray:
    """For each box (x, y, w, h) the place of the first box of its region, of islands that begin at ``begin`` and hold ``n`` boxes, all islands a box at a time."""
    at = np.arange(len(box[0]))
    region = at.copy()
    own = [c.copy() for c in box]  # at a region's first box: the region as it has grown
    for k in range(1, int(n.max(initial=0))):
        some = begin[n > k]
        new = some + k
        x, y, w, h = (c[new] for c in box)
        open_ = np.arange(len(new))
        for r in range(k):
            c = some[open_] + r
            left, top, wide, high = (o[c] for o in own)
            i = open_
            hit = (region[c] == c) & (np.abs(y[i] - top) < np.maximum(h[i], high)) & (x[i] <= left + wide + TEXT_GAP) & (left <= x[i] + w[i] + TEXT_GAP)
            i, c, left, top, wide, high = i[hit], c[hit], left[hit], top[hit], wide[hit], high[hit]
            region[new[i]] = c
            own[0][c], own[1][c] = np.minimum(x[i], left), np.minimum(y[i], top)
            own[2][c], own[3][c] = np.maximum(x[i] + w[i], left + wide) - own[0][c], np.maximum(y[i] + h[i], top + high) - own[1][c]
            open_ = open_[~hit]
            if not len(open_):
                break
    for c, o in zip(box, own, strict=True):
        c[:] = o
    return region


def _whole(batch: pa.RecordBatch, begin: np.ndarray, n: np.ndarray, keys: int, schema: pa.Schema) -> pa.RecordBatch:
    """Regions of whole islands, which follow each other in ``batch``."""
    box = [c.to_numpy(zero_copy_only=False).copy() for c in batch.columns[keys + 2 : keys + 6]]
    region = _joined(begin, n, box)
    first = np.flatnonzero(region == np.arange(len(region)))
    place = np.searchsorted(first, region)
    score = np.full(len(first), -np.inf)
    np.maximum.at(score, place, batch.column(keys + 6).to_numpy(zero_copy_only=False))
    reasons = batch.column(keys + 7)
    words = reasons.flatten().dictionary_encode()
    owner = np.repeat(place, reasons.value_lengths().to_numpy(zero_copy_only=False))
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, kept = np.unique(owner * max(len(words.dictionary), 1) + code, return_index=True)
    kept = np.sort(kept)
    kept = kept[np.argsort(owner[kept], kind="stable")]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[kept], np.arange(len(first) + 1)), pa.int32()), words.dictionary.take(pa.array(code[kept])))
    head = batch.take(pa.array(first))
    columns = [*head.columns[:keys], head.column(keys + 1), *(pa.array(c[first]) for c in box), pa.array(score), lists, pa.array(np.bincount(place, minlength=len(first)), pa.int64())]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _islands(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where islands begin in ``batch``, its end as well."""
    n = batch.num_rows
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = False
        for c in batch.columns[: keys + 1]:
            a, b = c.slice(1), c.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
            new[1:n] |= differs
    return np.flatnonzero(new)


def _merge(batches: Iterator[pa.RecordBatch], keys: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Regions of rows that come by keys, island and id; held are a batch and the regions of the open island only.

    Islands of up to ISLAND boxes with finite numbers that lie in a batch whole are merged together, others box by box.
    """
    at, regions = None, []

    def closed() -> pa.RecordBatch:
        rows = [[*at[:keys], r[5], *r[:5], list(r[6]), r[7]] for r in regions]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def by_box(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal at, regions
        for *place, box_id, x, y, w, h, score, reasons in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != at:
                if regions:
                    yield closed()
                at, regions = place, []
            r = next((r for r in regions if _touches(r, x, y, w, h)), None)
            if r is None:
                regions.append([x, y, w, h, score, box_id, dict.fromkeys(reasons), 1])
                continue
            left, top = min(x, r[0]), min(y, r[1])
            right, bottom = max(x + w, r[0] + r[2]), max(y + h, r[1] + r[3])
            r[:5] = left, top, right - left, bottom - top, max(score, r[4])
            r[6].update(dict.fromkeys(reasons))
            r[7] += 1

    for batch in batches:
        ends = _islands(batch, keys)
        begin, n = ends[:-1], np.diff(ends)
        # The first island may have begun before, the last may go on. Numbers that are none are left to Python's comparisons.
        odd = np.zeros(batch.num_rows, bool)
        for c in batch.columns[keys + 2 : keys + 7]:
            odd |= ~np.isfinite(c.to_numpy(zero_copy_only=False))
        alone = (n <= ISLAND) & (np.add.reduceat(odd, begin) == 0) if len(begin) else n > 0
        alone[:1] = alone[-1:] = False
        yield from by_box(batch.take(pa.array(np.flatnonzero(np.repeat(~alone, n)))))
        if alone.any():
            rows = np.flatnonzero(np.repeat(alone, n))
            small = n[alone]
            yield _whole(batch.take(pa.array(rows)), np.cumsum(small) - small, small, keys, schema)
    if regions:
        yield closed()


def merged_text_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Text regions of ``boxes`` (keys, id, x, y, w, h, score, reasons): each box, by id, joins the first region that it touches, which grows by it, or begins one.

    A box touches a region whose top is nearer to its own than the larger height, with a gap in x of TEXT_GAP at
    most. One row per region: keys, id (of its first box), x, y, w, h, score (the highest), reasons (distinct, in
    order of appearance), n_boxes and severity. Boxes without id, place or with negative sides are left
    out; a null score is 0, null reasons are none; null keys are a document of their own. Boxes of one id go by place, score and reasons.

    Regions only grow over boxes within the gap, so boxes beyond a wider empty stripe of x never meet: a
    running maximum cuts each document into islands, and a task reads them in turn, holding one
    island's regions. One shuffle by the keys; a document's rows are sorted, never gathered.
    """
    kinds = dict(boxes.dtypes)
    number = {c: F.col(c).cast("double") for c in "xywh"}
    whole = F.col("id").isNotNull() & (number["x"] + number["y"]).isNotNull() & (number["w"] >= 0) & (number["h"] >= 0)
    plain = F.coalesce(F.filter("reasons", lambda r: r.isNotNull()), F.array().cast("array<string>"))
    rows = boxes.where(whole).select(*keys, "id", *[number[c].alias(c) for c in "xywh"], F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), plain.alias("reasons"))
    by_x = Window.partitionBy(*keys).orderBy("x", "id")
    before = F.max(F.col("x") + F.col("w")).over(by_x.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("__begins", F.when(before.isNull() | (F.col("x") > before + TEXT_GAP), 1).otherwise(0))
    placed = begins.select(*keys, F.sum("__begins").over(by_x.rowsBetween(Window.unboundedPreceding, 0)).alias("__island"), "id", "x", "y", "w", "h", "score", "reasons")
    fields = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"id {kinds['id']}", *[f"{c} double" for c in ("x", "y", "w", "h", "score")], "reasons array<string>", "n_boxes long"])
    schema = to_arrow_schema(boxes.sparkSession.createDataFrame([], fields).schema)
    count = len(keys)
    merged = placed.sortWithinPartitions(*keys, "__island", "id", "x", "y", "w", "h", "score", "reasons").mapInArrow(lambda batches: _merge(batches, count, schema), fields)
    return merged.withColumn("severity", F.when(F.col("score") >= TEXT_HIGH, "HIGH").when(F.col("score") >= TEXT_MEDIUM, "MEDIUM").otherwise("LOW"))


def text_signal(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Signal of each document of ``regions`` (keys, score): 0.75 of the highest score and, with several regions, 0.25 of the mean of the three highest, within 0 and 1."""
    ranked = regions.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score")))).where("__r <= 3")
    several = F.when(F.count("*") > 1, 0.25 * F.avg("score")).otherwise(0.0)
    return ranked.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.75 * F.max("score") + several)).alias("signal"))
