"""Evidence of independent detectors on the same places of a page: correlated regions, attribution to localised regions, and fusion into one verdict."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators import decisions as D
from attesta.operators.geometry import CONTAINMENT, IOU, iou, overlapping_pairs, page_boxes, page_pairs, rooted, smaller_overlap, split_pages
from attesta.operators.regions import severity_rank

#: Score of a region without one, score from which a detector supports a region, and copy-move's that counts as two detectors.
ASSUMED, SUPPORT, PRECISE = 0.5, 0.30, 0.40
#: Points of a strong and a moderate region with their caps, and the share of the highest signal that is the least bonus.
STRONG_POINTS, STRONG_CAP, MODERATE_POINTS, MODERATE_CAP, SIGNAL_SHARE = 25, 60, 12, 30, 0.60
#: How each detector is named in explanations, in order.
LABELS = {
    "ela": "compression inconsistency (ELA)", "noise": "local noise anomaly", "copy_move": "visual content duplication (copy-move)", "splicing": "image splicing / insertion anomaly",
    "content_alteration": "content alteration / defacement anomaly", "text_tampering": "text modification / insertion anomaly", "stamp": "stamp region anomaly", "metadata": "image-processing metadata signature",
}
#: Sentences.
DUPLICATED = "Visual content appears to have been duplicated within the document (copy-move geometric evidence)."
STRONG_SAID = " with strong multi-signal forensic corroboration detected — multiple independent detectors agree on the same physical area."
MODERATE_SAID = " with moderate cross-signal evidence detected."
CONFLICTS = {
    "METADATA": "Metadata indicates prior image processing, but image-based forensic detectors found limited supporting evidence. Manual review recommended.",
    "IMAGE": "Strong image-forensic evidence was detected, but metadata appears clean. This may indicate metadata was stripped or edited after tampering.",
}
ASSESSMENTS = {
    "CRITICAL": "Overall tampering evidence is very strong. Immediate manual document review is strongly recommended.",
    "HIGH": "Significant tampering evidence was found. Manual document review is recommended.",
    "MEDIUM": "Moderate tampering indicators were detected. Consider additional verification before accepting this document.",
    "LOW": "Forensic analysis found limited tampering evidence. The document appears consistent under current detection methods.",
}
UNSUPPORTED = "Low-level forensic indicator; no multi-signal corroboration."
_BOX = ("x", "y", "w", "h")


def joined(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(items, F.lit(-1))))


def corroborated(strength: Column, best: Column) -> Column:
    """Severity of a region by the strength of its evidence and its highest signal (0..100)."""
    return F.when(strength == "STRONG", "HIGH").when(strength == "MODERATE", F.when(best >= 70, "HIGH").otherwise("MEDIUM")).when((strength == "WEAK") & (best >= 75), "MEDIUM").otherwise("LOW")


def region_reason(region_id: Column, supporting: Column) -> Column:
    """Why a region is suspicious, from the upper-case names of the detectors behind it."""
    n = F.size(supporting)
    several = F.concat(F.lit("Region "), region_id, F.lit(" is suspicious because "), joined(supporting), F.lit(" independently detected anomalies in the same area."))
    single = F.concat(F.lit("Single forensic indicator ("), F.array_join(supporting, ""), F.lit(") flags this region as suspicious."))
    return F.when(n >= 2, several).when(n == 1, single).otherwise(UNSUPPORTED)


def _numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with region_id R001, R002, ... in order within ``by``."""
    return rows.withColumn("region_id", F.format_string("R%03d", F.row_number().over(Window.partitionBy(*by).orderBy(*order))))


def correlated_regions(regions: DataFrame, document: str, page: str, iou_threshold: float = IOU, support: float = SUPPORT) -> DataFrame:
    """Regions of all detectors that lie on each other, as one region each.

    ``regions`` holds the document, the page, id (long, the order of detection within the document), detector, score, x, y, w, h (whole numbers) and the box
    target_x, target_y, target_w, target_h that a copy points at (null for others). Regions of a page hang together through chains of pairs whose intersection is at least ``iou_threshold`` of
    their union, or that and at least CONTAINMENT of the smaller one. A region without a score has ASSUMED, one without a page is on page 1.

    One row per group: document, page, region_id (numbered in a document by severity, number of supporting detectors and highest signal, all descending, then by
    first region), the box around it, severity, evidence_strength, detector_count, supporting_detectors (upper case, in order of appearance; a detector supports with
    ``support`` or more), signals (array of detector, signal: its highest score, and score: that as 0..100; negative scores don't count), reason, the target box of the first region with one, and n_regions.
    Rows without document or id are left out. No page or group has to fit a task.
    """
    known = regions.where(F.col(document).isNotNull() & F.col("id").isNotNull())
    rows = known.select(document, F.coalesce(page, F.lit(1)).alias(page), F.col("id").cast("long").alias("id"), F.lower("detector").alias("detector"), F.coalesce(F.col("score").cast("double"), F.lit(ASSUMED)).alias("score"), *_BOX, F.when(F.col("target_x").isNotNull(), F.struct(*(f"target_{c}" for c in _BOX))).alias("target"))
    keys = [document, page]
    near = (iou("a_", "b_") >= iou_threshold) | (smaller_overlap("a_", "b_") >= max(iou_threshold, CONTAINMENT))
    met = lambda shared, s, t: (shared / (s + t - shared) >= iou_threshold) | (shared / np.minimum(s, t) >= max(iou_threshold, CONTAINMENT))
    grouped = rooted(rows, keys, met, near)
    counted = F.col("score") >= 0
    each = grouped.groupBy(*keys, "root", "detector").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count("*").alias("n"),
        F.min(F.when(counted, F.col("id"))).alias("first"), F.round(F.max(F.when(counted, F.col("score"))), 4).alias("signal"), F.min(F.when(F.col("target").isNotNull(), F.struct("id", "target"))).alias("target"),
    )
    signal = F.when(F.col("signal").isNotNull(), F.struct("first", "detector", "signal", D.normalised(F.col("signal")).alias("score")))
    groups = each.groupBy(*keys, "root").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.sum("n").alias("n_regions"), F.min("target")["target"].alias("target"), F.array_sort(F.collect_list(signal)).alias("found"))
    backing = F.filter("found", lambda s: s["signal"] >= support)
    precise = F.exists(backing, lambda s: (s["detector"] == "copy_move") & (s["signal"] >= PRECISE))
    top = lambda c: F.coalesce(F.array_max(F.transform("found", lambda s: s[c])), F.lit(0))
    told = groups.withColumn("supporting_detectors", F.transform(backing, lambda s: F.upper(s["detector"]))).withColumn("evidence_strength", D.evidence_strength(F.size(backing), precise))
    told = told.withColumn("severity", corroborated(F.col("evidence_strength"), top("score"))).withColumn("detector_count", F.size("supporting_detectors"))
    placed = _numbered(told, [document], [severity_rank(F.col("severity")).desc(), F.col("detector_count").desc(), top("signal").desc(), F.col("root")])
    return placed.select(
        *keys, "region_id", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "severity", "evidence_strength", "detector_count", "supporting_detectors",
        F.transform("found", lambda s: s.dropFields("first")).alias("signals"), region_reason(F.col("region_id"), F.col("supporting_detectors")).alias("reason"), *(F.col("target")[f"target_{c}"].alias(f"target_{c}") for c in _BOX), "n_regions",
    )


def _backed(iou_threshold: float):
    @F.arrow_udf("array<struct<nr:int,found:array<struct<place:int,raw:double>>>>")
    def backed(ids: pa.Array, localised: pa.Array, place: pa.Array, score: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        lengths, (kind, *box) = page_boxes(place, x, y, w, h)
        own = localised.flatten().to_numpy(zero_copy_only=False).astype(bool)
        page = np.repeat(np.arange(len(lengths)), lengths)
        # Localised regions in order, and what stands for each id of a page; the last code is that of other boxes.
        number = ids.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(own)
        rows = rows[np.lexsort((number[rows], page[rows]))]
        nr = np.zeros(len(own), np.int32)
        nr[rows] = np.arange(len(rows)) - np.searchsorted(page[rows], page[rows]) + 1
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(number[rows]) != 0) | (np.diff(page[rows]) != 0)
        code = np.full(len(own), new.sum())
        code[rows] = np.cumsum(new) - 1
        alone = np.flatnonzero(own & (kind > 0) & (box[2] > 0) & (box[3] > 0) & (iou_threshold <= 1))
        ends = [np.stack([alone, alone])]
        for a, b, shared, s, t in page_pairs(lengths, box):
            near = shared / (s + t - shared) >= iou_threshold
            for region, mark in ((a[near], b[near]), (b[near], a[near])):
                ends.append(np.stack([region, mark])[:, own[region] & (kind[mark] > 0)])
        at, mark = np.concatenate(ends, 1)
        at, detector = code[at], kind[mark]
        raw = np.maximum(score.flatten().fill_null(-np.inf).to_numpy(zero_copy_only=False)[mark], 0.0)
        order = np.lexsort((raw, detector, at))
        at, detector, raw = at[order], detector[order], raw[order]
        last = np.ones(len(at), bool)  # the highest score of each detector on a region
        last[:-1] = (at[1:] != at[:-1]) | (detector[1:] != detector[:-1])
        found = pa.StructArray.from_arrays([pa.array(detector[last], pa.int32()), pa.array(raw[last], pa.float64())], ["place", "raw"])
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[last], np.arange(new.sum() + 2)), pa.int32()), found).take(pa.array(code))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.StructArray.from_arrays([pa.array(nr), found], ["nr", "found"]))

    return backed


def _met_by_grid(boxes: DataFrame, keys: list[str], iou_threshold: float) -> DataFrame:
    """The localised ``boxes`` of crowded pages with nr and found, as ``_backed`` gives them."""
    own, marks = boxes.where("localised"), boxes.where("place > 0")
    # Both kinds meet as one set of boxes; what a box is travels in its id, and localised ones sort first.
    tagged = lambda rows, nr, place, score: rows.select(*keys, F.struct(nr.isNull().alias("detected"), nr.alias("nr"), place.alias("place"), score.alias("score")).alias("id"), *_BOX)
    both = tagged(own, F.col("id"), F.lit(None).cast("int"), F.lit(None).cast("double")).union(tagged(marks, F.lit(None).cast("long"), F.col("place"), F.col("score")))
    pairs = overlapping_pairs(both, keys, ~F.col("a_id.detected") & F.col("b_id.detected") & (iou("a_", "b_") >= iou_threshold))
    backing = pairs.select(*keys, F.col("a_id.nr").alias("id"), "b_id.place", "b_id.score").groupBy(*keys, "id", "place").agg(F.greatest(F.lit(0.0), F.max("score")).alias("raw"))
    found = backing.groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("place", "raw"))).alias("found"))
    told = own.join(found, [*keys, "id"], "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    return told.withColumn("nr", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))


def fused_regions(localised: DataFrame, detected: DataFrame, document: str, page: str, iou_threshold: float = IOU) -> DataFrame:
    """``localised`` regions with the detectors whose own regions lie on them, as ``backed_regions`` tells it of one table.

    ``localised`` holds document, page, id (long, their order), x, y, w, h and target_x, target_y, target_w, target_h; ``detected`` document, page, detector, score and x, y, w, h; boxes in whole numbers.
    """
    targets = [f"target_{c}" for c in _BOX]
    own = localised.select(document, page, "id", F.lit(None).cast("string").alias("detector"), F.lit(None).cast("double").alias("score"), *_BOX, *targets, F.lit(True).alias("localised"))
    marks = detected.select(document, page, F.lit(None).cast("long").alias("id"), "detector", F.col("score").cast("double").alias("score"), *_BOX, *(F.lit(None).cast(localised.schema[c].dataType).alias(c) for c in targets), F.lit(False).alias("localised"))
    return backed_regions(own.union(marks), document, page, iou_threshold)


def backed_regions(boxes: DataFrame, document: str, page: str, iou_threshold: float = IOU) -> DataFrame:
    """The localised of ``boxes`` with the detectors whose boxes lie on them; a box may be both.

    ``boxes`` holds document, page, id (long, their order), detector, score, x, y, w, h, target_x, target_y, target_w, target_h and localised (boolean); boxes in whole numbers. A
    detector backs a region with the highest score (0 at least) of its boxes whose intersection is ``iou_threshold`` of the union or more. Columns: document, page, region_id (numbered by id on a page), the box, severity,
    evidence_strength (copy-move alone is MODERATE), detector_count, supporting_signals (upper case, in the detectors' order), signals (array of detector, signal, score), reason
    and the target box. Regions without document, page or id are left out; those nothing lies on stay, as LOW.

    Pages of up to PAGE boxes are a row each, where the keys, or some of them, have dealt them to; larger ones meet through grid cells.
    """
    keys = [document, page]
    place = F.coalesce(F.array_position(F.array(*map(F.lit, D.DETECTORS)), F.lower("detector")), F.lit(0)).cast("int")
    own = F.coalesce("localised", F.lit(False)) & F.col("id").isNotNull()
    targets = [f"target_{c}" for c in _BOX]
    known = boxes.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    rows = known.select(*keys, F.col("id").cast("long").alias("id"), own.alias("localised"), place.alias("place"), F.col("score").cast("double").alias("score"), *_BOX, *targets).where("localised OR place > 0")
    small, crowded = split_pages(rows, keys)
    pages = small.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])).alias("__rows"))
    parts = [F.col(f"__rows.{c}") for c in ("id", "localised", "place", "score")] + [F.transform(F.col(f"__rows.{c}"), lambda v: v.cast("long")) for c in _BOX]
    flat = pages.withColumn("__told", _backed(iou_threshold)(*parts)).select(*keys, F.explode(F.arrays_zip("__rows", "__told")).alias("__r")).where("__r.__rows.localised")
    told = flat.select(*keys, *[F.col(f"__r.__rows.{c}").alias(c) for c in (*_BOX, *targets)], "__r.__told.nr", "__r.__told.found")
    if crowded is not None:
        told = told.union(_met_by_grid(crowded, keys, iou_threshold).select(*told.columns))
    names = F.array(*map(F.lit, D.DETECTORS))
    told = told.withColumn("found", F.transform("found", lambda s: F.struct(F.element_at(names, s["place"]).alias("detector"), F.round(s["raw"], 4).alias("signal"), D.normalised(s["raw"]).alias("score"))))
    told = told.withColumn("supporting_signals", F.transform("found", lambda s: F.upper(s["detector"]))).withColumn("region_id", F.format_string("R%03d", "nr"))
    told = told.withColumn("evidence_strength", D.evidence_strength(F.size("found"), F.exists("found", lambda s: s["detector"] == "copy_move")))
    best = F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0))
    return told.select(
        *keys, "region_id", *_BOX, corroborated(F.col("evidence_strength"), best).alias("severity"), "evidence_strength", F.size("found").alias("detector_count"), "supporting_signals", F.col("found").alias("signals"),
        region_reason(F.col("region_id"), F.col("supporting_signals")).alias("reason"), *targets,
    )


def region_bonus(strong: Column, moderate: Column, best: Column) -> Column:
    """Points for regions that several detectors agree on; at least a share of the highest signal (0..100) on a region."""
    counted = F.least(strong * STRONG_POINTS, F.lit(STRONG_CAP)) + F.least(moderate * MODERATE_POINTS, F.lit(MODERATE_CAP))
    return F.least(F.lit(100), F.greatest(counted, F.floor(best * SIGNAL_SHARE))).cast("int")


def explanations(scores: dict[str, Column], strong: Column, moderate: Column, conflict: Column, level: Column) -> Column:
    """Sentences on what was found, in order: strong and moderate detectors, copy-move, regions by strength, conflict (METADATA, IMAGE or null), overall level."""
    named = lambda test: F.array_compact(F.array(*[F.when(test(scores[k]), label) for k, label in LABELS.items()]))
    high, medium = named(lambda s: s >= 60), named(lambda s: (s >= 35) & (s < 60))
    said = lambda names, word: F.when(F.size(names) > 0, F.concat(F.lit(f"{word} "), joined(names), F.lit(" detected.")))
    regions = lambda n, rest: F.when(n > 0, F.concat(n.cast("string"), F.when(n > 1, " regions").otherwise(" region"), F.lit(rest)))
    chosen = lambda key, table: reduce(lambda c, k: c.when(key == k, table[k]), table, F)
    return F.array_compact(F.array(said(high, "Strong"), said(medium, "Moderate"), F.when(scores["copy_move"] >= 40, DUPLICATED), regions(strong, STRONG_SAID), regions(moderate, MODERATE_SAID), chosen(conflict, CONFLICTS), chosen(level, ASSESSMENTS)))


def fused(signals: DataFrame, regions: DataFrame, document: str, page: str) -> DataFrame:
    """One row per document and page of ``signals``: what all detectors say together.

    ``signals`` holds document, page, detector, available (boolean) and score (0..1 or null); ``regions`` are ``fused_regions``. Detectors without a row, or
    whose row is not available, are unavailable; one that is available may have no score. Of repeated rows of a detector an available one counts, of several the highest score.
    Columns: overall_score, overall_level, region_bonus, strong, moderate, conflict_detected, conflict_note, explanations, detectors_available,
    detectors_unavailable and scores (array of detector, score: 0..100 or null, severity) in the detectors' order. Rows without document or page are left out.
    """
    keys = [document, page]
    on = F.coalesce("available", F.lit(False))
    rows = signals.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    per = rows.groupBy(*keys).agg(*[F.max(F.when(F.lower("detector") == k, on)).alias(f"{k}_on") for k in D.DETECTORS], *[D.normalised(F.max(F.when((F.lower("detector") == k) & on, F.col("score")))).alias(k) for k in D.DETECTORS])
    counted = regions.groupBy(*keys).agg(F.count_if(F.col("evidence_strength") == "STRONG").cast("int").alias("strong"), F.count_if(F.col("evidence_strength") == "MODERATE").cast("int").alias("moderate"), F.max(F.array_max(F.transform("signals", lambda s: s["score"]))).alias("best"))
    both = per.join(counted, keys, "left").fillna(0, ["strong", "moderate", "best"])
    scores = {k: F.col(k) for k in D.DETECTORS}
    strong, moderate = F.col("strong"), F.col("moderate")
    judged = both.withColumn("overall_score", D.overall_score(scores, strong, moderate)).withColumn("conflict", D.conflict(scores))
    judged = judged.withColumn("overall_level", D.level(F.col("overall_score"), D.IMAGE_LEVELS))
    running = lambda k: F.coalesce(F.col(f"{k}_on"), F.lit(False))
    names = lambda test: F.array_compact(F.array(*[F.when(test(k), k) for k in D.DETECTORS]))
    note = reduce(lambda c, k: c.when(F.col("conflict") == k, CONFLICTS[k]), CONFLICTS, F)
    return judged.select(
        *keys, "overall_score", "overall_level", region_bonus(strong, moderate, F.col("best")).alias("region_bonus"), "strong", "moderate", F.col("conflict").isNotNull().alias("conflict_detected"), note.alias("conflict_note"),
        explanations(scores, strong, moderate, F.col("conflict"), F.col("overall_level")).alias("explanations"), names(running).alias("detectors_available"), names(lambda k: ~running(k)).alias("detectors_unavailable"),
        F.array(*[F.struct(F.lit(k).alias("detector"), F.col(k).alias("score"), F.when(running(k), D.severity(F.col(k))).alias("severity")) for k in D.DETECTORS]).alias("scores"),
    )
