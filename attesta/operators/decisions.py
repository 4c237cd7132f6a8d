"""Risk scores, verdicts and evidence fusion as column expressions over signal columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Detectors in their fixed order, and the weights of the passive ones.
DETECTORS = ("ela", "noise", "copy_move", "splicing", "content_alteration", "text_tampering", "stamp", "metadata")
WEIGHTS = {"ela": 0.12, "noise": 0.12, "stamp": 0.05, "metadata": 0.05}
#: Lowest score of each level, for document risk and for image evidence.
RISK_LEVELS = (("CRITICAL", 75), ("HIGH", 50), ("MEDIUM", 25))
IMAGE_LEVELS = (("CRITICAL", 80), ("HIGH", 60), ("MEDIUM", 35))
#: Points of a finding by severity, from the analysis and from validation.
ANALYSIS_POINTS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 2}
VALIDATION_POINTS = {"CRITICAL": 35, "HIGH": 20, "MEDIUM": 10}


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5).cast("int")


def level(score: Column, levels: tuple = RISK_LEVELS) -> Column:
    return reduce(lambda chain, l: chain.when(score >= l[1], l[0]), levels[1:], F.when(score >= levels[0][1], levels[0][0])).otherwise("LOW")


def points(severity: Column, table: dict[str, int]) -> Column:
    names = list(table)
    return reduce(lambda chain, n: chain.when(severity == n, table[n]), names[1:], F.when(severity == names[0], table[names[0]])).otherwise(0)


def risk_parts(tampering: Column, critical_mark: Column, finding_points: Column, invalid: Column, mismatch: Column, face: Column, liveness_failed: Column, document_type: Column, ocr: Column) -> Column:
    """The four parts of the score, the total and its level. A null ``tampering``, ``face`` or ``ocr`` means that the stage didn't run."""
    zero = F.lit(0)
    scaled = half_up(F.coalesce(tampering, F.lit(0.0)) * 40)
    tampered = F.when(tampering.isNull(), zero).when(critical_mark, F.greatest(scaled, F.lit(35))).otherwise(scaled)
    broken = invalid | mismatch
    validation = F.least(F.lit(45), F.when(broken, F.greatest(finding_points, F.lit(40))).otherwise(finding_points)).cast("int")
    biometric = (
        F.when(face.isNull(), zero)
        .when(liveness_failed | (face == "NO_MATCH"), 20)
        .when(face == "INCONCLUSIVE", 10)
        .when((face == "NO_FACE_DETECTED") & document_type.isin("PASSPORT", "NATIONAL_ID"), 12)
        .otherwise(0)
    )
    seen = F.when(ocr == 0, F.lit(0.95)).otherwise(ocr)
    quality = F.when(ocr.isNull(), 5).when(seen < 0.70, 10).when(seen < 0.85, 5).otherwise(0)
    total = F.least(F.lit(100), F.greatest(zero, tampered + validation + biometric + quality))
    total = F.when(broken, F.greatest(total, F.lit(55))).otherwise(total)
    return F.struct(tampered.alias("tampering"), validation.alias("validation"), biometric.alias("biometric"), quality.alias("quality"), total.alias("score"), level(total).alias("level"))


def verdict(score: Column, watchlist: Column, mismatch: Column, invalid: Column, tampered: Column, tampering: Column, face: Column, mode: str = "intended") -> Column:
    """PASSED, REVIEW_REQUIRED or REJECTED. In mode ``reference`` the score itself decides nothing."""
    uses = F.lit(mode != "reference")
    said = lambda c: F.coalesce(c, F.lit(False))
    reject = said(uses & (score >= 50)) | said(watchlist) | said(mismatch) | said(invalid) | said(tampered & (tampering >= 0.35)) | said(face == "NO_MATCH")
    review = said(uses & (score >= 25)) | said(face == "INCONCLUSIVE")
    return F.when(reject, "REJECTED").when(review, "REVIEW_REQUIRED").otherwise("PASSED")


def normalised(raw: Column) -> Column:
    """A score of 0..1 as 0..100, halves to even; null stays null."""
    return F.when(raw.isNotNull(), F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) * 100)).cast("int")  # greatest alone would take 0 for null


def severity(score: Column) -> Column:
    return F.when(score.isNull(), "UNKNOWN").when(score >= 60, "HIGH").when(score >= 35, "MEDIUM").otherwise("LOW")


def overall_score(scores: dict[str, Column], strong: Column, moderate: Column) -> Column:
    """Image evidence in one score: the strongest direct indicator, else a bounded mean of the passive detectors.

    ``scores`` are 0..100 or null by detector; ``strong`` and ``moderate`` count corroborated regions.
    """
    s = {k: F.coalesce(scores[k], F.lit(0)) for k in DETECTORS}
    lifted = lambda c, base, slope: F.lit(base) + slope * c
    both = F.greatest(s["ela"], s["noise"])
    direct = [F.when(s["copy_move"] >= 40, lifted(s["copy_move"], 72.0, 0.26)), F.when(s["stamp"] >= 70, lifted(s["stamp"], 68.0, 0.28))]
    direct += [F.when(s[k] >= 50, lifted(s[k], 68.0, 0.28)) for k in ("splicing", "content_alteration", "text_tampering", "ela")]
    direct += [
        F.when((s["ela"] >= 45) & (s["noise"] >= 45), lifted(both, 70.0, 0.25)),
        F.when(s["metadata"] >= 50, F.least(F.lit(55.0), 50.0 + 0.10 * (s["metadata"] - 50))),
        F.when(strong > 0, 75.0 + 10.0 * F.least(strong, F.lit(2))),
        F.when((moderate >= 2) & (s["ela"] >= 40) & (s["noise"] >= 40), lifted(both, 65.0, 0.20)),
    ]
    weight = reduce(lambda a, b: a + b, [F.when(scores[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()])
    mass = reduce(lambda a, b: a + b, [w * s[k] for k, w in WEIGHTS.items()])
    mean = F.when(weight > 0, mass / F.nullif(weight, F.lit(0.0))).otherwise(0.0)
    passive = F.when(moderate > 0, F.least(mean * 0.40 + 8.0 * moderate, F.lit(35.0))).when(s["text_tampering"] >= 35, F.least(F.lit(35.0), 20.0 + 0.35 * s["text_tampering"])).otherwise(F.least(mean * 0.35, F.lit(25.0)))
    best = F.coalesce(F.greatest(*direct), passive)
    return F.least(F.greatest(best, F.lit(0.0)), F.lit(100.0)).cast("int")


def conflict(scores: dict[str, Column]) -> Column:
    """Metadata and image detectors disagree strongly: METADATA, IMAGE or null."""
    image = F.array_compact(F.array(*[scores[k] for k in DETECTORS if k != "metadata"]))
    mean = F.aggregate(image, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(image), F.lit(0))
    meta = scores["metadata"]
    some = (F.size(image) > 0) & meta.isNotNull()
    return F.when(some & (meta >= 50) & (mean < 25), "METADATA").when(some & (mean >= 60) & (meta < 15), "IMAGE")


def evidence_strength(detectors: Column, copy_move: Column) -> Column:
    """By the number of detectors behind a region; copy-move alone counts as two."""
    return F.when(detectors >= 3, "STRONG").when(detectors >= 2, "MODERATE").when(detectors >= 1, F.when(copy_move, "MODERATE").otherwise("WEAK")).otherwise("NONE")
