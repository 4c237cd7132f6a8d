"""Risk, verdict and image-evidence queries over signals derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import decisions as D
from attesta.plans import query

#: One row per order: stand-ins for the stage results of a document. The same text runs in both engines.
SIGNALS = """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS tampering,
    o_orderkey % 13 = 0 AS critical_mark, CAST(o_orderkey % 6 * 8 AS INT) AS finding_points, o_orderkey % 17 = 0 AS invalid, o_orderkey % 19 = 0 AS mismatch,
    CASE o_orderkey % 6 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'NO_MATCH' WHEN 2 THEN 'INCONCLUSIVE' WHEN 3 THEN 'NO_FACE_DETECTED' WHEN 4 THEN 'MATCH' END AS face,
    o_orderkey % 23 = 0 AS liveness_failed, CASE WHEN o_orderkey % 2 = 0 THEN 'PASSPORT' ELSE 'VISA' END AS document_type,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS ocr, o_orderkey % 29 = 0 AS watchlist, o_orderkey % 5 = 0 AS tampered
    FROM {orders}"""

_PARTS = f"""WITH s AS ({SIGNALS.format(orders='orders')}), p AS (SELECT *,
    CASE WHEN tampering IS NULL THEN 0 WHEN critical_mark THEN greatest(CAST(floor(tampering * 40 + 0.5) AS INT), 35) ELSE CAST(floor(tampering * 40 + 0.5) AS INT) END AS t,
    least(45, CASE WHEN invalid OR mismatch THEN greatest(finding_points, 40) ELSE finding_points END) AS v,
    CASE WHEN face IS NULL THEN 0 WHEN liveness_failed OR face = 'NO_MATCH' THEN 20 WHEN face = 'INCONCLUSIVE' THEN 10 WHEN face = 'NO_FACE_DETECTED' AND document_type = 'PASSPORT' THEN 12 ELSE 0 END AS b,
    CASE WHEN ocr IS NULL THEN 5 WHEN ocr = 0 THEN 0 WHEN ocr < 0.70 THEN 10 WHEN ocr < 0.85 THEN 5 ELSE 0 END AS q FROM s),
    r AS (SELECT *, CASE WHEN invalid OR mismatch THEN greatest(least(100, t + v + b + q), 55) ELSE least(100, t + v + b + q) END AS score FROM p)"""


def _signals(t):
    orders = t("orders")
    orders.createOrReplaceTempView("__signal_orders")
    return orders.sparkSession.sql(SIGNALS.format(orders="__signal_orders"))


def _scored(t):
    c = F.col
    parts = D.risk_parts(c("tampering"), c("critical_mark"), c("finding_points"), c("invalid"), c("mismatch"), c("face"), c("liveness_failed"), c("document_type"), c("ocr"))
    return _signals(t).withColumn("risk", parts)


@query("g5_risk_score", _PARTS + " SELECT document_id, t AS tampering, v AS validation, b AS biometric, q AS quality, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r")
def risk_score(t):
    return _scored(t).select("document_id", "risk.*")


def _verdict(t, mode):
    c = F.col
    return _scored(t).select("document_id", D.verdict(c("risk.score"), c("watchlist"), c("mismatch"), c("invalid"), c("tampered"), c("tampering"), c("face"), mode).alias("verdict"))


_VERDICT = " SELECT document_id, CASE WHEN {high} watchlist OR mismatch OR invalid OR (tampered AND coalesce(tampering >= 0.35, false)) OR coalesce(face = 'NO_MATCH', false) THEN 'REJECTED' WHEN {low} coalesce(face = 'INCONCLUSIVE', false) THEN 'REVIEW_REQUIRED' ELSE 'PASSED' END AS verdict FROM r"


@query("g6_verdict", _PARTS + _VERDICT.format(high="score >= 50 OR", low="score >= 25 OR"))
def verdict(t):
    return _verdict(t, "intended")


@query("g6_verdict_reference", _PARTS + _VERDICT.format(high="", low=""))
def verdict_reference(t):
    return _verdict(t, "reference")


@query("g8_pipeline_stage", f"""WITH s AS ({SIGNALS.format(orders='orders')}) SELECT document_id, CASE WHEN ocr IS NULL OR ocr < 0.2 THEN 'DOCUMENT' WHEN invalid OR mismatch THEN 'VALIDATION' WHEN tampered AND coalesce(tampering >= 0.35, false) THEN 'TAMPERING' WHEN face = 'NO_MATCH' THEN 'FACE' END AS failed_stage FROM s""")
def pipeline_stage(t):
    """All stages run; the first that failed is reported."""
    fails = (("DOCUMENT", F.col("ocr").isNull() | (F.col("ocr") < 0.2)), ("VALIDATION", F.col("invalid") | F.col("mismatch")), ("TAMPERING", F.col("tampered") & (F.col("tampering") >= 0.35)), ("FACE", F.col("face") == "NO_MATCH"))
    return _signals(t).select("document_id", F.coalesce(*[F.when(test, name) for name, test in fails]).alias("failed_stage"))


#: Detector scores of a document from its key; some detectors are missing.
EVIDENCE = """SELECT o_orderkey AS document_id, CAST(o_orderkey % 97 AS DOUBLE) / 96 AS ela, CAST(o_orderkey % 89 AS DOUBLE) / 88 AS noise,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 53 AS DOUBLE) / 100 END AS copy_move, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 61 AS DOUBLE) / 100 END AS splicing,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 67 AS DOUBLE) / 100 END AS content_alteration, CAST(o_orderkey % 43 AS DOUBLE) / 100 AS text_tampering,
    CAST(o_orderkey % 79 AS DOUBLE) / 100 AS stamp, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 71 AS DOUBLE) / 70 END AS metadata,
    CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS strong, CAST(o_orderkey % 37 % 4 AS INT) AS moderate FROM {orders}"""

_SCORES = f"WITH e AS ({EVIDENCE.format(orders='orders')}), s AS (SELECT document_id, strong, moderate, " + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN CAST(round_even(least(greatest({k}, 0), 1) * 100, 0) AS INT) END AS {k}" for k in D.DETECTORS) + " FROM e)"


def _evidence(t):
    orders = t("orders")
    orders.createOrReplaceTempView("__evidence_orders")
    rows = orders.sparkSession.sql(EVIDENCE.format(orders="__evidence_orders"))
    return rows.select("document_id", "strong", "moderate", *[D.normalised(F.col(k)).alias(k) for k in D.DETECTORS])


@query("g21_normalised_signals", _SCORES + " SELECT document_id, " + ", ".join(f"{k}, CASE WHEN {k} IS NULL THEN 'UNKNOWN' WHEN {k} >= 60 THEN 'HIGH' WHEN {k} >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS {k}_severity" for k in D.DETECTORS) + " FROM s")
def normalised_signals(t):
    return _evidence(t).select("document_id", *[x for k in D.DETECTORS for x in (k, D.severity(F.col(k)).alias(f"{k}_severity"))])


_Z = {k: f"coalesce({k}, 0)" for k in D.DETECTORS}


@query(
    "g15_overall_score",
    _SCORES
    + f""", d AS (SELECT *, greatest(
        CASE WHEN {_Z['copy_move']} >= 40 THEN 72.0::DOUBLE + 0.26::DOUBLE * copy_move END, CASE WHEN {_Z['stamp']} >= 70 THEN 68.0::DOUBLE + 0.28::DOUBLE * stamp END,
        CASE WHEN {_Z['splicing']} >= 50 THEN 68.0::DOUBLE + 0.28::DOUBLE * splicing END, CASE WHEN {_Z['content_alteration']} >= 50 THEN 68.0::DOUBLE + 0.28::DOUBLE * content_alteration END,
        CASE WHEN {_Z['text_tampering']} >= 50 THEN 68.0::DOUBLE + 0.28::DOUBLE * text_tampering END, CASE WHEN {_Z['ela']} >= 50 THEN 68.0::DOUBLE + 0.28::DOUBLE * ela END,
        CASE WHEN {_Z['ela']} >= 45 AND {_Z['noise']} >= 45 THEN 70.0::DOUBLE + 0.25::DOUBLE * greatest(ela, noise) END,
        CASE WHEN {_Z['metadata']} >= 50 THEN least(55.0::DOUBLE, 50.0::DOUBLE + 0.10::DOUBLE * (metadata - 50)) END,
        CASE WHEN strong > 0 THEN 75.0::DOUBLE + 10.0::DOUBLE * least(strong, 2) END,
        CASE WHEN moderate >= 2 AND {_Z['ela']} >= 40 AND {_Z['noise']} >= 40 THEN 65.0::DOUBLE + 0.20::DOUBLE * greatest(ela, noise) END) AS direct,
        (0.12::DOUBLE * {_Z['ela']} + 0.12::DOUBLE * {_Z['noise']} + 0.05::DOUBLE * {_Z['stamp']} + 0.05::DOUBLE * {_Z['metadata']})
        / (0.12::DOUBLE + 0.12::DOUBLE + 0.05::DOUBLE + CASE WHEN metadata IS NULL THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END) AS mean FROM s),
    o AS (SELECT document_id, CAST(trunc(least(greatest(coalesce(direct, CASE WHEN moderate > 0 THEN least(mean * 0.40::DOUBLE + 8.0::DOUBLE * moderate, 35.0::DOUBLE)
        WHEN {_Z['text_tampering']} >= 35 THEN least(35.0::DOUBLE, 20.0::DOUBLE + 0.35::DOUBLE * text_tampering) ELSE least(mean * 0.35::DOUBLE, 25.0::DOUBLE) END), 0), 100)) AS INT) AS score FROM d)
    SELECT document_id, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM o""",
)
def overall_score(t):
    scored = _evidence(t).select("document_id", D.overall_score({k: F.col(k) for k in D.DETECTORS}, F.col("strong"), F.col("moderate")).alias("score"))
    return scored.withColumn("level", D.level(F.col("score"), D.IMAGE_LEVELS))


@query(
    "g17_conflict",
    _SCORES
    + """, m AS (SELECT document_id, metadata, list_avg(list_filter([ela, noise, copy_move, splicing, content_alteration, text_tampering, stamp], lambda x: x IS NOT NULL)) AS mean FROM s)
    SELECT document_id, CASE WHEN metadata >= 50 AND mean < 25 THEN 'METADATA' WHEN mean >= 60 AND metadata < 15 THEN 'IMAGE' END AS conflict FROM m""",
)
def conflict(t):
    return _evidence(t).select("document_id", D.conflict({k: F.col(k) for k in D.DETECTORS}).alias("conflict"))


@query("g7_factors", f"""WITH s AS ({SIGNALS.format(orders='orders')})
    SELECT document_id, 'COMPLIANCE' AS category, 'CRITICAL' AS severity, 35 AS impact FROM s WHERE invalid UNION ALL SELECT document_id, 'COMPLIANCE', 'HIGH', 20 FROM s WHERE mismatch
    UNION ALL SELECT document_id, 'TAMPERING', CASE WHEN critical_mark THEN 'CRITICAL' ELSE 'MEDIUM' END, CASE WHEN critical_mark THEN 35 ELSE 10 END FROM s WHERE tampered
    UNION ALL SELECT document_id, 'BIOMETRIC', CASE WHEN face = 'NO_MATCH' THEN 'CRITICAL' ELSE 'MEDIUM' END, CASE WHEN face = 'NO_MATCH' THEN 25 ELSE 12 END FROM s WHERE face <> 'MATCH'""")
def factors(t):
    """Screening factors of four producers. One pass: each row makes its factors as an array of nullable structs."""
    factor = lambda test, category, severity, impact: F.when(test, F.struct(F.lit(category).alias("category"), severity.alias("severity"), impact.alias("impact")))
    s, critical, no_match = _signals(t), F.col("critical_mark"), F.col("face") == "NO_MATCH"
    made = F.array_compact(F.array(
        factor(F.col("invalid"), "COMPLIANCE", F.lit("CRITICAL"), F.lit(35)), factor(F.col("mismatch"), "COMPLIANCE", F.lit("HIGH"), F.lit(20)),
        factor(F.col("tampered"), "TAMPERING", F.when(critical, "CRITICAL").otherwise("MEDIUM"), F.when(critical, 35).otherwise(10)),
        factor(F.col("face") != "MATCH", "BIOMETRIC", F.when(no_match, "CRITICAL").otherwise("MEDIUM"), F.when(no_match, 25).otherwise(12)),
    ))
    return s.select("document_id", F.explode(made).alias("f")).select("document_id", "f.*")
