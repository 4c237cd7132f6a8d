"""Correlated and fused regions over boxes derived from order lines, eight orders to a document of two pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators import correlation as C
from attesta.operators import decisions as D
from attesta.plans import query
from attesta.plans.evidence import _AND, _cases

#: Line numbers repeat within a document, so regions are numbered anew. Some have no page, some no score; copies point at a place.
_REGIONS = """SELECT l_orderkey // 8 AS document_id, CASE WHEN l_linenumber % 5 <> 0 THEN 1 + l_linenumber % 2 END AS page,
    row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id,
    CASE l_partkey % 7 WHEN 0 THEN 'ela' WHEN 1 THEN 'noise' WHEN 2 THEN 'copy_move' WHEN 3 THEN 'splicing' WHEN 4 THEN 'content_alteration' WHEN 5 THEN 'text_tampering' ELSE 'stamp' END AS detector,
    CASE WHEN l_linenumber <> 7 THEN CAST(l_discount AS DOUBLE) * 10 - 0.05 END AS score, l_partkey * 7 % 400 AS x, l_suppkey * 13 % 300 AS y, 20 + l_partkey % 91 AS w, 15 + l_suppkey % 73 AS h FROM lineitem"""
_DETECTORS = ("ela", "noise", "copy_move", "splicing", "content_alteration", "text_tampering", "stamp")


def _regions(t):
    c = F.col
    order = Window.partitionBy("document_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = t("lineitem").withColumn("document_id", F.expr("l_orderkey div 8")).withColumn("detector", F.element_at(F.array(*map(F.lit, _DETECTORS)), (c("l_partkey") % 7 + 1).cast("int")))
    box = {"x": c("l_partkey") * 7 % 400, "y": c("l_suppkey") * 13 % 300, "w": 20 + c("l_partkey") % 91, "h": 15 + c("l_suppkey") % 73}
    copied = c("detector") == "copy_move"
    target = {"x": box["x"] + 9, "y": box["y"] + 5, "w": box["w"], "h": box["h"]}
    return rows.select(
        "document_id", F.when(c("l_linenumber") % 5 != 0, 1 + c("l_linenumber") % 2).alias("page"), F.row_number().over(order).cast("long").alias("id"), "detector",
        F.when(c("l_linenumber") != 7, c("l_discount").cast("double") * 10 - 0.05).alias("score"), *(v.cast("long").alias(k) for k, v in box.items()), *(F.when(copied, v).cast("long").alias(f"target_{k}") for k, v in target.items()),
    )


_MEET = "greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0)"
_NORM = "CASE WHEN {0} IS NOT NULL THEN CAST(round_even(least(greatest({0}, 0), 1) * 100, 0) AS INT) END"
_STRENGTH = "CASE WHEN len({0}) >= 3 THEN 'STRONG' WHEN len({0}) = 2 THEN 'MODERATE' WHEN len({0}) = 1 THEN CASE WHEN {1} THEN 'MODERATE' ELSE 'WEAK' END ELSE 'NONE' END"
_SEVERITY = "CASE strength WHEN 'STRONG' THEN 'HIGH' WHEN 'MODERATE' THEN CASE WHEN top >= 70 THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'WEAK' THEN CASE WHEN top >= 75 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'LOW' END"
_REASON = """CASE len(names) WHEN 0 THEN 'Low-level forensic indicator; no multi-signal corroboration.' WHEN 1 THEN 'Single forensic indicator (' || names[1] || ') flags this region as suspicious.'
    ELSE 'Region ' || region_id || ' is suspicious because ' || array_to_string(names[1:len(names) - 1], ', ') || ' and ' || names[len(names)] || ' independently detected anomalies in the same area.' END"""
_TOLD = "array_to_string(list_transform(found, lambda el: el.d || '=' || el.n), ',')"


def _signals_told():
    return F.array_join(F.transform("signals", lambda s: F.concat(s["detector"], F.lit("="), s["score"].cast("string"))), ",").alias("signals")


@query(
    "g19_correlated_regions",
    f"""WITH RECURSIVE b AS (SELECT * REPLACE (coalesce(page, 1) AS page, coalesce(score, 0.5) AS score) FROM ({_REGIONS})),
    p AS (SELECT a.document_id, a.page, a.id AS u, c.id AS v, {_MEET} AS i, a.w * a.h AS s, c.w * c.h AS t FROM b a JOIN b c ON a.document_id = c.document_id AND a.page = c.page AND a.id < c.id),
    n AS (SELECT * FROM p WHERE i > 0 AND (i / (s + t - i) >= 0.30 OR i / least(s, t) >= 0.40)), e AS (SELECT document_id, page, u, v FROM n UNION ALL SELECT document_id, page, v, u FROM n),
    r AS (SELECT document_id, page, id, id AS root FROM b UNION SELECT e.document_id, e.page, e.v, r.root FROM r JOIN e ON r.document_id = e.document_id AND r.page = e.page AND r.id = e.u),
    l AS (SELECT document_id, id, min(root) AS root FROM r GROUP BY 1, 2),
    d AS (SELECT document_id, page, root, detector AS d, min(id) FILTER (score >= 0) AS f, round(max(score) FILTER (score >= 0), 4) AS s FROM b JOIN l USING (document_id, id) GROUP BY 1, 2, 3, 4),
    f AS (SELECT document_id, page, root, list_filter(list({{'d': d, 's': s, 'n': {_NORM.format('s')}}} ORDER BY f), lambda el: el.s IS NOT NULL) AS found FROM d GROUP BY 1, 2, 3),
    m AS (SELECT document_id, page, root, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n_regions, arg_min(x + 9, id) FILTER (detector = 'copy_move') AS target_x FROM b JOIN l USING (document_id, id) GROUP BY 1, 2, 3),
    k AS (SELECT *, list_filter(found, lambda el: el.s >= 0.30) AS backing, coalesce(list_max(list_transform(found, lambda el: el.n)), 0) AS top, coalesce(list_max(list_transform(found, lambda el: el.s)), 0) AS best FROM m JOIN f USING (document_id, page, root)),
    g AS (SELECT *, list_transform(backing, lambda el: upper(el.d)) AS names, {_STRENGTH.format('backing', "len(list_filter(backing, lambda el: el.d = 'copy_move' AND el.s >= 0.40)) > 0")} AS strength FROM k),
    v AS (SELECT *, {_SEVERITY} AS severity FROM g),
    o AS (SELECT *, 'R' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, len(names) DESC, best DESC, root) AS VARCHAR), 3, '0') AS region_id FROM v)
    SELECT document_id, page, region_id, x, y, w, h, severity, strength AS evidence_strength, CAST(len(names) AS INT) AS detector_count, array_to_string(names, '+') AS supporting, {_TOLD} AS signals, {_REASON} AS reason, target_x, n_regions FROM o""",
)
def correlated_regions(t):
    """All detectors' regions of a page that lie on each other, as one; numbered through the document."""
    found = C.correlated_regions(_regions(t), "document_id", "page")
    return found.select("document_id", "page", "region_id", "x", "y", "w", "h", "severity", "evidence_strength", "detector_count", F.array_join("supporting_detectors", "+").alias("supporting"), _signals_told(), "reason", "target_x", "n_regions")


#: The localised regions are the pages' wide boxes; a detector that ran has its strongest region's score, metadata has none.
_LOCALISED = f"b AS (SELECT * REPLACE (coalesce(page, 1) AS page) FROM ({_REGIONS})), z AS (SELECT * FROM b WHERE w >= 60)"
_PLACES = "list_position([" + ", ".join(f"'{k}'" for k in D.DETECTORS) + "], detector)"
_FUSED = f"""{_LOCALISED}, q AS (SELECT a.document_id, a.page, a.id, c.detector, c.score, a.w * a.h AS s, c.w * c.h AS t, {_MEET} AS i FROM z a JOIN b c ON a.document_id = c.document_id AND a.page = c.page),
    k AS (SELECT document_id, page, id, detector, greatest(0.0::DOUBLE, max(score)) AS raw FROM q WHERE i > 0 AND i / (s + t - i) >= 0.30 GROUP BY 1, 2, 3, 4),
    j AS (SELECT document_id, page, id, list({{'d': detector, 's': round(raw, 4), 'n': {_NORM.format('raw')}}} ORDER BY {_PLACES}) AS found FROM k GROUP BY 1, 2, 3),
    y AS (SELECT z.*, coalesce(found, list_filter([{{'d': '', 's': 0.0::DOUBLE, 'n': 0}}], lambda el: el.d <> '')) AS found FROM z LEFT JOIN j USING (document_id, page, id)),
    x AS (SELECT *, list_transform(found, lambda el: upper(el.d)) AS names, coalesce(list_max(list_transform(found, lambda el: el.n)), 0) AS top, {_STRENGTH.format('found', "len(list_filter(found, lambda el: el.d = 'copy_move')) > 0")} AS strength FROM y),
    r AS (SELECT *, {_SEVERITY} AS severity, 'R' || lpad(CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY id) AS VARCHAR), 3, '0') AS region_id FROM x)"""


def _pieces(t):
    found = _regions(t).withColumn("page", F.coalesce("page", F.lit(1)))
    return found, C.backed_regions(found.withColumn("localised", F.col("w") >= 60), "document_id", "page")


@query("g20_fused_regions", f"WITH {_FUSED} SELECT document_id, page, region_id, x, y, w, h, severity, strength AS evidence_strength, CAST(len(names) AS INT) AS detector_count, {_TOLD} AS signals, {_REASON} AS reason, CASE WHEN detector = 'copy_move' THEN x + 9 END AS target_x FROM r")
def fused_regions(t):
    """Localised regions with the detectors whose regions lie on them."""
    return _pieces(t)[1].select("document_id", "page", "region_id", "x", "y", "w", "h", "severity", "evidence_strength", "detector_count", _signals_told(), "reason", "target_x")


_KEYS = ", ".join(D.DETECTORS)
_Z = {k: f"coalesce({k}, 0)" for k in D.DETECTORS}
_IMAGE = "list_filter([ela, noise, copy_move, splicing, content_alteration, text_tampering, stamp], lambda el: el IS NOT NULL)"
_LISTED = lambda test, name: "list_filter([" + ", ".join(f"CASE WHEN {test(k)} THEN '{name(k)}' END" for k in D.DETECTORS) + "], lambda el: el IS NOT NULL)"


@query(
    "g20_fusion",
    f"""WITH {_FUSED}, s AS (SELECT document_id, page, {', '.join(f"{_NORM.format(f'''max(score) FILTER (detector = '{k}')''')} AS {k}, coalesce(bool_or(detector = '{k}'), false) AS {k}_on" for k in D.DETECTORS if k != 'metadata')}, CASE WHEN document_id % 3 > 0 THEN {_NORM.format('document_id % 71 / 70')} END AS metadata, document_id % 3 > 0 AS metadata_on FROM b GROUP BY 1, 2),
    c AS (SELECT document_id, page, CAST(count_if(strength = 'STRONG') AS INT) AS strong, CAST(count_if(strength = 'MODERATE') AS INT) AS moderate, max(top) AS top FROM r GROUP BY 1, 2),
    t AS (SELECT s.*, coalesce(strong, 0) AS strong, coalesce(moderate, 0) AS moderate, coalesce(top, 0) AS top, list_avg({_IMAGE}) AS mean FROM s LEFT JOIN c USING (document_id, page)),
    d AS (SELECT *, greatest(CASE WHEN {_Z['copy_move']} >= 40 THEN 72.0::DOUBLE + 0.26::DOUBLE * copy_move END, CASE WHEN {_Z['stamp']} >= 70 THEN 68.0::DOUBLE + 0.28::DOUBLE * stamp END,
        {', '.join(f"CASE WHEN {_Z[k]} >= 50 THEN 68.0::DOUBLE + 0.28::DOUBLE * {k} END" for k in ('splicing', 'content_alteration', 'text_tampering', 'ela'))},
        CASE WHEN {_Z['ela']} >= 45 AND {_Z['noise']} >= 45 THEN 70.0::DOUBLE + 0.25::DOUBLE * greatest(ela, noise) END, CASE WHEN {_Z['metadata']} >= 50 THEN least(55.0::DOUBLE, 50.0::DOUBLE + 0.10::DOUBLE * (metadata - 50)) END,
        CASE WHEN strong > 0 THEN 75.0::DOUBLE + 10.0::DOUBLE * least(strong, 2) END, CASE WHEN moderate >= 2 AND {_Z['ela']} >= 40 AND {_Z['noise']} >= 40 THEN 65.0::DOUBLE + 0.20::DOUBLE * greatest(ela, noise) END) AS direct,
        {' + '.join(f"CASE WHEN {k} IS NULL THEN 0.0::DOUBLE ELSE {v}::DOUBLE END" for k, v in D.WEIGHTS.items())} AS weight, {' + '.join(f"{v}::DOUBLE * {_Z[k]}" for k, v in D.WEIGHTS.items())} AS mass FROM t),
    a AS (SELECT *, CASE WHEN weight > 0 THEN mass / weight ELSE 0.0::DOUBLE END AS passive FROM d),
    o AS (SELECT *, CAST(trunc(least(greatest(coalesce(direct, CASE WHEN moderate > 0 THEN least(passive * 0.40::DOUBLE + 8.0::DOUBLE * moderate, 35.0::DOUBLE) WHEN {_Z['text_tampering']} >= 35 THEN least(35.0::DOUBLE, 20.0::DOUBLE + 0.35::DOUBLE * text_tampering) ELSE least(passive * 0.35::DOUBLE, 25.0::DOUBLE) END), 0), 100)) AS INT) AS score,
        CASE WHEN metadata >= 50 AND mean < 25 THEN 'METADATA' WHEN mean >= 60 AND metadata < 15 THEN 'IMAGE' END AS conflict, {_LISTED(lambda k: f"{k} >= 60", C.LABELS.get)} AS high, {_LISTED(lambda k: f"{k} >= 35 AND {k} < 60", C.LABELS.get)} AS medium FROM a),
    w AS (SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM o)
    SELECT document_id, page, score AS overall_score, level AS overall_level, CAST(least(100, greatest(least(strong * 25, 60) + least(moderate * 12, 30), CAST(floor(top * 0.60::DOUBLE) AS INT))) AS INT) AS region_bonus, strong, moderate, {_cases('conflict', C.CONFLICTS)} AS conflict_note,
        array_to_string(list_filter([{_AND.format('high', 'Strong')}, {_AND.format('medium', 'Moderate')}, CASE WHEN copy_move >= 40 THEN '{C.DUPLICATED}' END,
            CASE WHEN strong > 0 THEN strong || CASE WHEN strong > 1 THEN ' regions' ELSE ' region' END || '{C.STRONG_SAID}' END, CASE WHEN moderate > 0 THEN moderate || CASE WHEN moderate > 1 THEN ' regions' ELSE ' region' END || '{C.MODERATE_SAID}' END,
            {_cases('conflict', C.CONFLICTS)}, {_cases('level', C.ASSESSMENTS)}], lambda el: el IS NOT NULL), chr(10)) AS explanations,
        array_to_string({_LISTED(lambda k: f'{k}_on', str)}, ',') AS available, array_to_string({_LISTED(lambda k: f'NOT {k}_on', str)}, ',') AS unavailable FROM w""",
)
def fusion(t):
    """What all detectors say about a page: score, level, bonus, conflict, sentences and who took part."""
    found, fused = _pieces(t)
    signals = found.select("document_id", "page", "detector", F.lit(True).alias("available"), "score")
    pages = found.select("document_id", "page").distinct()
    metadata = pages.select("document_id", "page", F.lit("metadata"), F.expr("document_id % 3 > 0"), (F.col("document_id") % 71 / 70).cast("double"))
    told = C.fused(signals.union(metadata), fused, "document_id", "page")
    return told.select("document_id", "page", "overall_score", "overall_level", "region_bonus", "strong", "moderate", "conflict_note", F.array_join("explanations", "\n").alias("explanations"), F.array_join("detectors_available", ",").alias("available"), F.array_join("detectors_unavailable", ",").alias("unavailable"))
