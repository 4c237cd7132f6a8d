"""Text boxes of a document: sentences of their cues, regions of boxes that touch, the document's signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import regions as G
from attesta.plans import query
from attesta.plans.intake import _CUES

_MEANS = ["CAST(200 AS DOUBLE) AS paper_mean", "CAST(200 + l_suppkey % 13 AS DOUBLE) AS background_mean"]


@query("g25_cue_reasons", f"""WITH f AS (SELECT {', '.join(_CUES + _MEANS)} FROM lineitem)
    SELECT doc, id, array_to_string(list_filter([CASE WHEN noisy AND (void >= 0.5 OR (void >= 0.4 AND background_gap >= 3)) AND background_std < 3.5 THEN printf('Substrate noise void around text (void: %.0f%%, local bg std: %.2f vs doc: %.2f)', void * 100, background_std, paper_std) END,
        CASE WHEN (ela_gap >= 1.6 AND ela >= 7 AND abs(ela - near_ela) >= 3.5) OR (ela >= 10 AND ela_gap >= 1.8) THEN printf('Local ELA compression disparity (%.2fx relative to neighboring text)', ela_gap) END,
        CASE WHEN sharp_gap >= 0.55 AND (sharp > 40 OR near_sharp > 40) AND (ela >= 5 OR void >= 0.3 OR background_gap >= 3.5) THEN printf('Stroke rendering disparity (%.2fx relative to neighboring text)', sharp_gap) END,
        CASE WHEN background_step >= 3 AND noisy AND w >= 35 AND h >= 15 AND background_pixels >= 60 THEN printf('Substrate brightness step in text patch (%.1f vs doc: %.1f)', background_mean, paper_mean) END,
        CASE WHEN border > 160 AND w >= 30 AND h >= 16 AND background_pixels >= 35 AND background_gap >= 3 THEN printf('Paste / erasure perimeter boundary step (%.1f)', border) END], lambda x: x IS NOT NULL), ' | ') AS reason FROM f""")
def cue_reasons(t):
    """The cues of every text box in words."""
    f = t("lineitem").selectExpr(*_CUES, *_MEANS)
    return f.select("doc", "id", F.array_join(G.cue_reasons({c: F.col(c) for c in f.columns}), " | ").alias("reason"))


_BOXES = ["l_orderkey AS doc", "l_linenumber AS id", "CAST(l_partkey % 240 AS DOUBLE) AS x", "CAST(l_suppkey % 40 AS DOUBLE) AS y", "CAST(5 + l_quantity AS DOUBLE) AS w", "CAST(6 + l_linenumber * 3 AS DOUBLE) AS h", "CAST(l_discount AS DOUBLE) * 9 AS score", "CASE WHEN l_returnflag = 'N' THEN 'void' ELSE 'ela' END AS cue", "CASE WHEN l_partkey % 3 = 0 THEN 'border' ELSE 'step' END AS cue2"]
_REGION = "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, score DOUBLE, reasons VARCHAR[], n BIGINT)"
_MERGED = f"""RECURSIVE b AS (SELECT {', '.join(_BOXES)} FROM lineitem), s AS (SELECT *, [cue, cue2] AS reasons, row_number() OVER (PARTITION BY doc ORDER BY id, x, y, w, h, score, cue, cue2) AS k FROM b),
    f AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS k, CAST([] AS {_REGION}[]) AS regions FROM s
        UNION ALL SELECT doc, k, CASE WHEN hit = 0 THEN list_append(regions, CAST({{'id': id, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score, 'reasons': reasons, 'n': 1}} AS {_REGION}))
            ELSE list_transform(regions, lambda r, i: CASE WHEN i = hit THEN CAST({{'id': r.id, 'x': least(r.x, x), 'y': least(r.y, y), 'w': greatest(r.x + r.w, x + w) - least(r.x, x), 'h': greatest(r.y + r.h, y + h) - least(r.y, y),
                'score': greatest(r.score, score), 'reasons': list_concat(r.reasons, list_filter(reasons, lambda q: NOT list_contains(r.reasons, q))), 'n': r.n + 1}} AS {_REGION}) ELSE r END) END AS regions
        FROM (SELECT s.doc, s.k, s.id, s.x, s.y, s.w, s.h, s.score, s.reasons, f.regions, coalesce(list_position(list_transform(f.regions, lambda r: abs(s.y - r.y) < greatest(s.h, r.h) AND s.x <= r.x + r.w + 25 AND r.x <= s.x + s.w + 25), true), 0) AS hit
            FROM f JOIN s ON s.doc = f.doc AND s.k = f.k + 1) AS z),
    m AS (SELECT doc, unnest(regions) AS r FROM (SELECT doc, arg_max(regions, k) AS regions FROM f GROUP BY doc) AS l)"""


def _merged(t):
    boxes = t("lineitem").selectExpr(*_BOXES).withColumn("reasons", F.array("cue", "cue2"))
    return G.merged_text_boxes(boxes, ["doc"])


@query("g24_text_regions", f"""WITH {_MERGED} SELECT doc, r.id AS id, r.x AS x, r.y AS y, r.w AS w, r.h AS h, round(r.score, 6) AS score, CASE WHEN r.score >= 0.65 THEN 'HIGH' WHEN r.score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    '[text_tampering] ' || array_to_string(r.reasons, ' | ') AS reason, r.n AS n_boxes FROM m""")
def text_regions(t):
    """Suspicious boxes of a document merged into regions, in the order of their lines."""
    reason = F.concat(F.lit("[text_tampering] "), F.array_join("reasons", " | "))
    return _merged(t).select("doc", "id", "x", "y", "w", "h", F.round("score", 6).alias("score"), "severity", reason.alias("reason"), "n_boxes")


@query("g24_text_signal", f"""WITH {_MERGED}, k AS (SELECT doc, r.score AS score, row_number() OVER (PARTITION BY doc ORDER BY r.score DESC) AS n FROM m)
    SELECT doc, round(least(1, greatest(0, 0.75 * max(score) + CASE WHEN count(*) > 1 THEN 0.25 * avg(score) ELSE 0 END)), 6) AS signal FROM k WHERE n <= 3 GROUP BY doc""")
def text_signal(t):
    """Signal of a document from its merged text regions."""
    return G.text_signal(_merged(t), ["doc"]).select("doc", F.round("signal", 6).alias("signal"))
