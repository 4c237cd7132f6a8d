"""Overlaps, merged regions and evidence over boxes derived from order lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators import decisions as D
from attesta.operators import geometry as G
from attesta.plans import query

_DETECTORS = ("ela", "noise", "copy_move", "splicing", "content_alteration", "text_tampering", "stamp")
#: Line numbers repeat within an order, so regions are numbered anew.
_BOXES = "SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id, l_partkey % 100 AS x, l_suppkey % 60 AS y, 20 + l_partkey % 31 AS w, 15 + l_suppkey % 23 AS h, CAST(l_discount * 10 AS DOUBLE) AS score, CASE WHEN l_quantity > 40 THEN 'HIGH' WHEN l_quantity > 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE l_linenumber % 7 WHEN 0 THEN 'ela' WHEN 1 THEN 'noise' WHEN 2 THEN 'copy_move' WHEN 3 THEN 'splicing' WHEN 4 THEN 'content_alteration' WHEN 5 THEN 'text_tampering' ELSE 'stamp' END AS source FROM lineitem"


def _boxes(t):
    c = F.col
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    source = F.element_at(F.array(*[F.lit(d) for d in _DETECTORS]), (c("l_linenumber") % 7 + 1).cast("int"))
    severity = F.when(c("l_quantity") > 40, "HIGH").when(c("l_quantity") > 20, "MEDIUM").otherwise("LOW")
    return t("lineitem").select(
        c("l_orderkey").alias("document_id"), F.row_number().over(order).cast("long").alias("id"), (c("l_partkey") % 100).alias("x"), (c("l_suppkey") % 60).alias("y"), (20 + c("l_partkey") % 31).alias("w"), (15 + c("l_suppkey") % 23).alias("h"),
        (c("l_discount") * 10).cast("double").alias("score"), severity.alias("severity"), source.alias("source"),
    )


_PAIR = f"""b AS ({_BOXES}), p AS (SELECT a.document_id, a.id AS a_id, c.id AS b_id, a.source AS a_source, c.source AS b_source, a.score AS a_score, c.score AS b_score, a.w * a.h AS aa, c.w * c.h AS ab,
    greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0) AS i FROM b a JOIN b c ON a.document_id = c.document_id AND a.id < c.id)"""


@query("f38_iou", f"WITH {_PAIR} SELECT document_id, a_id, b_id, round(i / (aa + ab - i), 12) AS iou, round(i / least(aa, ab), 12) AS smaller FROM p WHERE i > 0")
def iou(t):
    pairs = G.overlapping_pairs(_boxes(t), ["document_id"], G.intersection("a_", "b_") > 0)
    return pairs.select("document_id", "a_id", "b_id", F.round(G.iou("a_", "b_"), 12).alias("iou"), F.round(G.smaller_overlap("a_", "b_"), 12).alias("smaller"))


@query("j12_overlap_join", f"WITH {_PAIR} SELECT document_id, a_id, b_id FROM p WHERE i / least(aa, ab) > 0.3")
def overlap_join(t):
    return G.overlapping_pairs(_boxes(t), ["document_id"], G.smaller_overlap("a_", "b_") > G.SMALLER_OVERLAP).select("document_id", "a_id", "b_id")


@query("j14_spatial_correlation", f"WITH {_PAIR} SELECT document_id, a_id, b_id FROM p WHERE i / (aa + ab - i) >= 0.30 OR i / least(aa, ab) >= 0.40")
def spatial_correlation(t):
    test = (G.iou("a_", "b_") >= G.IOU) | (G.smaller_overlap("a_", "b_") >= G.CONTAINMENT)
    return G.overlapping_pairs(_boxes(t), ["document_id"], test).select("document_id", "a_id", "b_id")


@query(
    "g12_merged_regions",
    f"""WITH RECURSIVE {_PAIR}, e AS (SELECT document_id, a_id AS u, b_id AS v FROM p WHERE i / least(aa, ab) > 0.3 UNION ALL SELECT document_id, b_id, a_id FROM p WHERE i / least(aa, ab) > 0.3),
    r AS (SELECT document_id, id, id AS root FROM b UNION SELECT e.document_id, e.v, r.root FROM r JOIN e ON r.document_id = e.document_id AND r.id = e.u),
    l AS (SELECT document_id, id, min(root) AS root FROM r GROUP BY 1, 2),
    m AS (SELECT document_id, root, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, max(score) AS score, max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS s, count(DISTINCT source) AS k, min(source) AS one, string_agg(DISTINCT source, '+' ORDER BY source) AS source, count(*) AS n_regions FROM b JOIN l USING (document_id, id) GROUP BY 1, 2)
    SELECT document_id, root, x, y, w, h, score, CASE WHEN s = 3 AND k = 1 AND one IN ('ela', 'noise', 'stamp') THEN 'MEDIUM' WHEN s = 3 THEN 'HIGH' WHEN s = 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, source, n_regions FROM m""",
)
def merged_regions(t):
    return G.merged_regions(_boxes(t), "document_id")


@query("j13_signal_attribution", f"WITH {_PAIR}, d AS (SELECT document_id, a_id AS id, b_source AS source, b_score AS score FROM p WHERE i / (aa + ab - i) >= 0.3 UNION ALL SELECT document_id, b_id, a_source, a_score FROM p WHERE i / (aa + ab - i) >= 0.3 UNION ALL SELECT document_id, id, source, score FROM b) SELECT document_id, id, source, max(score) AS score FROM d GROUP BY 1, 2, 3")
def signal_attribution(t):
    """The highest score of each detector whose regions lie on a region."""
    boxes = _boxes(t)
    pairs = G.overlapping_pairs(boxes, ["document_id"], G.iou("a_", "b_") >= G.IOU).select("document_id", "a_id", "b_id")
    both = pairs.union(pairs.select("document_id", "b_id", "a_id"))
    marks = boxes.select("document_id", F.col("id").alias("b_id"), "source", "score")
    near = both.join(marks, ["document_id", "b_id"]).select("document_id", F.col("a_id").alias("id"), "source", "score")
    return near.union(boxes.select("document_id", "id", "source", "score")).groupBy("document_id", "id", "source").agg(F.max("score").alias("score"))


@query(
    "g13_evidence_strength",
    f"""WITH {_PAIR}, d AS (SELECT document_id, a_id AS id, b_source AS source FROM p WHERE i / (aa + ab - i) >= 0.3 UNION SELECT document_id, b_id, a_source FROM p WHERE i / (aa + ab - i) >= 0.3 UNION SELECT document_id, id, source FROM b),
    k AS (SELECT document_id, id, count(DISTINCT source) AS n, bool_or(source = 'copy_move') AS c FROM d GROUP BY 1, 2) SELECT document_id, id, CASE WHEN n >= 3 THEN 'STRONG' WHEN n = 2 OR c THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM k""",
)
def evidence_strength(t):
    marks = signal_attribution(t).groupBy("document_id", "id").agg(F.count("*").alias("n"), F.bool_or(F.col("source") == "copy_move").alias("c"))
    return marks.select("document_id", "id", D.evidence_strength(F.col("n"), F.col("c")).alias("strength"))


@query("f39_cosine", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(least(greatest(list_cosine_similarity(a.e, b.e), 0), 1), 6) AS similarity, list_cosine_similarity(a.e, b.e) >= 0.45 AS match FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine(t):
    """A presented vector against its reference, clipped to 0..1; 0 when either is zero."""
    v = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    a, b = v.select(F.col("vec_id").alias("a"), F.col("e").alias("x")), v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("e").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    norm = F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))
    similarity = F.when(norm == 0, 0.0).otherwise(dot("x", "y") / norm)
    return a.join(b, "a").select("a", "b", F.round(F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)), 6).alias("similarity"), (similarity >= 0.45).alias("match"))


@query("f40_primary_face", f"WITH b AS ({_BOXES}), m AS (SELECT *, w * h AS area, max(w * h) OVER (PARTITION BY document_id) AS most FROM b) SELECT document_id, CASE WHEN count_if(area >= 0.2 * most) > 1 THEN 'MULTIPLE_FACES' ELSE 'OK' END AS status, count(*) AS faces FROM m GROUP BY 1")
def primary_face(t):
    """More than one face with a fifth of the largest one's area is an error."""
    faces = _boxes(t).groupBy("document_id").agg(F.collect_list(F.col("w") * F.col("h")).alias("areas"))
    prominent = F.size(F.filter("areas", lambda a: a >= 0.2 * F.array_max("areas")))
    return faces.select("document_id", F.when(prominent > 1, "MULTIPLE_FACES").otherwise("OK").alias("status"), F.size("areas").cast("long").alias("faces"))


@query(
    "j20_nearest_above",
    f"""WITH b AS ({_BOXES}), c AS (SELECT a.document_id, a.id, n.id AS above, a.y - n.y AS d, n.severity FROM b a JOIN b n ON a.document_id = n.document_id AND n.y < a.y AND a.y - n.y <= 200 AND abs(a.x - n.x) <= greatest(30, 1.5 * a.w)),
    k AS (SELECT *, row_number() OVER (PARTITION BY document_id, id ORDER BY d, above) AS r FROM c QUALIFY r <= 4) SELECT document_id, id, arg_min(above, r) AS above FROM k WHERE severity <> 'LOW' GROUP BY 1, 2""",
)
def nearest_above(t):
    """Among the four nearest regions above, the first that passes a test."""
    b = _boxes(t)
    a = b.select("document_id", "id", "x", "y", "w")
    n = b.select("document_id", F.col("id").alias("above"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("severity"))
    near = a.join(n, "document_id").where("ny < y AND y - ny <= 200 AND abs(x - nx) <= greatest(30, 1.5 * w)")
    four = near.groupBy("document_id", "id").agg(F.slice(F.array_sort(F.collect_list(F.struct((F.col("y") - F.col("ny")).alias("d"), "above", "severity"))), 1, 4).alias("n"))
    return four.select("document_id", "id", F.get(F.filter("n", lambda x: x["severity"] != "LOW"), F.lit(0))["above"].alias("above")).where("above IS NOT NULL")
