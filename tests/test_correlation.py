"""Overlapping pairs, components, correlated regions and fusion against plain programs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import components, correlation, geometry
from attesta.operators import decisions as D

BOX = "document long, page long, id long, x long, y long, w long, h long"


def _shared(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def _boxes(rng, n, extent, pages=2):
    size = lambda: int(rng.choice([0, 5, 40, 64, 65, 200, 300, 1500, 5000]) * rng.random()) + rng.choice([0, 1])
    return [(d, p, i, rng.randrange(-extent, extent), rng.randrange(-extent, extent), size(), size()) for d in range(2) for p in range(pages) for i in range(n)]


@pytest.mark.parametrize("page, n, extent", [(64, 40, 200), (5, 150, 900), (0, 60, 20_000)])
def test_pairs_meet_on_grids(spark, monkeypatch, page, n, extent):
    """Boxes of every size, below zero too; empty ones meet nothing."""
    monkeypatch.setattr(geometry, "PAGE", page)
    rows = _boxes(random.Random(n), n, extent)
    df = spark.createDataFrame(rows, BOX)
    got = sorted(tuple(r) for r in geometry.overlapping_pairs(df, ["document", "page"], F.lit(True)).select("document", "page", "a_id", "b_id").collect())
    assert got == sorted((a[0], a[1], a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a[2] < b[2] and _shared(a[3:], b[3:]) > 0)


@pytest.mark.parametrize("fold", [0, 30, 4096])
def test_components_by_key(spark, fold):
    rng = random.Random(3)
    links = [(k, rng.randrange(60), rng.randrange(60)) for k in ("a", "b") for _ in range(40)] + [("c", i, i + 1) for i in range(200)] + [("d", 7, x) for x in range(8, 90)] + [(None, 1, 2), ("e", 1, None), ("e", 4, 4), ("f", 2, 1), ("f", 1, 2)]
    got = {(r.k, r.node): r.root for r in components.components(spark.createDataFrame(links, "k string, a long, b long"), ["k"], "a", "b", fold=fold).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    used = [((k, a), (k, b)) for k, a, b in links if k is not None and b is not None and a != b]
    for a, b in used:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x)[1] for pair in used for x in pair}


REGIONS = "document string, page long, id long, detector string, score double, x long, y long, w long, h long, target_x long, target_y long, target_w long, target_h long, extra int"


def _plain(rows):
    """Correlated regions of one document, region by region."""
    items = [dict(zip(REGIONS.replace(",", "").split()[::2], r, strict=True)) for r in rows]
    for it in items:
        it["page"], it["score"], it["detector"] = it["page"] or 1, 0.5 if it["score"] is None else it["score"], it["detector"].lower()
        it["box"] = tuple(it[c] for c in "xywh")
    group = {it["id"]: {it["id"]} for it in items}
    for a in items:
        for b in items:
            i, s, t = _shared(a["box"], b["box"]), a["w"] * a["h"], b["w"] * b["h"]
            if a["id"] < b["id"] and a["page"] == b["page"] and i > 0 and (i / (s + t - i) >= 0.30 or i / min(s, t) >= 0.40) and group[a["id"]] is not group[b["id"]]:
                whole = group[a["id"]] | group[b["id"]]
                for x in whole:
                    group[x] = whole
    out = []
    for own in {id(g): g for g in group.values()}.values():
        mine = sorted((it for it in items if it["id"] in own), key=lambda it: it["id"])
        signals = {}
        for it in mine:
            if it["score"] >= signals.get(it["detector"], 0.0):
                signals[it["detector"]] = round(it["score"], 4)
        norm = {d: round(min(max(s, 0), 1) * 100) for d, s in signals.items()}
        backing = [d.upper() for d, s in signals.items() if s >= 0.30]
        n, top = len(backing), max(norm.values(), default=0)
        strength = "STRONG" if n >= 3 else "MODERATE" if n == 2 or (backing == ["COPY_MOVE"] and signals["copy_move"] >= 0.4) else "WEAK" if n else "NONE"
        severity = "HIGH" if strength == "STRONG" or (strength == "MODERATE" and top >= 70) else "MEDIUM" if strength == "MODERATE" or (strength == "WEAK" and top >= 75) else "LOW"
        x, y = min(it["x"] for it in mine), min(it["y"] for it in mine)
        box = (x, y, max(it["x"] + it["w"] for it in mine) - x, max(it["y"] + it["h"] for it in mine) - y)
        target = next((it["target_x"] for it in mine if it["target_x"] is not None), None)
        out.append(({"LOW": 1, "MEDIUM": 2, "HIGH": 3}[severity], n, max(signals.values(), default=0), -mine[0]["id"], mine[0]["page"], box, severity, strength, backing, norm, target, len(mine)))
    return [(f"R{i:03d}", *r[4:]) for i, r in enumerate(sorted(out, reverse=True), 1)]


def _told(r):
    return (r.region_id, r.page, (r.x, r.y, r.w, r.h), r.severity, r.evidence_strength, r.supporting_detectors, {s.detector: s.score for s in r.signals}, r.target_x, r.n_regions)


def test_correlated_regions(spark):
    rng = random.Random(11)
    names = ["ela", "noise", "COPY_MOVE", "Splicing", "stamp"]
    rows = []
    for d in ("a", "b"):
        for i in range(120):
            d_ = rng.choice(names)
            target = (5, 6, 7, 8) if d_ == "COPY_MOVE" and rng.random() < 0.5 else (None,) * 4
            rows.append((d, rng.choice([None, 1, 2]), i, d_, rng.choice([None, -0.2, 0.0, 0.123456, 0.29996, 0.3, 0.45, 0.76, 1.7]), rng.randrange(500), rng.randrange(400), rng.randrange(1, 80), rng.randrange(1, 80), *target, 1))
    df = spark.createDataFrame([*rows, (None, 1, 1, "ela", 0.5, 1, 1, 5, 5, None, None, None, None, 1)], REGIONS)
    got = correlation.correlated_regions(df, "document", "page").collect()
    for d in ("a", "b"):
        assert [_told(r) for r in sorted((r for r in got if r.document == d), key=lambda r: r.region_id)] == _plain([r for r in rows if r[0] == d])
    assert correlation.correlated_regions(df.limit(0), "document", "page").count() == 0


def test_a_document_of_ten_thousand_regions(spark):
    """Small boxes in a row of which each overlaps the next, far from others; one chain, found without holding the page together."""
    rows = [("d", 1, i, ("ela", "noise")[i % 2], 0.5, 6 * (i % 5000), 40 * (i // 5000), 10, 20, None, None, None, None, 1) for i in range(10_000)]
    got = correlation.correlated_regions(spark.createDataFrame(rows, REGIONS), "document", "page").collect()
    assert [(r.n_regions, r.x, r.w, r.h, r.evidence_strength) for r in got] == [(5000, 0, 4999 * 6 + 10, 20, "MODERATE")] * 2


def test_fused_regions_and_verdict(spark):
    box = "document string, page int, id long, x long, y long, w long, h long, target_x long, target_y long, target_w long, target_h long"
    none = (None,) * 4
    localised = spark.createDataFrame([("d", 1, 1, 0, 0, 10, 10, *none), ("d", 1, 2, 100, 0, 10, 10, 1, 2, 3, 4), ("d", 1, 3, 300, 0, 10, 10, *none), ("d", 2, 1, 0, 0, 10, 10, *none), (None, 1, 1, 0, 0, 10, 10, *none)], box)
    marks = [("noise", 0.4), ("ELA", 0.52), ("ela", 0.2), ("stamp", -1.0), ("unknown", 1.0)]
    detected = spark.createDataFrame([("d", 1, n, s, 0, 0, 10, 9) for n, s in marks] + [("d", 1, "copy_move", 0.1, 100, 0, 10, 10), ("d", 1, "noise", 0.9, 100, 8, 10, 10), ("d", 2, "splicing", None, 0, 0, 10, 10)], "document string, page int, detector string, score double, x long, y long, w long, h long")
    fused = correlation.fused_regions(localised, detected, "document", "page")
    got = {(r.page, r.region_id): (r.supporting_signals, r.evidence_strength, r.severity, [s.score for s in r.signals], r.target_x) for r in fused.collect()}
    assert got == {(1, "R001"): (["ELA", "NOISE", "STAMP"], "STRONG", "HIGH", [52, 40, 0], None), (1, "R002"): (["COPY_MOVE"], "MODERATE", "MEDIUM", [10], 1), (1, "R003"): ([], "NONE", "LOW", [], None), (2, "R001"): (["SPLICING"], "WEAK", "LOW", [0], None)}
    signals = spark.createDataFrame([("d", 1, "ela", True, 0.52), ("d", 1, "noise", True, None), ("d", 1, "stamp", False, 0.9), ("d", 2, "ela", None, 0.9), (None, 1, "ela", True, 1.0)], "document string, page int, detector string, available boolean, score double")
    one, two = sorted(correlation.fused(signals, fused, "document", "page").collect(), key=lambda r: r.page)
    assert (one.overall_score, one.overall_level, one.strong, one.moderate, one.region_bonus) == (85, "CRITICAL", 1, 1, 37)
    assert one.detectors_available == ["ela", "noise"] and len(one.detectors_unavailable) == 6 and one.scores[1].score is None and one.scores[1].severity == "UNKNOWN" and one.scores[6].severity is None
    assert one.explanations[0] == "Moderate compression inconsistency (ELA) detected." and one.explanations[-1] == correlation.ASSESSMENTS["CRITICAL"] and len(one.explanations) == 4
    assert (two.overall_score, two.overall_level, two.detectors_available, two.explanations) == (0, "LOW", [], [correlation.ASSESSMENTS["LOW"]])


def test_a_missing_score_stays_missing(spark):
    r = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, 0.345D AS b, -1D AS c, 7D AS d").select(*[D.normalised(F.col(c)) for c in "abcd"]).first()
    assert tuple(r) == (None, 34, 0, 100)


def test_equal_rows_meet_listed_names_each(spark):
    """Equal rows come back as often as they are there, and rows may hold maps."""
    from attesta.operators.neighbours import containing

    rows = spark.sql("SELECT id, name, map('a', id) AS more FROM VALUES (1, 'Ann'), (1, 'Ann'), (2, 'joanna'), (3, ' '), (4, NULL), (5, 'zz') AS t(id, name)")
    listed = spark.createDataFrame([("x", "Joanna Lee"), ("y", "ANNE")], "code string, listed string")
    got = sorted((r.id, r.code) for r in containing(rows, "name", listed, "listed").collect())
    assert got == [(1, "x"), (1, "x"), (1, "y"), (1, "y"), (2, "x")]


def test_pages_are_folded_where_they_lie(spark, monkeypatch):
    """Small pages and crowded ones give the same, with nulls and repeated ids; rows that the documents dealt out are not moved again to be folded."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.choice([None, *range(60)]), *(rng.choice([None, 0, *range(1, 60)]) for _ in range(4))) for _ in range(400)]
    df = spark.createDataFrame(rows, BOX)
    tests = (lambda shared, s, t: shared / (s + t - shared) >= 0.3), geometry.iou("a_", "b_") >= 0.3
    got = {}
    for page in (0, 20, 1000):
        monkeypatch.setattr(geometry, "PAGE", page)
        got[page] = sorted(map(repr, geometry.rooted(df, ["document", "page"], *tests).collect()))
    assert len(got[0]) == 400 and got[0] == got[20] == got[1000] and geometry.rooted(df.limit(0), ["document", "page"], *tests).count() == 0
    monkeypatch.setattr(geometry, "PAIRS", 7)
    assert sorted(map(repr, geometry.rooted(df, ["document", "page"], *tests).collect())) == got[0]
    full = spark.createDataFrame([], REGIONS).repartition(8, "document")
    plan = correlation.correlated_regions(full, "document", "page")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # one of them dealt the documents out, three group what was found


def test_pages_are_fused_where_they_lie(spark, monkeypatch):
    """Small pages and crowded ones give what brute force gives, with nulls, repeated ids and odd scores; boxes that the documents dealt out are moved once no more."""
    rng = random.Random(6)
    names = ["ela", "NOISE", "copy_move", "metadata", "other", None]
    rows = []
    for i in range(300):
        place = tuple(rng.choice([None, 0, *range(1, 50)]) if rng.random() < 0.1 else rng.randrange(1, 50) for _ in range(4))
        rows.append((rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2]), rng.choice([None, *range(200)]), rng.choice(names), rng.choice([None, -0.5, 0.0, 0.3, 0.123456, 0.77, float("nan")]), *place, None, None, None, None, rng.choice([None, True, False])))
    fields = REGIONS.rsplit(",", 1)[0] + ", localised boolean"
    df = spark.createDataFrame(rows, fields)
    want = {}
    for a in rows:
        if None in a[:3] or not a[-1]:
            continue
        found = want.setdefault(a[:3], {})
        for b in rows:
            if a[:2] == b[:2] and (b[3] or "").lower() in D.DETECTORS and None not in (*a[5:9], *b[5:9]) and (i := _shared(a[5:9], b[5:9])) > 0 and i / (a[7] * a[8] + b[7] * b[8] - i) >= 0.3:
                found[b[3].lower()] = max(found.get(b[3].lower(), 0.0), b[4] or 0.0, key=lambda s: (math.isnan(s), s))
    whole = sorted(a[:3] for a in rows if None not in a[:3] and a[-1])
    want = sorted((d, p, f"R{1 + sum(w[:2] == (d, p) for w in whole[:k]):03d}", repr([(n, round(want[d, p, i][n], 4)) for n in D.DETECTORS if n in want[d, p, i]])) for k, (d, p, i) in enumerate(whole))
    for page in (0, 40, 1000):
        monkeypatch.setattr(geometry, "PAGE", page)
        got = correlation.backed_regions(df, "document", "page").collect()
        assert sorted((r.document, r.page, r.region_id, repr([(s.detector, s.signal) for s in r.signals])) for r in got) == want
    assert correlation.backed_regions(df.limit(0), "document", "page").count() == 0
    full = spark.createDataFrame([], fields).repartition(8, "document")
    assert correlation.backed_regions(full, "document", "page")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
