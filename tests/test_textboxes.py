"""Text regions against a direct fold, and sentences of cues."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from attesta.operators import regions as G

FIELDS = "doc long, page int, id long, x double, y double, w double, h double, score double, reasons array<string>, __island string"


def _fold(boxes):
    """The merging as it is stated: every box against all regions of its page, in order."""
    pages = {}
    for doc, page, i, x, y, w, h, score, reasons, _ in sorted(boxes, key=lambda b: (b[2], *b[3:7], b[7] or 0.0, [r for r in b[8] or [] if r is not None])):
        regions = pages.setdefault((doc, page), [])
        for r in regions:
            if abs(y - r["y"]) < max(h, r["h"]) and x <= r["x"] + r["w"] + 25 and r["x"] <= x + w + 25:
                r["w"], r["h"] = max(x + w, r["x"] + r["w"]) - min(x, r["x"]), max(y + h, r["y"] + r["h"]) - min(y, r["y"])
                r["x"], r["y"], r["score"], r["n"] = min(x, r["x"]), min(y, r["y"]), max(score or 0.0, r["score"]), r["n"] + 1
                r["reasons"] += [q for q in dict.fromkeys(reasons or []) if q is not None and q not in r["reasons"]]
                break
        else:
            regions.append({"id": i, "x": x, "y": y, "w": w, "h": h, "score": score or 0.0, "n": 1, "reasons": [q for q in dict.fromkeys(reasons or []) if q is not None]})
    return sorted(((d, p, r["id"], r["x"], r["y"], r["w"], r["h"], r["score"], tuple(r["reasons"]), r["n"]) for (d, p), found in pages.items() for r in found), key=repr)


def _rows(df):
    return sorted(((r.doc, r.page, r.id, r.x, r.y, r.w, r.h, r.score, tuple(r.reasons), r.n_boxes) for r in df.collect()), key=repr)


def test_text_regions(spark):
    rng = random.Random(11)
    boxes = []
    for i in range(2500):
        doc = None if i % 50 == 0 else i % 9
        side = 400 if i % 9 < 4 else 6000
        reasons = rng.choice([None, [], ["a", "b"], ["b", None, "c", "c"]])
        boxes.append((doc, i % 2, i // 20, float(rng.randrange(side)), float(rng.randrange(900)), float(rng.randrange(60)), float(rng.randrange(25)), rng.choice([None, 0.3, 0.45, 0.65, 0.9]), reasons, "x"))
    left_out = [(1, 1, None, 1.0, 1.0, 1.0, 1.0, 0.9, [], "x"), (1, 1, 9000, None, 1.0, 1.0, 1.0, 0.9, [], "x"), (1, 1, 9001, 1.0, 1.0, -1.0, 1.0, 0.9, [], "x"), (1, 1, 9002, 1.0, 1.0, 1.0, None, 0.9, [], "x")]
    found = G.merged_text_boxes(spark.createDataFrame(boxes + left_out, FIELDS), ["doc", "page"])
    assert _rows(found) == _fold(boxes)
    levels = {(r.score, r.severity) for r in found.select("score", "severity").collect()}
    assert levels <= {(0.0, "LOW"), (0.3, "LOW"), (0.45, "MEDIUM"), (0.65, "HIGH"), (0.9, "HIGH")} and len(levels) >= 3


def test_text_regions_of_one_long_page_and_of_none(spark):
    rng = random.Random(12)
    boxes = [(1, 1, i, float(rng.randrange(200_000)), float(rng.randrange(3000)), 30.0, 12.0, 0.5, ["a"], "x") for i in range(10_000)]
    frame = spark.createDataFrame(boxes, FIELDS)
    assert _rows(G.merged_text_boxes(frame, ["doc", "page"])) == _fold(boxes)
    none = G.merged_text_boxes(frame.where("id < 0"), ["doc", "page"])
    assert none.count() == 0 and G.text_signal(none, ["doc"]).count() == 0


def test_islands_of_a_batch_are_merged_together(monkeypatch):
    """Short islands come out of a batch together, and as they come box by box; wherever batches end, with long islands, null keys and infinite places."""
    rng = random.Random(13)
    boxes = []
    for i in range(6000):
        doc = None if i % 90 == 0 else i % 1500 if i % 5 else 7
        reasons = [rng.choice("abc") for _ in range(rng.randrange(4))]
        boxes.append((doc, i % 2, rng.randrange(900), rng.choice([float(rng.randrange(200))] * 99 + [math.inf]), float(rng.randrange(90)), float(rng.randrange(60)), float(rng.randrange(25)), rng.choice([0.0, 0.3, 0.9]), reasons, 1))
    boxes.sort(key=lambda b: (b[0] is not None, b[:2] if b[0] is not None else b[1:2], *b[2:9]))
    fields = pa.schema([("doc", pa.int64()), ("page", pa.int32()), ("island", pa.int64()), ("id", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "w", "h", "score")), ("reasons", pa.list_(pa.string()))])
    rows = pa.table([pa.array(c, f.type) for c, f in zip(zip(*(b[:2] + b[9:] + b[2:9] for b in boxes), strict=True), fields, strict=True)], schema=fields)
    schema = pa.schema([f for f in fields if f.name != "island"]).append(pa.field("n_boxes", pa.int64()))
    want = _fold(boxes)
    for island, size in ((64, 6000), (64, 7), (3, 500), (0, 500)):
        monkeypatch.setattr(G, "ISLAND", island)
        found = list(G._merge(iter(rows.to_batches(max_chunksize=size)), 2, schema))
        got = sorted(((*r[:8], tuple(r[8]), r[9]) for b in found for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=repr)
        assert repr(got) == repr(want)
        if size == 6000:
            assert len(found) < 100 < len(want)  # there was a batch for every island


def test_text_signal(spark):
    rows = spark.createDataFrame([(1, 0.8), (2, 0.9), (2, 0.6), (3, 1.0), (3, 0.9), (3, 0.8), (3, 0.1)], "doc long, score double")
    assert {r.doc: round(r.signal, 6) for r in G.text_signal(rows, ["doc"]).collect()} == {1: 0.6, 2: 0.8625, 3: 0.975}


def test_cue_reasons(spark):
    names = "void background_gap background_step background_std paper_std paper_mean background_mean background_pixels ela near_ela ela_gap sharp near_sharp sharp_gap border w h".split()
    values = [0.555, 4.0, 5.0, 1.0, 2.5, 200.0, 205.0, 80, 12.0, 2.0, 2.125, 50.0, 10.0, 0.8, 200.0, 40, 20]
    rows = spark.createDataFrame([(True, *map(float, values)), (True, *[None] * len(names)), (False, *[0.0] * len(names))], "noisy boolean, " + ", ".join(f"{n} double" for n in names))
    found = [r[0] for r in rows.select(G.cue_reasons({c: F.col(c) for c in rows.columns})).collect()]
    assert found[1:] == [[], []]
    assert found[0] == [
        "Substrate noise void around text (void: 56%, local bg std: 1.00 vs doc: 2.50)",
        "Local ELA compression disparity (2.12x relative to neighboring text)",
        "Stroke rendering disparity (0.80x relative to neighboring text)",
        "Substrate brightness step in text patch (205.0 vs doc: 200.0)",
        "Paste / erasure perimeter boundary step (200.0)",
    ]
