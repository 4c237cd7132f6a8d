"""Clusters, secrets and hard negatives against brute force, with edge cases."""

import hashlib
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from attesta.llm import hard_negatives, kd_clusters, secret_scan
from attesta.llm.topk import MOST

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = secret_scan.encoding(RANKS, PATTERN)


def _brute_clusters(rows, k, rounds, dims):
    """rows: (vec_id, list of ints); the same by plain integers, one by one."""
    kept = [(i, q) for i, q in rows if i is not None and q is not None and len(q) == dims]
    z = [q for _, q in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda q: min(range(len(z)), key=lambda c: (away(q, z[c]), c))
    for _ in range(rounds):
        own = [nearest(q) for _, q in kept]
        z = [[sum(q[j] for (_, q), o in zip(kept, own, strict=True) if o == c) // own.count(c) for j in range(dims)] if c in own else z[c] for c in range(len(z))]
    own = [(i, nearest(q), q) for i, q in kept]
    inertia = {c: sum(away(q, z[c]) for _, o, q in own if o == c) for c in range(len(z))}
    return sorted((i, o, min(away(q, z[o]), MOST), min(inertia[o], MOST), min(sum(inertia.values()), MOST), hashlib.sha256(",".join(map(str, z[o])).encode()).hexdigest()) for i, o, q in own)


@pytest.mark.parametrize("spread, scale", [(3, 40), (0, 5), (1, 3_000_000_000), (1, 2**61)])
def test_clusters_against_brute_force(spark, monkeypatch, spread, scale):
    """Small trees; ties and repeated rows; components of every width, beyond exact doubles and beyond 64-bit sums."""
    monkeypatch.setattr(kd_clusters, "TREE_ROWS", 61)
    monkeypatch.setattr(kd_clusters, "LEAF_ROWS", 4)
    rng = random.Random(scale)
    centre = [[rng.randrange(-scale, scale + 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + rng.randrange(-spread, spread + 1) for x in centre[rng.randrange(9)]]) for i in range(240)]
    rows += [(1, [0, 0, 0, 0]), (1, [0, 0, 0, 0]), (None, [1, 1, 1, 1]), (900, None), (901, [1, 2]), (902, [])]
    df = spark.createDataFrame(rows, "vec_id long, q array<long>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(None).cast("int")).repartition(3)
    got = sorted(map(tuple, kd_clusters.centroid_clusters(df, k=12, rounds=3, dims=4).collect()))
    assert got == _brute_clusters(rows, 12, 3, 4)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(5, [1, 2]), (6, [1, 2]), (7, [9, 9])], "vec_id long, q array<long>")
    assert sorted((r.vec_id, r.distance) for r in kd_clusters.centroid_clusters(df, k=40, dims=2).collect()) == [(5, 0), (6, 0), (7, 0)]
    for none in (df.limit(0), df.where("vec_id < 0"), df.withColumn("q", F.array(F.lit(1).cast("long")))):
        assert kd_clusters.centroid_clusters(none, k=40, dims=2).count() == 0


def test_tree_filter_prunes_and_keeps_ties():
    """Whole nodes are assigned far from borders; a point on a border goes to the smaller number."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 9, (500, 3)), rng.integers(1000, 1009, (500, 3)), np.array([[500, 4, 4]])])
    _, tree = kd_clusters.build(points, 16)
    c = kd_clusters.Centroids([[4, 4, 4], [996, 4, 4], [1004, 1004, 1004], [4, 4, 4]], 1009)
    whole, single = c.filtered(tree)
    assert sum(int(np.diff(tree.bounds[n], axis=1).sum()) for n, _ in whole) > 800
    assert sum(int(np.diff(tree.bounds[n], axis=1).sum()) for n, _ in whole) + sum(len(at) for at, _ in single) == len(points)
    assert c.resolve(np.array([[500, 4, 4]]), np.arange(4)).tolist() == [0]


def _brute_scan(text):
    """Base forms as stated, match by match; then every maximal run."""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    out = list(base)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) >= 20 and not any(a < m.end() and m.start() < b for a, _, b in base) and not secret_scan.known(m[0]):
            tokens = sum(len(VOCABULARY.encode_ordinary(m[0][i : i + 256])) for i in range(0, len(m[0]), 256))
            if len(m[0]) / tokens < 1.9:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _texts(rng, n):
    make = lambda alphabet, size: "".join(rng.choices(alphabet, k=size))
    parts = [
        lambda: rng.choice(["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "paſſword", "toKen"]) + rng.choice(["=", ": ", '" : "', "  =  '", " "]) + make(string.ascii_letters + "0123456789+/_.=-", rng.randrange(30)),
        lambda: "secret=token: " + make(string.ascii_letters, 14),
        lambda: "AKIA" + make(string.ascii_uppercase + string.digits, rng.randrange(24)),
        lambda: make("0123456789abcdef", rng.randrange(45)),
        lambda: make(string.ascii_letters + string.digits + "+/_=-", rng.randrange(60)),
        lambda: make(string.ascii_lowercase + string.digits, rng.randrange(300)),
        lambda: rng.choice(["getUserNameFromRequest", "some_snake_case_identifier", "123e4567-e89b-12d3-a456-426614174000", "2024-01-01T00-00-00", "4111111111111111222", "été ", "日本", "\U0001f600"]),
        lambda: make(string.ascii_uppercase + string.digits, 40),
        lambda: rng.choice([" ", "\n", " the quick brown fox ", ".", "", "x" * 600]),
    ]
    return ["".join(rng.choice(parts)() + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_secrets_against_brute_force(spark):
    rng = random.Random(4)
    texts = _texts(rng, 1500) + ["a" * 30, "Zk3" * 9, "q8Zr1" * 5, "", "tail q8Z" + "r1xW" * 5]
    rows = [(i, t, None, "x") for i, t in enumerate(texts)] + [(None, "AKIA" + "Z" * 20, None, "x"), (3, None, None, "x"), (3, None, None, "x"), (4, "q8Zr1Yw3" * 60_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind string").coalesce(2)
    got = sorted((r.doc_id if r.doc_id is not None else -1, [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in r.spans]) for r in secret_scan.secret_spans(df, RANKS, PATTERN).collect())
    assert got == sorted((i if i is not None else -1, _brute_scan(t or "")) for i, t, *_ in rows)
    assert {k for _, spans in got for _, k, _ in spans} == {0, 1, 2, 3}
    assert secret_scan.secret_spans(df.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("run", ["123e4567-e89b-12d3-a456-426614174000", "2390409500648960123456", "2024-01-01T10-00-00Z", "getUserNameFromRequest", "some_snake_case_identifier", "sha256-" + "Ab3/" * 10 + "Abc=", "D41D8CD98F00B204E9800998ECF8427E"])
def test_digests_and_identifiers_are_known(run):
    assert secret_scan.known(run)


def test_random_strings_are_found_and_words_are_not():
    rng = random.Random(2)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for n in (24, 32, 40) for _ in range(100)]
    assert sum(any(k == 3 for _, k, _ in secret_scan.scan(f"see {key} there", VOCABULARY)) for key in keys) >= 297
    assert secret_scan.scan("internationalisation/of-the-documentation and counterrevolutionaries", VOCABULARY) == []


def _brute_negatives(rows, every, positives, negatives):
    kept = [(i, label, q) for i, label, q in rows if i is not None and label is not None and q is not None]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    anchors = {}
    for i, label, q in kept:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, q)), (label, q))
    for i, (label, q) in anchors.items():
        others = sorted((-score(q, x), j, own == label) for j, own, x in kept if j != i)
        for minus, p, _ in [r for r in others if r[2]][:positives]:
            fit = [(j, -s) for s, j, same in others if not same and 30 * -minus <= 100 * -s <= 90 * -minus][:negatives]
            out += [(i, p, rank, j, -minus, s) for rank, (j, s) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, block, wave", [(30, 7, 4), (3, 1024, 16_384), (2**29, 16, 9)])
def test_negatives_against_brute_force(spark, monkeypatch, scale, block, wave):
    """Few values make many ties; a third of the rows are copies; several waves, small blocks, wide components."""
    for name, value in (("BLOCK_ROWS", block), ("WAVE_ANCHORS", wave), ("GATHERED", 100), ("TOGETHER", 5), ("TARGET_ROWS", 6), ("SCOUT", 3), ("LISTS", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(scale + block)
    one = [rng.randrange(1, scale) for _ in range(5)]
    rows = [(i, rng.randrange(4), one if rng.random() < 0.33 else [rng.randrange(-scale, 2 * scale) for _ in range(5)]) for i in range(400)]
    rows += [(20, 1, one), (20, 2, [1, 1, 1, 1, 1]), (None, 1, one), (500, None, one), (520, 1, None), (540, 2, [3, 4]), (560, 2, []), (580, 9, one), (7, 1, one)]
    df = spark.createDataFrame(rows, "vec_id long, label int, q array<long>").withColumn("asks", F.lit("x")).withColumn("target", F.lit(1)).repartition(3)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [tuple((i, p, r, j, ps, s)) for i, p, r, j, ps, s in _brute_negatives(rows, 20, 5, 10)]


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, [1, 2]), (2, 2, [1, 2])], "vec_id long, label int, q array<long>")
    for rows, asks in ((df.limit(0), F.lit(True)), (df, F.lit(False)), (df, F.lit(None).cast("boolean")), (df, F.lit(True))):
        assert hard_negatives.hard_negatives(rows, asks).count() == 0
