"""Operators against brute force, exact round trips, held-out accuracy, SQL and edge cases."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import cost_packing, embedding_dedup, graph, line_dedup, merge_dropout, preference, prob_minhash, queries, suffix_dedup, textops, token_counts, topk, toxicity_chain
from attesta.llm.graph import connected_components
from attesta.llm.session import table
from tests.oracle import DATA, rows_of, rows_of_sql

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, ids string, key int"
LONG = " ".join(f"w{i * i % 7919}" for i in range(60_000))
#: Nulls, empty and very long texts, repeated rows, odd characters; the extra columns clash with internal names.
EDGES = [(1, None, None, None, None, "a", "b", 1), (2, "", "en", "s", 0, None, None, None), (3, "one two", "en", "s", 7, "a", "b", 1), (3, "one two", "en", "s", 7, "a", "b", 1), (4, LONG, "en", None, 9, "", "", 2), (5, LONG + " tail", "en", "s", 9, "", "", 2), (None, "no id " * 30, "en", "s", 3, "", "", 3), (6, "▁x  y\n\n\nz\t日本 é ﬁ \x00 <s> <|endoftext|>", "x", "s", 1, "", "", 1), (7, "!!!", "x", "s", 1, "", "", 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == rows_of_sql(queries.ORACLES[name])


@pytest.mark.parametrize("fold", [0, 1_000_000])
def test_components(spark, monkeypatch, fold):
    monkeypatch.setattr(graph, "FOLD", fold)
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def _brute_vectors(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = defaultdict(int), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, u), (j, v) = ok[a], ok[b]
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (links[i], find(i)) for i, _ in rows if i is not None}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [(int(k), [float(x) for x in np.float32(base[k % 60] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.4]))]) for k in range(500)]
    rows += [(600, rows[0][1]), (601, rows[0][1]), (602, [2 * x for x in rows[0][1]]), (603, None), (604, []), (605, [0.0] * 16), (606, [float("nan")] + [1.0] * 15), (607, [None] + [1.0] * 15), (608, [float("inf")] * 16), (609, [1.0, 2.0]), (610, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("copies", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    want = _brute_vectors(rows, 0.9)
    assert set(got) == set(want)
    assert sum(x for x, _ in got.values()) >= 0.99 * sum(x for x, _ in want.values()) and all(got[i][0] <= want[i][0] for i in got)
    assert got[603] == (0, 603) and got[605] == (0, 605) and got[609] == (1, 609) and got[601][0] == got[600][0]
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicate_vectors(df.where("vec_id IS NULL OR vec_id < 1").withColumn("vec_id", F.lit(None).cast("long"))).collect()[0].kept


def test_vectors_that_share_an_id(spark):
    """Rows with one vec_id and different vectors keep their own links."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (4, [0.0, 3.0])]
    got = sorted((r.vec_id, r.n_links) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (3, 2), (4, 2)]


@pytest.mark.parametrize("n, dims, block", [(1500, 24, 64), (6000, 64, 1024)])
def test_recall_of_links(spark, monkeypatch, n, dims, block):
    """Clusters around the threshold, a tenth of the rows in one of them, ends split into blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(n)
    centre = rng.standard_normal((n // 20, dims))
    which = np.where(rng.random(n) < 0.1, 0, rng.integers(0, n // 20, n))
    x = np.float32(centre[which] + rng.standard_normal((n, dims)) * rng.choice([0.1, 0.25, 0.4], n)[:, None])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    n_links = np.array([got[i] for i in range(n)])
    assert (n_links <= want + 1e-9).all() and want.sum() > n and n_links.sum() >= 0.99 * want.sum()


@pytest.mark.parametrize("rows", [3000, 10**6, 10**8])
def test_calibration_is_honest(rows):
    rng = np.random.default_rng(0)
    c = embedding_dedup.calibrate(rows, 0.9, 0.99)
    if rows > 3000:  # the window binds at every size: a share of unrelated pairs of an end lies outside
        assert 0.1 < math.exp(-c.tail * c.window) < 0.2 and c.collisions > 2
        return
    hits = 0
    for _ in range(400):
        u = rng.standard_normal(32)
        u /= np.linalg.norm(u)
        w = rng.standard_normal(32)
        w -= (w @ u) * u
        v = 0.9 * u + np.sqrt(1 - 0.81) * w / np.linalg.norm(w)
        p = rng.standard_normal((32, c.projections))
        a, b = u @ p, v @ p
        hits += (((np.abs(a) > c.tail) & (np.abs(b) > c.tail) & (a * b > 0) & (np.abs(a - b) <= c.window)).sum() >= c.collisions)
    assert hits / 400 > 0.97


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (2, 0, "user", None), (2, None, None, "x"), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("side", F.lit(0))
    got = {r.pair_id: r for r in preference.format_preferences(df, F.expr("floor(conv_id / 2)"), F.expr("pmod(conv_id, 2) = 0")).collect()}
    first = got[0]
    assert first.n_common == 3 and first.prompt == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nmore<|end|>\n"
    for text, mask, answer in ((first.chosen, first.chosen_mask, "good"), (first.rejected, first.rejected_mask, "bad")):
        assert [text[s.start : s.stop] for s in mask] == [answer + "<|end|>\n"]
    assert not got[1].paired and got[1].rejected == "" and got[1].chosen.startswith("<||>\nx") and got[1].chosen_mask == []
    assert (got[2].n_common, got[2].chosen, got[2].rejected) == (1, "", "") and set(got) == {0, 1, 2}
    assert preference.format_preferences(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_merge_dropout_of_each_occurrence(spark, docs, texts, edges, empty):
    each = lambda df, **k: merge_dropout.encode_with_dropout(df, PIECES, **k)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in each(docs, rate=0.0).collect()}
    assert plain == {k: sp.encode(v) for k, v in texts.items()}
    encoded = each(docs)
    back = {r.doc_id: r for r in merge_dropout.decode(encoded, PIECES).collect()}
    assert {k: r.text for k, r in back.items()} == texts
    assert 1.02 < sum(len(r.ids) / 4 for r in back.values()) / sum(map(len, plain.values())) < 1.2
    assert [r.ids for r in encoded.orderBy("doc_id").collect()] == [r.ids for r in encoded.repartition(3).orderBy("doc_id").collect()]
    same = spark.createDataFrame([(i, "international relations of the provinces") for i in range(64)], "doc_id long, text string")
    assert len({bytes(r.ids) for r in each(same, rate=0.3).collect()}) > 32
    again = each(spark.createDataFrame([(1, " ".join(["international"] * 200))], "doc_id long, text string"), rate=0.3).first().ids
    table_of = merge_dropout.MergeModel(PIECES).bytes
    words, spelled = set(), []
    for i in np.frombuffer(again, "<u4").tolist():
        if table_of[i].startswith(b" ") and spelled:
            words, spelled = words | {tuple(spelled)}, []
        spelled.append(i)
    assert len(words) > 20
    odd = merge_dropout.decode(each(edges, rate=0.3), PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in odd) == Counter((e[0], e[1] or "") for e in EDGES)
    assert each(empty).count() == 0
    assert len({r.ids_crc32 for r in queries.op3_merge_dropout(spark, DATA).where("n_bytes > 0").collect()}) > 100


def _segmented(model, parts, keys, rate):
    codes, starts, _ = merge_dropout.pre_tokens(["".join(parts)[1:].replace("▁", " ")])
    ids, begin = merge_dropout.segment(model, codes, starts, keys, rate)
    return [ids[a:b].tolist() for a, b in zip(begin, begin[1:])]


def _random_words(rng, n, most, letters="thereinanodsx日é"):
    return ["▁" + "".join(rng.choices(letters, k=rng.randint(1, most))) for _ in range(n)] + ["▁international", "▁the", "\n"] * 30


def test_bulk_and_heap_agree(monkeypatch):
    model, rng = merge_dropout.MergeModel(PIECES), random.Random(2)
    parts = _random_words(rng, 400, 60)
    keys = merge_dropout.occurrence_keys(np.arange(3, dtype=np.uint64), np.array([200, 0, 290]))
    assert len(set(keys.tolist())) == 490
    for rate in (0.0, 0.2, 0.5):
        many = _segmented(model, parts, keys, rate)
        with monkeypatch.context() as m:
            m.setattr(merge_dropout, "BULK", 0)
            assert many == _segmented(model, parts, keys, rate)


def _naive(model, part, key, rate):
    """Merge-dropout as it is told: while a candidate is left, the best one (leftmost of equals) is made, or dropped for good."""
    symbols, dropped = [(c, i) for i, c in enumerate(model.of_code[[ord(c) for c in part]].tolist())], set()
    while True:
        pairs = [(*model.merges[a, b], i) for i, ((a, p), (b, _)) in enumerate(zip(symbols, symbols[1:])) if (a, b) in model.merges and (p, a, b) not in dropped]
        if not pairs:
            return [s for s, _ in symbols]
        _, merged, i = min(pairs, key=lambda x: (x[0], x[2]))
        (a, p), (b, _) = symbols[i : i + 2]
        if merge_dropout.skipped(np.array([key], np.uint64), *(np.array([x], np.int64) for x in (p, a, b)), rate)[0]:
            dropped.add((p, a, b))
        else:
            symbols[i : i + 2] = [(merged, p)]


def test_dropout_against_naive_segmentation():
    model, rng = merge_dropout.MergeModel(PIECES), random.Random(3)
    parts = _random_words(rng, 200, 14, "thereinandosx") * 2
    keys = merge_dropout.occurrence_keys(np.arange(2, dtype=np.uint64), np.array([150, 430]))
    for rate in (0.1, 0.4):
        for part, key, ids in zip(parts, keys.tolist(), _segmented(model, parts, keys, rate), strict=True):
            want = _naive(model, part, key, rate)
            if max(want) < len(model.bytes):
                assert ids == want


def test_token_counts(docs, texts, edges, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert got == {k: (len(v.encode()), n := len(sp.encode(v)), n > 4096) for k, v in texts.items()}
    for frequent in (0, 100, token_counts.FREQUENT):  # all joined, some, none
        counts = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(edges, PIECES, frequent=frequent).collect())
        assert counts == Counter((e[0], len((e[1] or "").encode()), len(sp.encode(e[1] or ""))) for e in EDGES)
        assert token_counts.count_tokens(empty, PIECES, frequent=frequent).count() == 0
    some = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PIECES, frequent=2000).collect()}
    assert some == {k: v[1] for k, v in got.items()}


def test_packing(docs, texts, edges, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    for df, want in ((docs, [(k, v) for k, v in texts.items()]), (edges, [(e[0], e[1] or "") for e in EDGES])):
        rows = cost_packing.pack(df, WORDS).collect()
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append(r)
        for pieces in sequences.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at and len(r.ids) == 4 * r.length
                at += r.length
            assert at <= 4096
        padding = 1 - sum(r.length for r in rows) / (4096 * len(sequences))
        assert padding < 4096 / sum(r.length for r in rows)
        ids = {(k, tuple(tokenizer.encode(v, add_special_tokens=False).ids + [2])) for k, v in want}
        whole = defaultdict(list)
        for r in sorted(rows, key=lambda r: r.start):
            whole[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        for k, found in ids:
            if sum(x == k for x, _ in want) == 1:
                assert tuple(i for _, part, _ in whole[k] for i in part) == found and {n for *_, n in whole[k]} == {len(found)}
    assert cost_packing.pack(empty, WORDS).count() == 0


def test_packing_over_shards_and_other_tokenizers(spark, monkeypatch):
    """Several shards, many rows without doc_id, and a tokenizer file with rules of its own."""
    monkeypatch.setattr(cost_packing, "SHARD_TOKENS", 400)
    rows = [(i if i % 2 else None, " ".join(f"Word{i * k % 97}," for k in range(i % 50))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tokenizer, found = Tokenizer.from_file(path), cost_packing.pack(df, path, capacity=64).collect()
        shards = Counter(r.sequence_id >> 32 for r in found if r.doc_id is None)
        assert len(shards) > 5 and max(shards.values()) < 0.5 * sum(shards.values())
        used = Counter()
        for r in found:
            used[r.sequence_id] += r.length
        assert max(used.values()) <= 64
        whole = defaultdict(list)
        for r in sorted(found, key=lambda r: r.start):
            if r.doc_id is not None:
                whole[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert whole == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in rows if i is not None}


def test_balanced_costs():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 4096, 300)
    places = cost_packing.balanced(sizes)
    used, cost = Counter(), Counter()
    for _, _, n, s in places:
        used[s] += n
        cost[s] += cost_packing.LINEAR * n + cost_packing.QUADRATIC * n * n
    assert max(used.values()) <= 4096 and sum(used.values()) == sizes.sum() and len(used) == -(-sizes.sum() // 4096)
    assert all(sum(n for p, _, n, _ in places if p == i) == sizes[i] for i in range(300))


def test_word_encoder():
    tokenizer, rng = Tokenizer.from_file(WORDS), random.Random(4)
    signs = ["ªº", "µŉ", "×", "ß", "ñ$$$", "#a", *" \n\t\x0b\x1c\x85 　aAéÉ日1²_'sΣσςİıẞ.,!?;:़​\x00", "é", "<|endoftext|>", "'ll", "ab.", "cd, ", "😀"]
    for encoder in (cost_packing.WordEncoder(WORDS), cost_packing.WordEncoder(WORDS, 20)):
        for _ in range(3000):
            s = "".join(rng.choices(signs, k=rng.randint(0, 12)))
            assert np.frombuffer(encoder.encode(s), encoder.kind).tolist() == tokenizer.encode(s, add_special_tokens=False).ids, s
    assert len(encoder.known) <= 10 and len(encoder.known.before) <= 10


def _shingles(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _jp(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in set(x) & set(y))


def test_near_duplicates(spark, edges, empty):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(25):
        base = rng.choices(words, k=120)
        for edits in (0, 1, 2, 3, 4, 6, 0):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((k, " ".join(t) + (" again and again and again" * (k % 2)), k))
            k += 1
    rows += [(k, "A b, c!", 0), (k + 1, "a B c", 0), (k + 2, None, 0), (k + 3, "", 0), (k + 4, "!!", 0)]
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string, key long")).collect()}
    sets, root = [(i, _shingles(t)) for i, t, _ in rows], {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and _jp(x, y) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in root}
    odd = prob_minhash.near_duplicate_documents(edges).collect()
    assert len(odd) == len(EDGES) and {r.doc_id: r.class_id for r in odd} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, None: None}
    assert prob_minhash.near_duplicate_documents(empty).count() == 0


def _brute_classes(rows, threshold=0.8):
    """Class of each row by all pairs that share a shingle, each held against the other."""
    sets, where, root = {i: _shingles(t) for i, t in rows}, defaultdict(list), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, shingles in sets.items():
        for shingle in shingles:
            where[shingle].append(i)
    for i, shingles in sets.items():
        for j, shared in Counter(j for shingle in shingles for j in where[shingle] if j < i).items():
            if shared >= 0.5 * max(len(shingles), len(sets[j])) and find(i) != find(j) and _jp(shingles, sets[j]) >= threshold:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}


def _variants(rng, words, n, sizes):
    """Texts of one theme with few words changed, and strangers that share most of it but not enough."""
    base, rows = rng.choices(words, k=90), []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice(sizes)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("block", [3, 1024])
def test_mixed_buckets_in_blocks(spark, monkeypatch, block):
    """One large class with strangers around the threshold, split into many pieces of work."""
    monkeypatch.setattr(prob_minhash, "BLOCK", block)
    rng = random.Random(block)
    rows = _variants(rng, [f"word{i}" for i in range(400)], 160, [0, 1, 1, 2, 3, 5, 8])
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute_classes(rows)


def test_near_duplicates_of_the_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicate_documents(docs).collect()}
    assert got == _brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_pieces_of_a_bucket_cover_each_pair_once(spark, monkeypatch):
    """No piece holds two members of the main class against each other; every other pair of different classes comes in exactly one."""
    monkeypatch.setattr(prob_minhash, "BLOCK", 4)
    rows = [("a", i, 0 if i < 21 else i // 3, 1) for i in range(33)] + [("b", i, 0 if i < 9 else 1, 1) for i in range(10)] + [("c", i, 5, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "key string, node long, label long, bytes long")
    marks = np.zeros(prob_minhash.REGISTERS, np.uint8).tobytes()
    pieces = prob_minhash._blocked(df, spark.range(40).select(F.col("id").alias("node"), F.lit(bytearray(marks)).alias("marks")))
    met, every = Counter(), pieces.toArrow().combine_chunks()
    of = list(zip(*(every[c].to_pylist() for c in ("key", "part", "low", "high")), strict=True))
    for piece in set(of):
        group = every.take([i for i, x in enumerate(of) if x == piece]).combine_chunks()
        nodes = group["node"].to_pylist()
        for u, v, _ in prob_minhash._candidates(group, 0):
            met.update((piece[0], *sorted((nodes[u], nodes[x]))) for x in v.tolist())
    label = {(k, n): x for k, n, x, _ in rows}
    assert met == Counter((k, n, m) for k, n in label for j, m in label if j == k and n < m and label[k, n] != label[k, m])


def test_prob_minhash_estimates():
    a = np.sort(textops.mix(np.arange(0, 800, dtype=np.uint64)))
    b = np.sort(textops.mix(np.arange(200, 1000, dtype=np.uint64)))
    one = np.ones(800)
    owner = np.repeat([0, 1], 800)
    sig = prob_minhash.signatures(owner, np.concatenate([a, b]), np.concatenate([one, one]), 2)
    assert abs(prob_minhash.probability_jaccard(a, one, b, one) - 0.6) < 1e-9
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15


def test_topk_edges(spark):
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, [-0.001, 0.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk.exact_top_k(v, v.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 128 * 256), (0, 2, 1, 128 * 128 + 64 * 64), (0, 3, 2, 128 * 128 + 64 * 64)]
    assert topk.exact_top_k(v, v.where("vec_id = 99"), 3).count() == 0


def test_topk_over_blocks_and_waves(spark, monkeypatch):
    """Several waves, query blocks and candidate blocks, with a third of the rows equal."""
    for name, value in (("QUERY_ROWS", 64), ("CANDIDATE_ROWS", 300), ("WAVE_QUERIES", 150)):
        monkeypatch.setattr(topk, name, value)
    x = np.random.default_rng(1).integers(-3, 4, (4000, 6))
    x[::3] = x[0]
    v = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(x)], "vec_id long, q array<long>").repartition(5)
    got = sorted(tuple(r) for r in topk.exact_top_k(v, v.where("vec_id % 13 = 0")).collect())
    want = []
    for i in range(0, 4000, 13):
        s = x @ x[i]
        want += [(i, r + 1, j, int(s[j])) for r, j in enumerate([j for j in np.lexsort((np.arange(4000), -s)).tolist() if j != i][:5])]
    assert got == want
    repeated = v.where("vec_id < 3").union(v.where("vec_id = 2"))
    assert [r.vec_id for r in topk.exact_top_k(repeated, v.where("vec_id = 0")).orderBy("rank").collect()].count(2) == 2
    assert topk.exact_top_k(v.limit(0), v.where("vec_id = 0")).count() == 0 and topk.exact_top_k(v, v.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    """Sums beyond 64 bits are ordered exactly as far as a long can show them."""
    rows = [(0, [1e12, -3.0]), (1, [1e12, 2.0]), (2, [-1e12, 2.0]), (3, [1e300, 0.5]), (4, [0.25, 0.5]), (5, [3e7, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    most, got = 2**63 - 1, defaultdict(list)
    for r in topk.exact_top_k(v, v.where("vec_id IN (0, 4)")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0] == [(1, most), (3, most), (5, most), (4, 64 * 256 * 10**12 - 128 * 768), (2, -most)]
    assert got[4] == [(3, most), (1, 64 * 256 * 10**12 + 128 * 512), (0, 64 * 256 * 10**12 - 128 * 768), (5, 64 * 7680000000 + 128 * 256), (2, -64 * 256 * 10**12 + 128 * 512)]


def test_line_dedup_edges(spark, edges, empty):
    got = line_dedup.drop_boilerplate(edges).collect()
    assert len(got) == len(EDGES) and all(r.n_dropped == 0 for r in got)
    assert line_dedup.drop_boilerplate(empty).count() == 0
    pages = [(i, "h" if i < 40 else None, f"own {i}\nbanner\n\nend {i}") for i in range(45)]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, source string, text string"), ratio=0.5).collect()}
    assert all(out[i].text == f"own {i}\n\nend {i}" and out[i].n_dropped == 1 for i in range(45))


def test_line_dedup_keeps_columns_of_any_name(spark):
    pages = [(i, "h", f"banner\nown {i}", i, "x") for i in range(20)]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, source string, text string, __keys long, __host string"), ratio=0.5).collect()
    assert sorted((r.doc_id, r.text, r["__keys"], r["__host"]) for r in out) == [(i, f"own {i}", i, "x") for i in range(20)]


def test_toxicity_held_out(spark, edges, empty):
    data = "/root/testdata/sf0.1"
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    models = toxicity_chain.train(docs, labels.where("doc_id % 3 <> 0"), most=2500)
    rows = toxicity_chain.score(docs, models).join(labels, "doc_id").where("doc_id % 3 = 0").select("rejected", "toxic").collect()
    hit = sum(r.rejected and r.toxic for r in rows)
    assert hit / max(1, sum(r.rejected for r in rows)) > 0.9 and hit / sum(r.toxic for r in rows) > 0.85
    odd = toxicity_chain.score(edges, models).collect()
    assert len(odd) == len(EDGES) and not any(r.rejected for r in odd if r.doc_id in (1, 2, 7))
    assert toxicity_chain.drop_toxic(edges, models).columns == edges.columns
    assert toxicity_chain.score(empty, models).count() == 0 and toxicity_chain.train(empty, labels.limit(0)) == []
    assert not any(r.rejected for r in toxicity_chain.score(edges, []).collect())


def test_toxicity_with_other_ids(spark):
    """Ids of any type: the same texts get the same chain, whatever their ids are; so out-of-fold folds follow the ids' order."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    named = lambda df: df.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    got = {r.doc_id: r.rejected for r in toxicity_chain.score(named(docs), toxicity_chain.train(named(docs), named(labels))).collect()}
    want = {f"{r.doc_id:012d}": r.rejected for r in toxicity_chain.score(docs, toxicity_chain.train(docs, labels)).collect()}
    assert got == want


def test_chain_uses_out_of_fold_predictions(spark):
    """The models are those of a plain chain fitted fold by fold: later links see predictions of models that didn't see the row."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity_chain.train(docs, labels)
    y_of = {r.doc_id: [int(r.quality == 0), int(r.toxic == 1)] for r in labels.collect()}
    texts = sorted((r.doc_id, (r.text or "").lower()) for r in docs.collect() if r.doc_id in y_of)
    data = np.frombuffer("".join(t for _, t in texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in texts])])
    owner, feature, words = toxicity_chain.features(data, offsets)
    pairs = Counter(zip(owner.tolist(), feature.tolist(), strict=True))
    order = sorted(pairs)
    owner, feature = (np.array(x) for x in zip(*order, strict=True))
    value = toxicity_chain.rates(np.array([pairs[x] for x in order]), np.maximum(words, 1)[owner])
    y, n = np.array([y_of[i] for i, _ in texts], float), len(texts)
    inside = np.arange(n) % toxicity_chain.FOLDS
    earlier = np.zeros((n, 0))
    for link in range(2):
        own, apart = [], np.zeros(n)
        for f in [None, *range(toxicity_chain.FOLDS)]:
            rows = inside != f if f is not None else np.ones(n, bool)
            chosen = toxicity_chain.select(owner, feature, y[:, link], rows)
            x = toxicity_chain.dense(owner, feature, value, chosen, earlier)
            w = toxicity_chain.logistic(x[rows], y[rows, link])
            if f is None:
                own = (chosen, w)
            else:
                apart[~rows] = toxicity_chain.sigmoid(x[~rows] @ w)
        assert got[link]["chosen"] == own[0].tolist() and np.allclose(got[link]["w"], own[1], rtol=1e-4, atol=1e-6)
        assert link or not np.allclose(apart, toxicity_chain.sigmoid(toxicity_chain.dense(owner, feature, value, own[0], earlier) @ own[1]))
        earlier = np.column_stack([earlier, apart])


def test_pairs_of_large_conversation_numbers(spark):
    rows = [(c, 0, "user", f"t{c}") for c in (2**53 + 2, 2**53 + 3, -3, -4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = preference.format_preferences(turns, F.shiftright("conv_id", 1), F.expr("pmod(conv_id, 2) = 0")).collect()
    assert sorted((r.pair_id, r.paired) for r in got) == [(-2, True), (2**52 + 1, True)]


def _brute_repeats(rows):
    first, out = {}, []
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda x: x[0]):
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 49):
            if i is not None and first[b[j : j + 50]] < i:
                gone[j : j + 50] = 1
        out.append((i, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest(), int((np.diff(np.concatenate([[0], gone])) == 1).sum())))
    return Counter(out)


def _repeats(df):
    got = suffix_dedup.remove_repeats(df).select("doc_id", F.sha2("kept", 256).alias("s"), F.size("spans").alias("n")).collect()
    return Counter((r.doc_id, r.s, r.n) for r in got)


def test_repeats_against_brute_force(spark, docs, texts, empty):
    assert _repeats(docs) == _brute_repeats(list(texts.items()))
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcé ", k=rng.randint(40, 120))) for _ in range(12)] + ["=" * 90, "ab" * 60]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 9) :] + rng.choice(["", "#", "xyz"]) for _ in range(rng.randint(0, 5)))) for i in rng.sample(range(1000), 150)]
    rows += [(2000, None), (2001, ""), (2002, pool[0]), (2003, pool[0]), (2003, pool[0]), (-5, pool[1] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("h", F.lit(1))
    assert _repeats(df.repartition(5)) == _brute_repeats(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    loose = spark.createDataFrame([(None, "z" * 200), (1, "z" * 200)], "doc_id long, text string")
    assert all(r.spans == [] for r in suffix_dedup.remove_repeats(loose).collect())


@pytest.mark.parametrize("anchors", [1, 5000])
def test_a_group_of_many_strings_is_sorted_in_slices(monkeypatch, anchors):
    """A million strings of one anchor or many take no more memory than a slice needs beside the bytes, and slices change nothing."""
    rng = np.random.default_rng(3)
    runs = 60_000
    body = rng.integers(97, 123, (runs, 67), np.uint8)
    body[runs // 2 : runs // 2 + 900, 5:60] = body[:900, 5:60]
    body[:900, [4, 60]] = 33  # other bytes stand around the repeats: 55 bytes, thus six strings each
    h = np.arange(runs) % (runs // 2) % anchors
    cells = suffix_dedup._cells(h=(h, "<i8"), doc=(np.arange(runs), "<i8"), tag=(h * 0, "<i4"), first=(h * 0, "<i4"), size=(h * 0 + 67, "<i4"), content=(body, "u1"), known=(h * 0, "u1"))
    group = pa.table(cells)
    run = suffix_dedup._resolved(1)
    run(group.slice(0, 0))
    tracemalloc.start()
    got = run(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    owner, start, stop = (np.frombuffer(got[c][0].as_py(), t).tolist() for c, t in (("doc", "<i8"), ("start", "<i4"), ("stop", "<i4")))
    assert list(zip(owner, start, stop, strict=True)) == [(runs // 2 + k, 5, 60) for k in range(900)]
    assert peak < 150 << 20
    monkeypatch.setattr(suffix_dedup, "STRINGS", 1 << 30)
    assert run(group).equals(got)


def test_hash_collisions_are_verified(monkeypatch):
    s = suffix_dedup.Suffixes(np.frombuffer(b"abcdabce" * 2, np.uint8))
    s.sums[:] = 0  # every hash agrees
    order, differs = s.sort(np.zeros(4, np.int64), np.array([0, 4, 8, 12]), np.full(4, 4))
    assert order.tolist() == [0, 2, 1, 3] and differs.tolist() == [True, False, True, False]


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == corpus_pipeline.COLUMNS, name
        n = after.count()
        assert 0.5 * docs.count() < n <= docs.count()
        docs = after
    assert corpus_pipeline.run(spark, DATA).select(F.sum("length")).first()[0] > 0
