"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import textops
from attesta.llm.graph import merged
from attesta.llm.session import cut, cut_narrow

#: Words of a shingle; registers of a signature, as BANDS bands of ROWS registers.
SHINGLE, BANDS, ROWS = 5, 33, 6
REGISTERS = BANDS * ROWS
#: Standard errors below the threshold at which an estimate still goes to verification.
SLACK = 4.0
#: Up to this many documents with a candidate are broadcast as ids to pick their texts; more are joined.
BROADCAST_IDS = 500_000
#: A bucket with more documents or bytes is split into blocks, each pair of which is one group of work.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
_GOLDEN = np.uint64(textops.BASE)


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text index, hash, count), by text then hash; and a 128-bit digest of each text's words (two columns)."""
    hashes, first = textops.words(data, offsets)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(hashes)) - first[text]
    digest = np.zeros((len(n), 2), np.uint64)
    for k, base in enumerate((textops.BASE, textops.INVERSE)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * textops.powers(base, int(n.max(initial=0)) + 1)[at], dtype=np.uint64)])
        digest[:, k] = textops.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
    whole = np.flatnonzero(n[text] - at >= size)
    run = np.zeros(len(whole), np.uint64)
    for k in range(size):
        run = run * _GOLDEN + hashes[whole + k]
    few = np.flatnonzero((n > 0) & (n < size))
    short = np.array([textops.shingles(hashes[first[i] : first[i + 1]], size)[0] for i in few], np.uint64)
    owner, value = np.concatenate([text[whole], few]), np.concatenate([textops.mix(run), short])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], value[begin], np.diff(np.append(begin, len(owner))), digest


def signatures(owner: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """ProbMinHash: for each text and register the shingle whose arrival there is earliest.

    A shingle arrives by a Poisson process with its count as rate, each time at a
    register drawn uniformly; times and registers come from its hash alone. A process
    ends when its next arrival is later than the text's latest register.
    """
    time = np.full(texts * REGISTERS, np.inf)
    best = np.zeros(texts * REGISTERS, np.uint64)
    arrival, step = np.zeros(len(owner)), 0
    while len(owner):
        step += 1
        random = textops.mix(value + np.uint64(step * textops.BASE % 2**64))
        arrival = arrival - np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / count
        register = owner * REGISTERS + (textops.mix(random ^ _GOLDEN) % np.uint64(REGISTERS)).astype(np.int64)
        earlier = np.flatnonzero(arrival < time[register])
        earlier = earlier[np.argsort(-arrival[earlier], kind="stable")]  # of several, the earliest is written last
        time[register[earlier]] = arrival[earlier]
        best[register[earlier]] = value[earlier]
        latest = time.reshape(texts, REGISTERS).max(axis=1)
        alive = arrival < latest[owner]
        owner, value, count, arrival = owner[alive], value[alive], count[alive], arrival[alive]
    return best.reshape(texts, REGISTERS)


def probability_jaccard(xh: np.ndarray, xw: np.ndarray, yh: np.ndarray, yw: np.ndarray) -> float:
    """Sum over shared elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). Hashes ascend; with equal weights it is Jaccard."""
    at = np.searchsorted(yh, xh)
    at[at == len(yh)] = 0
    both = np.flatnonzero(yh[at] == xh) if len(yh) else np.zeros(0, np.int64)
    if xw.max(initial=1) == 1 and yw.max(initial=1) == 1:
        return len(both) / max(len(xh) + len(yh) - len(both), 1)
    x, y = xw[both].astype(float), yw[at[both]].astype(float)
    order = np.argsort(-x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    upto = np.searchsorted(-ratio, -ratio, "right")  # those with at least this ratio come first
    xs, ys = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    only_x, only_y = xw.sum() - xs[-1], yw.sum() - ys[-1]
    return float((1 / ((only_x + xs[upto]) / x + (only_y + ys[-1] - ys[upto]) / y)).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textops.buffers(batch.column(1))
        for i, j in textops.slices(offsets):
            owner, value, count, digest = weighted_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            has = np.zeros(j - i, bool)
            has[owner] = True
            rank = np.cumsum(has) - 1
            best = signatures(rank[owner], value, count, int(has.sum()))
            keys = np.zeros((len(best), BANDS), np.uint64)
            for r in range(ROWS):
                keys = keys * _GOLDEN + best[:, r::ROWS]
            keys = textops.mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            rows = np.flatnonzero(has)
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(digest[rows, 0].view(np.int64)), pa.array(digest[rows, 1].view(np.int64)), listed, _packed((best & np.uint64(0xFF)).astype(np.uint8))],
                ["id", "a", "b", "bands", "marks"],
            )


def _packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each picked text's shingles as packed hashes and counts, once; rows whose words are not those of the node are left out."""
    for batch in batches:
        data, offsets = textops.buffers(batch.column("text"))
        own = np.column_stack([batch.column(c).to_numpy() for c in ("a", "b")])
        for i, j in textops.slices(offsets):
            owner, value, count, digest = weighted_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows = np.flatnonzero((digest.view(np.int64) == own[i:j]).all(axis=1))
            begin, end = np.searchsorted(owner, rows), np.searchsorted(owner, rows, "right")
            kinds = ["<u1" if count[a:b].max(initial=0) < 256 else "<u4" for a, b in zip(begin, end, strict=True)]
            hashes = [value[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
            counts = [count[a:b].astype(k).tobytes() for a, b, k in zip(begin, end, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows + i)), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["node", "hashes", "counts"])


def _set(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    value = np.frombuffer(hashes, np.uint64)
    return value, np.frombuffer(counts, "<u1" if len(counts) == len(value) else "<u4")


def _verifier(threshold: float):
    """The pairs whose sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*(batch.column(c) for c in ("hu", "cu", "hv", "cv")), strict=True)
            near = [k for k, (hu, cu, hv, cv) in enumerate(cells) if probability_jaccard(*_set(hu.as_py(), cu.as_py()), *_set(hv.as_py(), cv.as_py())) >= threshold]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(near, pa.int64())) for c in ("u", "v")], ["u", "v"])

    return run


def _least(threshold: float) -> float:
    """Registers that a candidate pair has in common at least; marks that agree by chance only add to it."""
    return threshold * REGISTERS - SLACK * (threshold * (1 - threshold) * REGISTERS) ** 0.5


def _candidates(group: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a piece of a bucket with those of other classes that agree enough, and how much they do; each pair once.

    Part 0 holds a block of the bucket's main class and a block of the others, which are held against each other; part 1 one or two blocks of the others.
    """
    part, across = group["part"][0].as_py(), group["low"][0].as_py() != group["high"][0].as_py()
    label, side, main = group["label"].to_numpy(), group["side"].to_numpy(), group["inside"].to_numpy(zero_copy_only=False)
    marks = np.frombuffer(b"".join(group["marks"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
    every = np.flatnonzero(main)
    for u in np.flatnonzero(~main).tolist() if part == 0 else range(len(label) - 1):
        v = every if part == 0 else np.flatnonzero((label[u + 1 :] != label[u]) & ((side[u + 1 :] != side[u]) | (not across))) + u + 1
        if len(v):
            same = (marks[v] == marks[u]).sum(axis=1)
            near = same >= least
            yield u, v[near], same[near]


def _nearest(threshold: float):
    """For each document of a bucket (or two of its blocks) the one of another class that agrees most, if any agrees enough."""
    least = _least(threshold)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group["node"].to_numpy()
        best, most = np.full(len(node), -1), np.zeros(len(node), np.int64)
        for u, v, same in _candidates(group, least):
            if len(v):
                k = int(same.argmax())
                if same[k] > most[u]:
                    best[u], most[u] = v[k], same[k]
                better = same > most[v]
                best[v[better]], most[v[better]] = u, same[better]
        found = np.flatnonzero(best >= 0)
        return pa.Table.from_pydict({"u": node[found], "v": node[best[found]], "same": most[found]})

    return run


def _settle(threshold: float):
    """Links between documents of one bucket (or two of its blocks) that are in different classes so far, likeliest pairs first."""
    least = _least(threshold)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, label = group["node"].to_numpy(), group["label"].to_numpy()
        classes = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while classes[x] != x:
                x = classes[x]
            return x

        parts = [(np.full(len(v), u), v, same) for u, v, same in _candidates(group, least)]
        found: list[tuple[int, int]] = []
        if parts:
            us, vs, same = (np.concatenate(x) for x in zip(*parts, strict=True))
            sets = [_set(h, c) for h, c in zip(group["hashes"].to_pylist(), group["counts"].to_pylist(), strict=True)]
            for k in np.argsort(-same, kind="stable").tolist():
                u, v = int(us[k]), int(vs[k])
                a, b = root(int(label[u])), root(int(label[v]))
                if a != b and probability_jaccard(*sets[u], *sets[v]) >= threshold:
                    classes[max(a, b)] = min(a, b)
                    found.append((int(node[u]), int(node[v])))
        return pa.Table.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


def _blocked(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """``rows`` (key, node, label, bytes) of the buckets that hold several classes with what is ``carried`` by node, dealt over pieces of work (key, part, low, high).

    A bucket's largest class needs no comparing within itself: its blocks meet those of the other classes (part 0), and these each other (part 1). So a large
    class with few strangers is moved once, and work follows the strangers.
    """
    counted = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    most = F.max(F.struct("n", "label", "bytes"))
    mixed = counted.groupBy("key").agg(most.alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes")).where("classes > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    others = F.col("n") - F.col("main.n")
    sized = cut_narrow(mixed.select("key", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("mains"), blocks(others, F.col("bytes") - F.col("main.bytes")).alias("rests"), others.alias("others")))
    dealt = rows.select("key", "node", "label").join(sized, "key").join(carried, "node").withColumn("inside", F.col("label") == F.col("main"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    piece = lambda part, low, high: F.struct(F.lit(part).alias("part"), low.alias("low"), high.alias("high"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    side, alone = F.col("side"), F.col("others") == 1
    outside = F.concat(upto("mains", lambda i: piece(0, i, side)), F.when(alone, F.filter(upto("rests", lambda j: piece(1, j, j)), lambda _: F.lit(False))).otherwise(upto("rests", lambda j: piece(1, F.least(side, j), F.greatest(side, j)))))
    pieces = F.when(F.col("inside"), upto("rests", lambda j: piece(0, side, j))).otherwise(outside)
    return dealt.withColumn("piece", F.explode(pieces)).drop("main", "mains", "rests", "others").select("*", "piece.*").drop("piece")


def near_duplicate_documents(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``documents`` (doc_id long, text): doc_id, class_id, kept.

    Two documents are linked when the probability Jaccard similarity of their
    five-word shingles, weighted by count, is at least ``threshold`` (with no repeated
    shingle that is the Jaccard similarity). Words are runs of letters, digits and
    non-ASCII characters, in lower case; a text of fewer words is one shingle.
    ``class_id`` is the smallest doc_id reachable by links, ``kept`` whether it is the
    row's own. Texts that are null, empty or without words are in classes of their own. Rows
    without doc_id get no class and are kept. Rows that share a doc_id share a class, whatever their texts.
    Further columns are ignored; an empty table gives an empty result.

    Documents with the same words (by a 128-bit digest) are one node. Nodes that agree in a band
    are candidates. Rounds of linear work come first: each node is held against one
    pivot of its buckets, then against the node of another class in its buckets whose signature agrees
    most with its own. Buckets that still hold different classes of nodes that agree enough are
    settled whole, likeliest pairs first, in pairs of blocks bounded by rows and bytes; the members of a bucket's largest class are held
    against its other members only. All verification is on
    the packed shingle sets, made once per node. So no link between classes is lost beyond
    what banding and estimates miss (chance below 0.001 at the threshold), and tasks send on
    one partner per node or links between classes, never a group's pairs.
    """
    own = documents.select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    signed = cut(own.where(F.col("id").isNotNull()).mapInArrow(textops.returning(_sign), "id long, a long, b long, bands array<long>, marks binary"))
    signed = signed.withColumn("node", F.monotonically_increasing_id())
    nodes = cut_narrow(signed.groupBy("a", "b").agg(F.min("node").alias("node")))
    members = cut_narrow(signed.select("id", "a", "b").join(nodes, ["a", "b"]).select("id", "node").distinct())
    single = signed.join(nodes.select("node"), "node", "left_semi")
    keyed = single.select("node", F.explode("bands").alias("key"))
    pivots = cut_narrow(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot"))
    buckets = cut_narrow(keyed.join(pivots, "key").select("key", "node", "pivot"))
    pairs = cut_narrow(buckets.where("node <> pivot").groupBy(F.col("node").alias("u")).agg(F.min("pivot").alias("v")))
    few = cut_narrow(buckets.select("node").distinct().join(single.select("node", "id", "a", "b"), "node"))
    picked = own.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, "id").select("node", "a", "b", "text")
    sets = cut(picked.mapInArrow(textops.returning(_sets), "node long, hashes binary, counts binary").dropDuplicates(["node"]))
    again = members.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u < v").select("id", "u")
    again = cut_narrow(members.join(again, "id").select("u", F.col("node").alias("v")))

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}"), F.col("counts").alias(f"c{c}")) for c in ("u", "v"))
        return cut_narrow(pairs.join(left, "u").join(right, "v").select("u", "v", "hu", "cu", "hv", "cv").mapInArrow(textops.returning(_verifier(threshold)), "u long, v long"))

    labels = few.select("node").union(again.select("u")).union(again.select("v")).distinct().withColumn("label", F.col("node"))
    labels = merged(cut_narrow(labels), verified(pairs).union(again))
    marks = single.select("node", "marks")
    dealt = _blocked(buckets.select("key", "node").join(labels, "node").withColumn("bytes", F.lit(REGISTERS)), marks)
    nearest = dealt.groupBy("key", "part", "low", "high").applyInArrow(textops.returning_group(_nearest(threshold)), "u long, v long, same long")
    partner = cut_narrow(nearest.groupBy("u").agg(F.max_by("v", F.struct("same", "v")).alias("v")))
    labels = merged(labels, verified(partner.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()))
    left = labels.join(partner.select(F.col("u").alias("node")), "node", "left_semi").join(sets.select("node", F.octet_length("hashes").alias("bytes")), "node")
    dealt = _blocked(buckets.select("key", "node").join(left, "node"), marks.join(sets, "node"))
    labels = merged(labels, cut_narrow(dealt.groupBy("key", "part", "low", "high").applyInArrow(textops.returning_group(_settle(threshold)), "u long, v long")))
    classed = members.join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("label"))
    least = cut_narrow(classed.groupBy("label").agg(F.min("id").alias("class_id")))
    found = classed.join(least, "label").select("id", "class_id").distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, F.col("doc_id") == F.col("id"), "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
