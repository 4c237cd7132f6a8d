"""Removal of passages that also stand in an earlier document, by hash-compared suffix sorting."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import textops
from attesta.llm.session import bound_batches, cut

#: Bytes of a repeated string, and of the anchors inside that bring equal strings together.
SPAN, ANCHOR = 50, 16
#: Anchors that a string of SPAN bytes has to choose from.
WINDOW = SPAN - ANCHOR + 1
#: First bytes that strings are dealt by before they are compared through hashes.
HEAD = 24
#: Bytes beside an anchor that a string is sure to have on one side at least.
SIDE = WINDOW // 2
#: Text bytes of a group of work at most, about; there are as many groups as shuffle partitions at least.
GROUP_BYTES = 8 << 20
#: Strings of an anchor or more that are sorted at a time, about; bounds the memory of a group.
STRINGS = 1 << 18
#: Up to this many copies of whole documents are broadcast as ids; more are joined.
BROADCAST_IDS = 500_000

_U = np.uint64
_LOW = _U(63)


def anchored(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of neighbouring SPAN-byte strings with the same anchor: anchor hash, first and last string's start, hashes left and right of the anchor.

    A string's anchor is the one of its WINDOW substrings of ANCHOR bytes with the least
    hash, so equal strings have equal anchors wherever they stand. Strings don't cross
    texts. Beside its anchor a string has at least SIDE bytes on the left or on the right, so
    equal strings agree in one of the side hashes too (one byte each; elsewhere they are of no account).
    """
    total = len(data) - SPAN + 1
    for s in range(0, total, textops.STEP):
        n = min(textops.STEP, total - s)
        lead = min(s, SIDE)
        sums = textops.prefix_hashes(data[s - lead : s + n + SPAN - 1 + SIDE])
        inverse = textops.powers(textops.INVERSE, len(sums))
        m = n + WINDOW - 1
        h = textops.mix((sums[lead + ANCHOR : lead + ANCHOR + m] - sums[lead : lead + m]) * inverse[lead : lead + m])
        places = np.arange(m, dtype=np.uint64)
        least = (h & ~_LOW) | (places & _LOW)
        reach = 1
        while 2 * reach <= WINDOW:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:n], least[WINDOW - reach : WINDOW - reach + n])
        anchor = (places[:n] + ((least - places[:n]) & _LOW)).astype(np.int64)
        _leftmost(anchor, h >> _U(6))
        over = np.zeros(n + 1, np.int64)  # strings that start less than SPAN bytes before a text's end
        ends = offsets[1:-1]
        ends = ends[(ends > s) & (ends < s + n + SPAN - 1)] - s
        np.add.at(over, np.clip(ends - SPAN + 1, 0, n), 1)
        np.add.at(over, np.clip(ends, 0, n), -1)
        valid = np.cumsum(over)[:n] == 0
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], n) - 1
        begin, last = begin[valid[begin]], last[valid[begin]]
        at = anchor[begin]
        top = len(sums) - 1
        side = lambda a, b: (textops.mix((sums[b] - sums[a]) * inverse[a]) >> _U(56)).astype(np.uint8)  # noqa: B023, E731
        left = side(np.maximum(lead + at - SIDE, 0), lead + at)
        right = side(np.minimum(lead + at + ANCHOR, top), np.minimum(lead + at + ANCHOR + SIDE, top))
        yield h[at] >> _U(24), begin + s, last + s, left, right


def _leftmost(anchor: np.ndarray, h: np.ndarray) -> None:
    """Moves anchors, string by string, to the first of equal hashes in the string: content alone decides."""
    head, n = _runs(anchor)
    p = anchor[head]
    again = np.zeros(len(p), bool)
    for d in range(1, WINDOW):
        again |= (h[np.maximum(p - d, 0)] == h[p]) & (p >= d)
    strings = np.flatnonzero(np.repeat(again, n))
    for i in range(0, len(strings), 1 << 14):
        x = strings[i : i + (1 << 14)]
        anchor[x] = x + (h[x[:, None] + np.arange(WINDOW)] == h[anchor[x]][:, None]).argmax(axis=1)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _cells(**columns: tuple[np.ndarray, str]) -> dict[str, pa.Array]:
    """One row with each array as bytes of its type."""
    return {k: pa.array([_bytes(a.astype(t))], pa.binary()) for k, (a, t) in columns.items()}


def _column(group: pa.Table, name: str, kind: str) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in group[name].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(x)))


def _shared(key: np.ndarray, doc: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Whether a key stands with two different documents, or with a string that is known to."""
    order = np.argsort(key, kind="stable")
    begin, n = _runs(key[order])
    out = np.zeros(len(key), bool)
    if len(begin):
        several = np.minimum.reduceat(doc[order], begin) != np.maximum.reduceat(doc[order], begin)
        if known is not None:
            several |= np.logical_or.reduceat(known[order], begin)
        out[order] = np.repeat(several, n)
    return out


#: Packed strings: documents as runs (doc, tag, n), then for each string the anchor's hash in two parts, side hashes, start in two parts, and length with the known bit.
_STRINGS = "bucket int, doc binary, tag binary, n binary, h_low binary, h_high binary, left binary, right binary, at_low binary, at_high binary, more binary"


def _smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most GROUP_BYTES of text, or one row."""
    for batch in batches:
        for i, j in textops.slices(textops.buffers(batch.column(2))[1], GROUP_BYTES):
            yield batch.slice(i, j - i)


def _emitter(buckets: int):
    """Each text's anchored strings, packed by bucket of the anchor's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _smaller(batches):
            data, offsets = textops.buffers(batch.column(2))
            docs, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            parts = list(anchored(data, offsets))
            if not parts:
                continue
            h, first, last, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = np.searchsorted(offsets, first, "right") - 1
            first, more = first - offsets[row], last - first
            # Equal neighbourhoods of two documents of this batch are known to repeat: one string of them
            # goes to the anchor's bucket, the others anywhere, so that frequent anchors fill no bucket.
            triple = (h << _U(16)) | (left.astype(np.uint64) << _U(8)) | right
            known = _shared(triple, docs[row])
            order = np.argsort(triple, kind="stable")
            heads = np.zeros(len(h), bool)
            heads[order[_runs(triple[order])[0]]] = True
            bucket, away = (h % _U(buckets)).astype(np.int32), known & ~heads
            bucket[away] = np.arange(away.sum()) % buckets
            for b, i in _dealt(bucket):
                begin, n = _runs(row[i])
                at = row[i[begin]]
                cells = _cells(doc=(docs[at], "<i8"), tag=(tags[at], "<i4"), n=(n, "<u4"), h_low=(h[i], "<u4"), h_high=(h[i] >> _U(32), "u1"), left=(left[i], "u1"), right=(right[i], "u1"), at_low=(first[i], "<u2"), at_high=(first[i] >> 16, "<u2"), more=(more[i] + 128 * known[i], "u1"))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32())} | cells)

    return run


_REPEATING = "part int, doc binary, tag binary, h binary, first binary, last binary"


def _part(doc: np.ndarray, parts: int) -> np.ndarray:
    """A hash of each doc_id; ``_part_column`` is the same on Spark's side."""
    ids, at = np.unique(doc, return_inverse=True)
    return (np.array([zlib.crc32(str(x).encode()) for x in ids.tolist()], np.int64) % parts).astype(np.int32)[at]


def _part_column(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)).cast("int")


def _dealt(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each place that occurs with the indices of its rows, in order."""
    order = np.argsort(place, kind="stable")
    begin, n = _runs(place[order])
    for b, z in zip(begin.tolist(), n.tolist(), strict=True):
        yield int(place[order[b]]), order[b : b + z]


def _by_part(part: np.ndarray, **columns: tuple[np.ndarray, str]) -> pa.Table:
    """Rows packed by part, one row each."""
    rows = [{"part": pa.array([p], pa.int32())} | _cells(**{k: (a[i], t) for k, (a, t) in columns.items()}) for p, i in _dealt(part)]
    empty = pa.table({"part": pa.array([], pa.int32())} | {k: pa.array([], pa.binary()) for k in columns})
    return pa.concat_tables([empty, *[pa.table(r) for r in rows]])


def _repeating(parts: int):
    """Of a bucket's strings, those whose anchor and one side stand in two documents or more."""

    def run(group: pa.Table) -> pa.Table:
        n = _column(group, "n", "<u4")
        doc, tag = np.repeat(_column(group, "doc", "<i8"), n), np.repeat(_column(group, "tag", "<i4"), n)
        h = (_column(group, "h_high", "u1").astype(np.uint64) << _U(32)) | _column(group, "h_low", "<u4")
        more = _column(group, "more", "u1")
        known = more >= 128
        found = known.copy()
        for side in ("left", "right"):
            found |= _shared((h << _U(8)) | _column(group, side, "u1"), doc, known)
        first = (_column(group, "at_high", "<u2").astype(np.int64) << 16) | _column(group, "at_low", "<u2")
        return _by_part(_part(doc[found], parts), doc=(doc[found], "<i8"), tag=(tag[found], "<i4"), h=(h[found], "<i8"), first=(first[found], "<i4"), last=((first + (more & 127))[found], "<i4"))

    return run


_PASSAGES = "bucket int, h binary, doc binary, tag binary, first binary, size binary, content binary, known binary"


def _rows_of(texts: pa.Table, doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Row of ``texts`` with each (doc, tag), or -1."""
    ids = texts["doc_id"].combine_chunks()
    rows = {(d, t): k for k, (d, t) in enumerate(zip(ids.to_pylist(), texts["tag"].to_pylist(), strict=True))}
    return np.array([rows.get(x, -1) for x in zip(doc.tolist(), tag.tolist(), strict=True)], np.int64)


def _cutter(buckets: int):
    """The bytes of each repeating string run, packed by bucket. Of equal ones in a part only the earliest document's go on; the others are known repeats."""

    def run(texts: pa.Table, strings: pa.Table) -> pa.Table:
        data, offsets = textops.buffers(texts["text"].combine_chunks())
        doc, tag, h = _column(strings, "doc", "<i8"), _column(strings, "tag", "<i4"), _column(strings, "h", "<i8")
        first, last = _column(strings, "first", "<i4").astype(np.int64), _column(strings, "last", "<i4").astype(np.int64)
        row = _rows_of(texts, doc, tag)
        begin, size = offsets[row] + first, last - first + SPAN
        content = [data[b : b + z].tobytes() for b, z in zip(begin.tolist(), size.tolist(), strict=True)]
        least: dict[tuple[int, bytes], int] = {}
        for key in zip(h.tolist(), content, doc.tolist(), strict=True):
            if key[2] < least.get(key[:2], key[2] + 1):
                least[key[:2]] = key[2]
        known = np.array([least[a, c] < d for a, c, d in zip(h.tolist(), content, doc.tolist(), strict=True)], np.uint8)
        bucket = np.where(known, np.arange(len(h)) % buckets, h % buckets).astype(np.int32)
        rows = []
        for b, i in _dealt(bucket):
            cells = _cells(h=(h[i], "<i8"), doc=(doc[i], "<i8"), tag=(tag[i], "<i4"), first=(first[i], "<i4"), size=(size[i], "<i4"))
            rows.append(pa.table({"bucket": pa.array([b], pa.int32())} | cells | {"content": pa.array([b"".join(content[k] for k in i if not known[k])], pa.binary()), "known": pa.array([_bytes(known[i])], pa.binary())}))
        empty = pa.table({"bucket": pa.array([], pa.int32())} | {k: pa.array([], pa.binary()) for k in ("h", "doc", "tag", "first", "size", "content", "known")})
        return pa.concat_tables([empty, *rows])

    return run


class Suffixes:
    """Suffixes of byte strings, compared through prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums, self.powers = data, textops.prefix_hashes(data), textops.powers(textops.BASE, len(data) + 1)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix at a and b, up to ``most``: a binary search over hashes of prefixes."""
        lo, hi, pa_, pb = np.zeros_like(most), most.copy(), self.powers[a], self.powers[b]
        while True:
            mid = (lo + hi + 1) // 2
            if (open_ := lo < hi).sum() == 0:
                return lo
            same = (self.sums[a + mid] - self.sums[a]) * pb == (self.sums[b + mid] - self.sums[b]) * pa_
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def before(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the string at a sorts before that at b (or equals it, where ``or_equal``)."""
        most = np.minimum(a_size, b_size)
        common = self.extension(a, b, most)
        ended, top = common == most, len(self.data) - 1
        less = self.data[np.minimum(a + common, top)] < self.data[np.minimum(b + common, top)]
        return np.where(ended, (a_size < b_size) | ((a_size == b_size) & or_equal), less)

    def sort(self, group: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by group, then string; and whether each in that order differs from the one before.

        Strings are dealt by their first HEAD bytes; those that agree so far are mergesorted, all such classes
        at once: runs of doubling length are merged by binary search of each string in the
        neighbouring run. Strings found equal are compared byte by byte; should a hash have
        deceived, the bytes are sorted themselves.
        """
        if len(size) and size.min() >= HEAD:
            group = self._headed(group, begin)
        order = np.argsort(group, kind="stable")
        g = group[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(g)))
        base, count = np.repeat(start, length), np.repeat(length, length)
        width, most = 1, int(length.max(initial=0))
        while width < most:
            p = np.flatnonzero(count > width)
            r = p - base[p]
            mine = r // width
            other = base[p] + (mine ^ 1) * width
            stop = np.minimum(other + width, base[p] + count[p])
            here = other < stop
            p, r, mine, other, stop = p[here], r[here], mine[here], other[here], stop[here]
            x, right = order[p], (mine & 1) == 1
            lo, hi = other.copy(), stop.copy()
            todo = np.arange(len(p))
            while len(todo):
                mid = (lo[todo] + hi[todo]) // 2
                y, z = order[mid], x[todo]
                goes = self.before(begin[y], size[y], begin[z], size[z], right[todo])
                lo[todo], hi[todo] = np.where(goes, mid + 1, lo[todo]), np.where(goes, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            place = base[p] + (mine // 2) * 2 * width + (r - mine * width) + (lo - other)
            order[place] = x
            width *= 2
        differs = np.ones(len(order), bool)
        a, b = order[:-1], order[1:]
        maybe = np.flatnonzero((group[a] == group[b]) & (size[a] == size[b]))
        a, b = a[maybe], b[maybe]
        equal = self.extension(begin[a], begin[b], size[a]) == size[a]
        differs[maybe[equal] + 1] = False
        for i in range(0, len(a), 1 << 16):  # verification
            e = equal[i : i + (1 << 16)]
            x, y = a[i : i + (1 << 16)][e], b[i : i + (1 << 16)][e]
            if len(x):
                step = np.arange(int(size[x].max()))
                inside = step < size[x][:, None]
                top = len(self.data) - 1
                if ((self.data[np.minimum(begin[x][:, None] + step, top)] != self.data[np.minimum(begin[y][:, None] + step, top)]) & inside).any():
                    return self._sort_bytes(group, begin, size)
        return order, differs

    def _headed(self, group: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Rank of each string's group and first HEAD bytes."""
        head = np.lib.stride_tricks.sliding_window_view(self.data, HEAD)[begin].view(">u8").astype(np.uint64)
        keys = (*head.T[::-1], group)
        order = np.lexsort(keys)
        new = np.zeros(len(order), np.int64)
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _sort_bytes(self, group: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = [(g, self.data[b : b + s].tobytes()) for g, b, s in zip(group.tolist(), begin.tolist(), size.tolist(), strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        return order, np.array([not i or keys[order[i]] != keys[order[i - 1]] for i in range(len(order))], bool)


def _earlier(suffixes: Suffixes, group: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether an equal string of the group stands in a document with a smaller id: its neighbours in the sorted order tell."""
    out = np.zeros(len(group), bool)
    if len(group):
        order, differs = suffixes.sort(group, begin, size)
        least = np.minimum.reduceat(doc[order], np.flatnonzero(differs))
        out[order] = least[np.cumsum(differs) - 1] < doc[order]
    return out


def _in_slices(suffixes: Suffixes, group: np.ndarray, begin: np.ndarray, strings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Run and place in it of each SPAN-byte string of the runs, about STRINGS at a time; those that are equal and of one group come together.

    Whole groups make a slice. A group of more strings than that is dealt by a hash of the strings themselves.
    """
    order = np.argsort(group, kind="stable")
    head, n = _runs(group[order])
    if not len(head):
        return
    for i, j in textops.slices(np.append(0, np.cumsum(np.add.reduceat(strings[order], head))), STRINGS):
        runs = order[head[i] : head[j - 1] + n[j - 1]]
        m = strings[runs]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        run = np.repeat(runs, m)
        deals = -(-len(at) // STRINGS)
        if deals == 1:
            yield run, at
            continue
        deal = np.empty(len(at), np.uint16 if deals < 1 << 16 else np.int64)
        for k in range(0, len(at), STRINGS):
            a = begin[run[k : k + STRINGS]] + at[k : k + STRINGS]
            deal[k : k + STRINGS] = textops.mix((suffixes.sums[a + SPAN] - suffixes.sums[a]) * suffixes.powers[len(suffixes.data) - a]) % _U(deals)
        for _, x in _dealt(deal):
            yield run[x], at[x]


_RANGES = "part int, doc binary, tag binary, start binary, stop binary"


def _resolved(parts: int):
    """Byte ranges to remove: whole string runs that an earlier document has too, then single strings of the runs left."""

    def run(group: pa.Table) -> pa.Table:
        h, doc, tag = _column(group, "h", "<i8"), _column(group, "doc", "<i8"), _column(group, "tag", "<i4")
        first, size, known = _column(group, "first", "<i4").astype(np.int64), _column(group, "size", "<i4").astype(np.int64), _column(group, "known", "u1") > 0
        suffixes = Suffixes(_column(group, "content", "u1"))
        left = np.flatnonzero(~known)
        begin = np.zeros(len(h), np.int64)
        begin[left] = np.cumsum(size[left]) - size[left]
        gone = _earlier(suffixes, h[left], begin[left], size[left], doc[left])
        whole = np.concatenate([np.flatnonzero(known), left[gone]])
        left = left[~gone]
        found = [(left[:0], left[:0])]
        for k, at in _in_slices(suffixes, h[left], begin[left], size[left] - SPAN + 1):
            owner = left[k]
            gone = _earlier(suffixes, h[owner], begin[owner] + at, np.full(len(owner), SPAN), doc[owner])
            found.append((owner[gone], at[gone]))
        owner, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        # neighbouring strings of a run make one range
        joins = np.zeros(len(at), bool)
        joins[1:] = (owner[1:] == owner[:-1]) & (at[1:] - at[:-1] <= SPAN)
        head = np.flatnonzero(~joins)
        tail = np.append(head[1:], len(at)) - 1 if len(at) else head
        owners = np.concatenate([whole, owner[head]])
        start = np.concatenate([first[whole], first[owner[head]] + at[head]])
        stop = np.concatenate([first[whole] + size[whole], first[owner[head]] + at[tail] + SPAN])
        return _by_part(_part(doc[owners], parts), doc=(doc[owners], "<i8"), tag=(tag[owners], "<i4"), start=(start, "<i4"), stop=(stop, "<i4"))

    return run


def _remover(whole_characters: bool):
    """Cuts the ranges out of each text; bytes of characters cut in two go too where only whole ones are wanted."""
    part = (lambda x: x.decode("utf-8", "ignore").encode()) if whole_characters else bytes

    def run(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        data, offsets = textops.buffers(texts["text"].combine_chunks())
        doc, start, stop = _column(ranges, "doc", "<i8"), _column(ranges, "start", "<i4").astype(np.int64), _column(ranges, "stop", "<i4").astype(np.int64)
        # Rows that repeat a (doc_id, tag) hold the same text: each takes the ranges of the last of them.
        last = _rows_of(texts, *(np.array(texts[c].fill_null(-1).to_pylist(), np.int64) for c in ("doc_id", "tag")))
        row = _rows_of(texts, doc, _column(ranges, "tag", "<i4"))
        order = np.lexsort((start, row))
        row, start, stop = row[order], start[order], stop[order]
        kept, spans = [], []
        for k in range(texts.num_rows):
            text = data[offsets[k] : offsets[k + 1]]
            i, j = np.searchsorted(row, (last[k], last[k] + 1)) if last[k] >= 0 else (0, 0)
            found: list[tuple[int, int]] = []
            if i < j:
                s, e = start[i:j], np.maximum.accumulate(stop[i:j])
                head = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                found = list(zip(s[head].tolist(), e[np.append(head[1:], len(s)) - 1].tolist(), strict=True))
            at = [0, *[x for pair in found for x in pair], len(text)]
            kept.append(b"".join(part(text[a:b].tobytes()) for a, b in zip(at[::2], at[1::2], strict=True)))
            spans.append([{"start": a, "stop": b} for a, b in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        cells = [texts["doc_id"], texts["tag"], pa.array(np.diff(offsets), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
        names = ["doc_id", "tag", "n_bytes", "spans", "kept"]
        return pa.Table.from_arrays([*cells, texts["rest"]] if "rest" in texts.column_names else cells, [*names, "rest"] if "rest" in texts.column_names else names)

    return run


def remove_repeats(documents: DataFrame, carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """One row per row of ``documents`` (doc_id long, text): doc_id, tag, n_bytes, spans, kept, and the columns ``carry`` as a struct ``rest``.

    Texts are UTF-8 bytes. A byte is removed when a SPAN-byte string that covers it also
    starts in a document with a smaller doc_id; all strings are judged on the input.
    ``spans`` are the maximal removed runs as array<struct<start, stop>>, ``kept`` the
    remaining bytes (binary; valid UTF-8 with ``whole_characters``, which also takes away
    what is left of a character cut in two), ``tag`` a hash of the text. A null text counts as empty, texts
    below SPAN bytes stay whole. Rows without doc_id stay whole and remove nothing.
    Rows that share a doc_id don't remove from each other. Further columns are ignored.

    Copies of whole documents are settled by a hash of the text. In the others each
    SPAN-byte string has an anchor, the ANCHOR bytes in it with the least hash; runs of
    neighbouring strings with one anchor (18 on average) travel as about 12 packed bytes to
    the anchor's bucket, and only those whose anchor and one side of it stand in two documents are looked
    at further. Their bytes come together by anchor and are suffix sorted: first whole runs, then
    single strings of the runs that no earlier document has. Equal runs of a part go on
    once, so frequent passages fill no bucket. Both visits to the texts share one shuffle of them by document.
    The session's Arrow batches are bounded from then on (``bound_batches``).
    """
    spark = documents.sparkSession
    bound_batches(spark)
    rest = [F.struct(*carry).alias("rest")] if carry else []
    tag = F.coalesce(F.hash("text"), F.lit(0))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), F.coalesce("text", F.lit("")).alias("text"), *rest)
    named = rows.where(F.col("doc_id").isNotNull())
    digests = cut(named.select("doc_id", "tag", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("int").alias("n")))
    total = digests.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_BYTES))
    digests = digests.where(F.col("n") >= SPAN)
    # Cut, so that adaptive execution can split the largest group of copies over tasks.
    least = cut(digests.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("sha", "least"))
    copies = cut(digests.join(least, "sha").where("doc_id > least").select("doc_id", "tag", "n").distinct())
    ids = copies.select("doc_id", "tag")
    single = named.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "tag"], "left_anti")
    strings = single.select("doc_id", "tag", "text").mapInArrow(textops.returning(_emitter(buckets)), _STRINGS)
    repeating = strings.groupBy("bucket").applyInArrow(textops.returning_group(_repeating(buckets)), _REPEATING)
    parted = named.withColumn("part", _part_column(buckets))
    passages = parted.groupBy("part").cogroup(repeating.groupBy("part")).applyInArrow(textops.returning_pair(_cutter(buckets)), _PASSAGES)
    ranges = passages.groupBy("bucket").applyInArrow(textops.returning_group(_resolved(buckets)), _RANGES)
    whole = copies.withColumn("part", _part_column(buckets)).select("part", _little_endian("doc_id", 8).alias("doc"), _little_endian("tag", 4).alias("tag"), F.lit(bytes(4)).alias("start"), _little_endian("n", 4).alias("stop"))
    schema = "doc_id long, tag int, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    removed = parted.groupBy("part").cogroup(ranges.union(whole).groupBy("part"))
    removed = removed.applyInArrow(textops.returning_pair(_remover(whole_characters)), schema + (f", rest {dict(rows.dtypes)['rest']}" if carry else ""))
    unnamed = rows.where(F.col("doc_id").isNull())
    spans = F.array().cast("array<struct<start:long,stop:long>>")
    unnamed = unnamed.select("doc_id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), spans.alias("spans"), F.encode("text", "UTF-8").alias("kept"), *(["rest"] if carry else []))
    return removed.unionByName(unnamed)


def _little_endian(column: str, width: int) -> Column:
    """A whole number as the ``width`` bytes of one packed value."""
    digits = F.lpad(F.hex(F.col(column).cast("long")), 16, "0")
    return F.substring(F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")), 1, width)
