"""SentencePiece BPE encoding with seeded merge-dropout, and its lossless decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from attesta.llm import textops

SPACE = "▁"
#: Stands for a word mark that is part of the text itself; as a lone surrogate it occurs in no text.
LITERAL = "\ud881"
#: Bytes of text segmented at once.
WALKED = 1 << 20
#: Longest pre-token segmented in bulk; longer ones go through a heap, one by one.
BULK = 48
#: Text that a model with a normaliser of its own would change.
_PROBE = "  ﬁ Å A\u030a\tb\n c  ２ ς "
_NONE = np.iinfo(np.int32).max
_WORD = 2**64 - 1


class MergeModel:
    """Vocabulary of a SentencePiece BPE model as a table of merges: (left, right) -> merged symbol, best score first."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        if model.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("the model changes texts before it cuts them, so ids would not decode to the text")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces cross word marks or line breaks; pre-tokens of this model are not independent")
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b""] * n
        for piece, i in self.ids.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        # Characters without a piece of their own are symbols from n on; they end up as bytes.
        self.symbols = dict(self.ids)  # symbol of each piece and character
        for c in sorted({c for p in self.ids for c in p}):
            self.symbols.setdefault(c, n + len(self.symbols))
        #: Symbol of each code point; one without a symbol is unknown, and its place says which it is.
        self.of_code = np.full(0x110000, n + len(self.symbols), np.int64)
        single = {ord(p): i for p, i in self.symbols.items() if len(p) == 1}
        self.of_code[list(single)] = list(single.values())
        merges = [(self.symbols[p[:k]], self.symbols[p[k:]], i, model.get_score(i)) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols]
        order = {s: r for r, s in enumerate(sorted({m[3] for m in merges}, reverse=True))}
        self.merges = {(left, right): (order[s], i) for left, right, i, s in merges}
        keys = np.array([(left << 32) | right for left, right in self.merges], np.int64)
        # Open addressing: a pair lies in the first free slot from its hash on, and most of eight slots are free.
        self._shift = np.uint64(64 - (8 * len(keys)).bit_length())
        slots = 1 << (8 * len(keys)).bit_length()
        self._keys, number = np.full(slots + len(keys), -1, np.int64), np.full(slots + len(keys), -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self._keys[at[left]] < 0]
            self._keys[at[free]], number[at[free]] = keys[free], free
            left = left[number[at[left]] != left]
            at[left] += 1
        self._ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int32), _NONE)[number]
        self._merged = np.append(np.array([i for _, i in self.merges.values()], np.int64), 0)[number]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the rank of a pair that doesn't merge is _NONE."""
        key = (left << 32) | right
        at = self._slot(key)
        held = self._keys[at]
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            at[on] += 1
            held = self._keys[at[on]]
            on = on[(held != key[on]) & (held >= 0)]
        return self._ranks[at], self._merged[at]


def skipped(word: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate merge of ``left`` at character ``at`` with ``right`` is dropped: a hash under the word's key."""
    x = textops.mix(word ^ textops.mix((at.astype(np.uint64) << np.uint64(40)) ^ (left.astype(np.uint64) << np.uint64(20)) ^ right.astype(np.uint64)))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def _skipped_one(word: int, at: int, left: int, right: int, rate: float) -> bool:
    """The same for one candidate."""
    return (_mixed(word ^ _mixed(at << 40 ^ left << 20 ^ right)) >> 11) * 2.0**-53 < rate


def _mixed(x: int) -> int:
    """``textops.mix`` of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _WORD
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _WORD
    return x ^ x >> 31


def _one(model: MergeModel, symbols: list[int], key: int, rate: float) -> tuple[list[int], list[int]]:
    """Agenda of one pre-token's symbols as a heap: symbols and the characters they start at."""
    n = len(symbols)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i] if i >= 0 else n
        if i >= 0 and j < n and (found := model.merges.get((symbols[i], symbols[j]))):
            if not _skipped_one(key, i, symbols[i], symbols[j], rate):
                heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n):
        offer(i)
    while agenda:
        _, i, a, b, merged = heapq.heappop(agenda)
        j = right[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # a neighbour has changed since
        symbols[i], symbols[j], right[i] = merged, -1, right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    kept = [i for i in range(n) if symbols[i] >= 0]
    return [symbols[i] for i in kept], kept


def _bulk(model: MergeModel, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
    """Agendas of many pre-tokens at once, a row of ``symbols`` each, ended by -1: in each round every one makes its best merge left.

    Gives the symbols left, each in the column of its first character; -1 elsewhere. Symbols never move: cells
    are linked to the next and the last one left of their row, so a round touches one merge's cells and looks for the row's best.
    """
    rows, wide = symbols.shape
    cell, cells = symbols.ravel(), np.arange(symbols.size, dtype=np.int64)
    right, left = cells + 1, cells - 1
    left[::wide] = -1
    ranks, merged = np.full(symbols.shape, _NONE, np.int32), np.zeros(symbols.size, np.int64)
    rank = ranks.ravel()

    def offer(at: np.ndarray) -> None:
        rank[at] = _NONE
        at = at[cell[right[at]] >= 0]
        a, b = cell[at], cell[right[at]]
        found, to = model.look_up(a, b)
        hit = np.flatnonzero(found != _NONE)
        at, row = at[hit], at[hit] // wide
        kept = ~skipped(keys[row], at - row * wide, a[hit], b[hit], rate)
        rank[at[kept]], merged[at[kept]] = found[hit[kept]], to[hit[kept]]

    offer(np.flatnonzero(np.arange(wide) < sizes[:, None] - 1))
    active = np.arange(rows)
    while True:
        best = active * wide + ranks[active].argmin(axis=1)
        more = rank[best] != _NONE
        active, best = active[more], best[more]
        if not len(active):
            return symbols
        gone = right[best]
        after = right[gone]
        cell[best], cell[gone], rank[gone] = merged[best], -1, _NONE
        right[best], left[after] = after, best
        before = left[best]
        offer(np.concatenate([best, before[before >= 0]]))


def segment(model: MergeModel, codes: np.ndarray, starts: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens in turn, and where each one's begin (with the end). A pre-token goes from its start in ``codes`` to the next one's."""
    sizes = np.diff(np.append(starts, len(codes)))
    symbols = model.of_code[codes]
    most = np.full(len(codes), -1, np.int64)  # symbols left, each at its first character; -1 where it was merged
    order = np.argsort(sizes, kind="stable")
    order = order[: np.searchsorted(sizes[order], BULK, "right")]
    for i in range(0, len(order), 8000):
        k = order[i : i + 8000]
        wide = int(sizes[k[-1]]) + 1
        inside = np.arange(wide) < sizes[k, None]
        at = starts[k, None] + np.arange(wide)
        left = _bulk(model, np.where(inside, symbols[np.minimum(at, len(codes) - 1)], -1), sizes[k], keys[k], rate)
        row, column = np.nonzero(left >= 0)
        most[starts[k[row]] + column] = left[row, column]
    for k in np.flatnonzero(sizes > BULK).tolist():
        found, places = _one(model, symbols[starts[k] : starts[k] + sizes[k]].tolist(), int(keys[k]), rate)
        most[starts[k] + np.array(places)] = found
    return _spelled(model, codes, starts, most)


def _spelled(model: MergeModel, codes: np.ndarray, starts: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as ids; a character without a piece becomes its bytes."""
    at = np.flatnonzero(most >= 0)
    symbol = most[at]
    odd = np.flatnonzero(symbol >= len(model.bytes))
    count = np.ones(len(at), np.int64)
    characters, which = np.unique(codes[at[odd]], return_inverse=True)
    spelled = [[model.byte_ids[b] for b in (SPACE if chr(c) == LITERAL else chr(c)).encode()] for c in characters.tolist()]
    count[odd] = np.array([len(x) for x in spelled], np.int64)[which] if len(odd) else 0
    begin = np.concatenate([[0], np.cumsum(count)])
    ids = np.repeat(symbol, count).astype("<u4")
    for c, x in enumerate(spelled):
        ids[begin[odd[which == c]][:, None] + np.arange(len(x))] = x
    return ids, begin[np.searchsorted(at, np.append(starts, len(codes)))]


def occurrence_keys(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each pre-token of each text, from the text's key and the pre-token's place among the text's."""
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return textops.mix(np.repeat(texts, sizes) ^ textops.mix(at.astype(np.uint64)))


def pre_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where pre-tokens start, and how many each text has.

    Pre-tokens are parts that merges never join: a run of word marks or a line break, with what follows. A text gets a mark in front.
    """
    marked = [SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE) if t else "" for t in texts]
    ends = np.cumsum([len(m) for m in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    mark = codes == ord(SPACE)
    start = mark | (codes == ord("\n"))
    start[1:] &= ~(mark[1:] & mark[:-1])
    start[ends[:-1][ends[:-1] < len(codes)]] = True
    starts = np.flatnonzero(start)
    return codes, starts, np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))


_models: dict[str, MergeModel] = {}


def _model(path: str) -> MergeModel:
    return _models.get(path) or _models.setdefault(path, MergeModel(path))


def encode_with_dropout(documents: DataFrame, model_path: str, rate: float = 0.1, seed: int = 11) -> DataFrame:
    """doc_id, variant (int), n_bytes (long) and ids (binary, little-endian unsigned 32-bit) for each row of ``documents`` (doc_id, text).

    Ids are those of the SentencePiece BPE model, but a candidate merge is skipped with
    probability ``rate``: when a hash keyed by seed, doc_id, the pre-token's place in the text,
    the candidate's place in it and the two symbols says so. So every document and every occurrence is
    segmented on its own, and runs agree. With rate 0 ids are the library's own. ``variant`` is the upper half
    of the 64-bit hash of doc_id and seed. Only rows with the same doc_id (or none) and text are encoded
    alike, as nothing tells them apart. Characters without a piece become bytes, as does a word mark in
    the text itself, so ``decode`` gives the text back. A null or empty text has no ids. Rows
    with null or repeated doc_id are encoded like others; further columns are ignored, an empty table
    gives an empty one. There is no shuffle; agendas of many pre-tokens are processed at once, whatever the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for whole in batches:
            _, offsets = textops.buffers(whole.column(2))
            for i, j in textops.slices(offsets, WALKED):
                batch = whole.slice(i, j - i)
                codes, starts, sizes = pre_tokens(batch.column(2).to_pylist())
                keys = batch.column(1).to_numpy()
                ids, begin = segment(model, codes, starts, occurrence_keys(keys.view(np.uint64), sizes), rate)
                ends = begin[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                cells = pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys >> 32, pa.int32()), pa.array(np.diff(offsets[i : j + 1]), pa.int64()), cells], ["doc_id", "variant", "n_bytes", "ids"])

    rows = documents.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("key"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, variant int, n_bytes long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (with a column ids as made above) plus its text; null ids give the empty text. A column text is replaced."""
    rows = encoded.drop("text") if "text" in encoded.columns else encoded
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _model(model_path).bytes
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                texts = [b"".join(map(table.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist()))[1:].decode() for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))
