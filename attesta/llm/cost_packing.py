"""Cost-balanced packing of token ids into sequences of bounded length."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import textops

#: Tokens of a sequence; id after each document.
CAPACITY, END = 4096, 2
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n**2 (feed-forward work against attention within the piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens of document ends that one task packs, about.
SHARD_TOKENS = 2_000_000
#: White-space separated words whose ids a Python worker remembers; bounds its memory.
REMEMBERED = 200_000
#: White space for Python only, and a letter whose lower case depends on its place: a text with one goes to the library whole.
_ODD = "\x1c\x1d\x1e\x1f\x85\u03a3"
#: The rules of a tokenizer file under which a text's ids are those of its lower-cased words. Files with others go to the library whole.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: A stop or comma that may go on a run of signs.
_PAIR = re.compile(r"[.,](?:[^\sa-z0-9]|(?<=[^\w\s][.,])|(?<=_[.,]))")
#: First character beyond the Latin letters, on whose case all Unicode versions agree.
_BEYOND_LATIN = "\u0250"
#: Signs that stand together as one unit after a word's letters; an apostrophe may begin a unit of its own.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Ids by word, made by ``learn`` at the first use and held for two generations of ``size`` words: a word that comes again moves to the younger one, so frequent words stay."""

    def __init__(self, learn: Callable[[str], bytes], size: int):
        super().__init__()
        self.learn, self.size, self.before = learn, max(1, size), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of a lower-casing word BPE, remembered by word; little-endian unsigned 16-bit (32-bit for large vocabularies).

    The tokenizer composes characters (NFC), makes white space single blanks, lower-cases
    character by character and cuts runs of letters, single digits and runs of other
    signs apart. So a text's ids are those of its words in turn, in lower case, and a stop or comma
    with no sign beside it stands alone. Texts for which Python's own rules could differ go to the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.kind.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_words = (rules["normalizer"] or {}).get("normalizers") == _NORMALIZER and ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [None])[0] == _SPLIT and rules["model"].get("end_of_word_suffix") == "</w>"
        # The model's spelling of the Latin letters beyond ASCII.
        self.spelled = {n: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(n))[0][0] for n in range(0x80, ord(_BEYOND_LATIN)) if chr(n).isalpha()} if self.by_words else {}
        self.known = _Words(self._word, remembered // 2)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word: letters are one unit for the model, other words are cut by the tokenizer's own rule."""
        if not word.isascii() and max(word) >= _BEYOND_LATIN:
            return self._ids(word).tobytes()
        letters = word.rstrip(_SIGNS)
        if letters.isalpha() or not letters:
            units = [u for u in (letters.translate(self.spelled), word[len(letters) :]) if u]
        else:
            units = [u for u, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]
        ids = array(self.code, [t.id for u in units for t in self.tokenizer.model.tokenize(u)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        small = text.lower()
        if not self.by_words or any(s in text or s in small for s in self.special) or any(c in text for c in _ODD) or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", small):
            return self._ids(text).tobytes()
        if not _PAIR.search(small):  # then stops and commas stand alone
            small = small.replace(",", " ,").replace(".", " .")
        return b"".join(map(self.known.__getitem__, small.split()))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, end: int, remembered: int):
    """Each document's ids with ``end`` after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((path, remembered)) or _encoders.setdefault((path, remembered), WordEncoder(path, remembered))
        last = np.array([end], encoder.kind).tobytes()
        for batch in batches:
            ids = [encoder.encode(value.as_py() or "") + last for value in batch.column(2)]
            width = pa.array([encoder.kind.itemsize] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), width, pa.array(ids, pa.binary())], ["shard", "doc_id", "width", "ids"])

    return run


def balanced(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Places for pieces of the given sizes (at most ``capacity``), as (piece, start in it, length, sequence).

    Pieces go in descending order to the sequence of the lowest cost that has room for
    them whole; one that fits nowhere is cut over the cheapest sequences with any room. There
    are as few sequences as hold all tokens, so the room left over is less than one
    sequence in total. Ties go to the lower index.
    """
    n = -(-int(sizes.sum()) // capacity)
    room, cost, out = np.full(n, capacity), np.zeros(n), []
    for piece in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        start, left = 0, int(sizes[piece])
        while left:
            fits = room >= left
            s = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            size = min(left, int(room[s]))
            out.append((piece, start, size, s))
            start, left = start + size, left - size
            room[s] -= size
            cost[s] += linear * size + quadratic * size * size
    return out


def _packer(capacity: int, linear: float, quadratic: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard, kind = group["shard"][0].as_py(), f"<u{group['width'][0].as_py()}"
        docs = group["doc_id"].combine_chunks()
        ids = [np.frombuffer(x, kind) for x in group["ids"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (docs[i].as_py() is None, docs[i].as_py() or 0, ids[i].tobytes()))
        sizes = np.array([len(ids[i]) for i in order])
        places = [(i, start + order_start, size, s) for i, start, size, s, order_start in ((order[p], a, z, s, int(sizes[p]) // capacity * capacity) for p, a, z, s in balanced(sizes % capacity, capacity, linear, quadratic))]
        n = 1 + max((s for *_, s in places), default=-1)
        for i in order:
            for k in range(len(ids[i]) // capacity):
                places.append((i, k * capacity, capacity, n))
                n += 1
        used, offsets = [0] * n, []
        for *_, size, s in places:
            offsets.append(used[s])
            used[s] += size
        cells = [ids[i][a : a + z].astype("<u4").tobytes() for i, a, z, _ in places]
        which = pa.array([i for i, *_ in places], pa.int64())
        numbers = lambda x: pa.array(x, pa.int64())
        return pa.Table.from_arrays(
            [docs.take(which), numbers([a for _, a, _, _ in places]), numbers([z for _, _, z, _ in places]), numbers([len(ids[i]) for i, *_ in places]), numbers([(shard << 32) + s for *_, s in places]), numbers(offsets), pa.array(cells, pa.binary())],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    return run


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, linear: float = LINEAR, quadratic: float = QUADRATIC, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of ``documents`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, start and length (in its document's ids), doc_tokens,
    sequence_id, offset (in the sequence, gapless from 0) and ids (binary, little-endian
    unsigned 32-bit). A document's ids are the tokenizer's without special tokens, then
    ``end``; a null or empty text has the end alone, so every row gives a piece. Rows
    with null or repeated doc_id are documents of their own; further columns are ignored.

    Documents are dealt by hash into shards of about SHARD_TOKENS tokens (estimated from
    bytes and rows), packed independently. Full sequences are cut off a document first; the ends, each
    below one sequence, are assigned by descending size to the sequence with the lowest
    cost, linear plus quadratic in the pieces' lengths, that has room. A shard leaves less than one sequence of padding.
    Python workers remember the ids of ``remembered`` words (about 100 bytes each), which changes speed only.
    """
    n_bytes, n = documents.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    shards = 1 + int(((n_bytes or 0) / 2.7 + n) / SHARD_TOKENS)
    kind = dict(documents.dtypes)["doc_id"]
    # By id and text: rows without doc_id, and those that share one, don't meet in one shard.
    dealt = documents.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"), "doc_id", "text")
    encoded = dealt.mapInArrow(textops.returning(_encoder(tokenizer_path, end, remembered)), f"shard long, doc_id {kind}, width int, ids binary")
    return encoded.groupBy("shard").applyInArrow(textops.returning_group(_packer(capacity, linear, quadratic)), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
