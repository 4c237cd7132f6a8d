"""Secrets in texts: known forms, and strings that a tokenizer spends many tokens on."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from attesta.llm import textops

#: A run of at least so many characters of these is looked at; below so many characters a token it counts as random.
LEAST, RATIO = 20, 1.9
#: Characters of a run that are encoded at a time; bounds the work on a run of any length.
STRETCH = 256
#: The order in which spans with the same start are given.
KINDS = ("assign", "access", "hex", "random")
#: The base forms. Matches are leftmost and don't overlap; those whose group (0: the match) is shorter than the length are dropped.
ASSIGN, ASSIGN_LEAST = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12
ACCESS, ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 18
HEX, HEX_LEAST = re.compile(r"[0-9a-f]+"), 16
#: What a text with an assignment holds in lower case.
WORDS = ("password", "passwd", "secret", "token", "api")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_HEXES = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")  # the same matches as HEX, without the short ones
#: Known digests: hexadecimal ones by their length, and base64 ones behind the name of their algorithm.
DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_DIGEST = re.compile(r"(?i:sha)(256|384|512)-[A-Za-z0-9+/]{43,86}={0,2}")
#: Known identifiers: UUIDs, numbers with their signs and times, and words of one case or with a first capital joined by signs or by case.
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9]+([+/_=T-]+[0-9]+)*Z?")
_NAME = re.compile(r"[_/=+-]*([A-Z]?[a-z]{3,15}|[A-Z]{3,15}|[a-z]{1,2}|[0-9]{1,4})([_/=+-]+([A-Z]?[a-z]{3,15}|[A-Z]{3,15}|[a-z]{1,2}|[0-9]{1,4})|[A-Z][a-z]{3,15})*[_/=+-]*")
_token_flags = np.array([chr(b) in "+/_=-" or (b < 128 and chr(b).isalnum()) for b in range(256)])
_hex_flags = np.array([chr(b) in "0123456789abcdef" for b in range(256)])


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """A rank file's vocabulary without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Whether a run is a digest or an identifier."""
    if _UUID.fullmatch(run) or _NUMBER.fullmatch(run) or _DIGEST.fullmatch(run) or _NAME.fullmatch(run):
        return True
    return len(run) in DIGEST_SIZES and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) is not None


def per_token(run: str, vocabulary: tiktoken.Encoding) -> float:
    """Characters a token, in stretches of STRETCH characters."""
    return len(run) / sum(len(vocabulary.encode_ordinary(run[i : i + STRETCH])) for i in range(0, len(run), STRETCH))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, in order."""
    found = []
    small = text.lower()
    if any(w in small for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return sorted(found + [(m.start(), 2, m.end()) for m in _HEXES.finditer(text)])


def scan(text: str, vocabulary: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order: the base forms, and random runs that touch none of them."""
    base = base_spans(text)
    found, i, upto = list(base), 0, 0
    for m in _RUN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            upto, i = max(upto, base[i][2]), i + 1
        if upto <= m.start() and not known(m[0]) and per_token(m[0], vocabulary) < ratio:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _long_runs(flags: np.ndarray, least: int) -> np.ndarray:
    """Where runs of ``least`` set flags or more begin."""
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return edges[::2][edges[1::2] - edges[::2] >= least]


def _scanner(path: str, pattern: str, ratio: float):
    vocabularies: dict[str, tiktoken.Encoding] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabularies.get(path) or vocabularies.setdefault(path, encoding(path, pattern))
        for batch in batches:
            data, offsets = textops.buffers(batch.column(1))
            spans: list[list[dict]] = []
            for i, j in textops.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                # Texts with neither a long run nor a word of an assignment are not looked at by character; where a run may cross into the next text, both are.
                starts = np.concatenate([_long_runs(_token_flags[part], ACCESS_LEAST), _long_runs(_hex_flags[part], HEX_LEAST)])
                edge = at[(at > 0) & (at < len(part))]
                edge = edge[_token_flags[part[edge]] & _token_flags[part[edge - 1]]]
                seen = np.zeros(j - i, bool)
                seen[np.searchsorted(at, np.concatenate([starts, edge, edge - 1]), "right") - 1] = True
                for k in range(j - i):
                    raw = part[at[k] : at[k + 1]].tobytes()
                    if not seen[k]:
                        small = raw.lower()
                        if not any(w.encode() in small for w in WORDS):
                            spans.append([])
                            continue
                    spans.append([{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in scan(raw.decode("utf-8", "replace"), vocabulary, ratio)])
            listed = pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], ["doc_id", "spans"])

    return textops.returning(run)


def secret_spans(documents: DataFrame, ranks_path: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """Spans that look like secrets in every row of ``documents`` (doc_id, text): doc_id and spans.

    ``spans`` lists structs (kind, start, end) by start, then kind in the order of KINDS; places are code points, the end is
    exclusive. Base kinds: "assign" (a word like password, a colon or equals sign and a value of ASSIGN_LEAST characters), "access" (AKIA
    and capitals or digits) and "hex" (lower-case hexadecimal digits). "random" is the token-efficiency test: a run of LEAST or more letters,
    digits and + / _ = - that overlaps no base span, is no known digest or identifier (UUIDs, numbers and times, hexadecimal strings of the
    usual digest lengths, named base64 digests, words joined by signs or case) and has fewer than ``ratio`` characters a token
    under the vocabulary (a rank file read with ``pattern``; runs are encoded in stretches of STRETCH characters). Letters match in either case in
    ASCII only. Null and empty texts have no spans; repeated rows and rows without doc_id are rows of their own; further columns are ignored;
    an empty table gives an empty result. Whole texts are scanned where they lie, without a shuffle.
    """
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_scanner(ranks_path, pattern, ratio), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")
