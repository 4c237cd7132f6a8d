"""Token counts without ids: count each distinct pre-token once, join the counts to the documents' frequencies, sum."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import textops
from attesta.llm.session import cut

SPACE = "▁"
#: Pre-tokens at most that are broadcast with their counts, the frequent ones; the others are joined.
FREQUENT = 1_000_000
#: Distinct pre-tokens a task gathers before it sends them on; bounds its memory.
GATHERED = 400_000
#: A pre-token: a run of word marks with what follows it, or a line break with what follows it.
_PARTS = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")
#: Text that a model with a normaliser of its own would change.
_PROBE = "  ﬁ Å Å\tb\n c  ２ ς "


class PieceCounter:
    """Counts a SentencePiece BPE model's pieces of pre-tokens.

    No piece has a word mark after another character, and none holds a line break, so
    merges never cross the start of a run of marks or a line break: cutting there is
    exact. The constructor checks both on the vocabulary, and that the model leaves texts as they are.
    """

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p) for p in pieces):
            raise ValueError("pieces cross word marks or line breaks; pre-tokens of this model are not independent")
        if self.model.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("the model changes texts before it cuts them; pre-tokens of the text are not its own")

    def count(self, parts: list[str]) -> list[int]:
        """Pieces of each pre-token. The library puts a mark in front: it is the pre-token's own, or before a line break one piece too many."""
        return [len(ids) - (p[0] == "\n") if p else 1 for p, ids in zip(parts, self.model.encode(parts, num_threads=1), strict=True)]


_counters: dict[str, PieceCounter] = {}


def frequencies(text: str | None) -> Counter:
    """How often each pre-token stands in a text, without its first mark; one of a lone mark is empty."""
    if not text:
        return Counter()
    if SPACE not in text:
        found = Counter(text.replace("\n", " \n").split(" "))
        if "" not in found:
            return found
    found = Counter()
    for part, n in Counter(_PARTS.findall(SPACE + text.replace(" ", SPACE))).items():
        found[part[1:].replace(SPACE, " ") if part[0] == SPACE else part] += n
    return found


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of a task with their frequencies."""
    seen: Counter = Counter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["part", "n"])
    for batch in batches:
        for text in batch.column(0):
            for part, n in frequencies(text.as_py()).items():
                seen[part] += n
            if len(seen) > GATHERED:
                yield flush()
                seen.clear()
    if seen:
        yield flush()


def _counted(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(model_path) or _counters.setdefault(model_path, PieceCounter(model_path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counter.count(batch.column(0).to_pylist()), pa.int32())], ["part", "n", "pieces"])

    return run


def _summed(sent):
    """A row for each text with the sum over its frequent pre-tokens, and one for each other pre-token of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for i, j in textops.slices(textops.buffers(whole.column(2))[1], 8 << 20):
                batch = whole.slice(i, j - i)
                rows = batch.column(0).to_numpy()
                sums, owner, parts, counts = [], [], [], []
                for k, text in enumerate(batch.column(2)):
                    total = 0
                    for part, n in frequencies(text.as_py()).items():
                        pieces = known.get(part)
                        if pieces is None:
                            owner.append(k)
                            parts.append(part)
                            counts.append(n)
                        else:
                            total += n * pieces
                    sums.append(total)
                n, more = batch.num_rows, len(owner)
                n_bytes = np.diff(textops.buffers(batch.column(2))[1])
                own = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_bytes), pa.array(sums, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], _NAMES)
                yield own
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[owner]), pa.nulls(more, batch.column(1).type), pa.nulls(more, pa.int64()), pa.nulls(more, pa.int64()), pa.array(parts, pa.string()), pa.array(counts, pa.int64())], _NAMES)

    return run


_NAMES = ["row", "doc_id", "n_bytes", "known", "part", "n"]


def count_tokens(documents: DataFrame, model_path: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``n_tokens`` is what the SentencePiece model at ``model_path`` gives for the whole
    text without begin or end tokens. A null text counts as empty: 0 bytes, 0 tokens. A
    null doc_id is kept. Repeated rows give repeated rows, an empty table an empty one,
    further columns are ignored.

    The distinct pre-tokens of all texts come together with map-side combining, and each is
    counted once. A second pass over the texts joins the counts to each document's pre-token frequencies:
    of the ``frequent`` most frequent pre-tokens at most (by powers of two of their frequency) in the task, as a
    broadcast table of that size; of the others, which stand in few documents each, by a shuffle. No ids are kept.
    """
    kind = dict(documents.dtypes)["doc_id"]
    distinct = documents.select("text").mapInArrow(_distinct, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    pieces = cut(distinct.mapInArrow(_counted(model_path), "part string, n long, pieces int"))
    levels = pieces.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()  # 63 rows at most
    least, held, complete = 63, 0, True
    for r in levels:
        if held + r["count"] > frequent:
            complete = False
            break
        least, held = r.level, held + r["count"]
    among = F.floor(F.log2("n")) >= least
    common = pieces.where(among).select("part", "pieces").toArrow()
    sent = documents.sparkSession.sparkContext.broadcast(dict(zip(common["part"].to_pylist(), common["pieces"].to_pylist(), strict=True)))
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    sums = numbered.mapInArrow(_summed(sent), f"row long, doc_id {kind}, n_bytes long, known long, part string, n long")
    total = F.col("known")
    if not complete:
        # A text's own row matches no pre-token; the key spreads such rows.
        key = F.coalesce("part", F.concat(F.lit("\0"), F.col("row").cast("string")))
        rare = pieces.where(~among).select(F.col("part").alias("key"), "pieces")
        joined = sums.withColumn("key", key).join(rare, "key", "left")
        added = F.sum(F.coalesce("known", F.col("n") * F.col("pieces")))
        sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), added.alias("known"))
    return sums.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
