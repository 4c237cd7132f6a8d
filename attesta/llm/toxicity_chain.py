"""Toxicity by a classifier chain of linear models, trained with out-of-fold predictions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import textops
from attesta.llm.session import bound_batches

#: Categories in chain order, as SQL over a row of labels that gives 1, 0 or null.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
#: Labelled documents that are trained on at most: those with the least hash of doc_id. Scoring covers every document.
TRAINED = 6000
#: Feature space, features a model selects, folds of out-of-fold predictions, L2 penalty.
SPACE, SELECTED, FOLDS, PENALTY = 1 << 18, 256, 3, 1.0
#: Entries of a feature list that are worked on at a time.
SLICE = 1 << 20
#: Word beginnings (in bytes) that are features beside the words themselves: they carry stems over to unseen endings.
STEMS = (4, 5, 6, 7)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of every word and stem, and the number of words of each text."""
    starts, ends = textops.word_spans(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    index, hashes = textops.stems(data, starts, ends, STEMS)
    return owner[index], (hashes % np.uint64(SPACE)).astype(np.int64), np.bincount(owner, minlength=len(offsets) - 1)


def rates(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Value of a feature: its damped share of the text's words."""
    return np.log1p(300 * count / words)


def _sliced(n: int) -> Iterator[slice]:
    """Pieces of n entries, so that working on them takes little memory beside them."""
    return (slice(i, i + SLICE) for i in range(0, n, SLICE))


def select(owner: np.ndarray, feature: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Features of the training ``rows`` that go with the category, by chi-squared of presence; ascending."""
    here, yes = np.zeros(SPACE, np.int64), np.zeros(SPACE)
    for at in _sliced(len(owner)):
        inside = rows[owner[at]]
        of, who = feature[at][inside], owner[at][inside]
        here += np.bincount(of, minlength=SPACE)
        yes += np.bincount(of, y[who], SPACE)
    n, n1 = rows.sum(), y[rows].sum()
    n0, no = n - n1, here - yes
    side = np.maximum(np.abs(yes * (n0 - no) - no * (n1 - yes)) - n / 2, 0)
    chi = n * side**2 / np.maximum(here * (n - here) * n1 * n0, 1)
    chi[here < 3] = 0
    chi[yes * n0 < no * n1] *= 0.2  # absence is weak evidence
    best = np.argsort(-chi, kind="stable")[:SELECTED]
    return np.sort(best[chi[best] > 0])


def dense(owner: np.ndarray, feature: np.ndarray, value: np.ndarray, chosen: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Chosen features, earlier categories' log odds and a constant as columns."""
    n = len(earlier)
    x = np.zeros((n, len(chosen) + earlier.shape[1] + 1))
    for part in _sliced(len(owner)):
        at = np.searchsorted(chosen, feature[part])
        hit = at < len(chosen)
        hit[hit] = chosen[at[hit]] == feature[part][hit]
        x[owner[part][hit], at[hit]] = value[part][hit]
    p = np.clip(earlier, 1e-4, 1 - 1e-4)
    x[:, len(chosen) : -1] = np.log(p / (1 - p)) / 4
    x[:, -1] = 1
    return x


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of an L2-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(15):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w)), x.T @ (p - y) + PENALTY * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled text with their counts."""
    for batch in batches:
        data, offsets = textops.buffers(batch.column(1))
        for i, j in textops.slices(offsets):
            owner, feature, words = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key, count = np.unique(owner * SPACE + feature, return_counts=True)
            ends = pa.array(np.searchsorted(key // SPACE, np.arange(j - i + 1)).astype(np.int32))
            listed = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(x, kind))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(words, pa.int64()), listed(key % SPACE, pa.int32()), listed(count, pa.int32())], ["doc_id", "y", "words", "features", "counts"])


def _train(group: pa.Table) -> pa.Table:
    """The chain over the bounded sample, as JSON."""
    group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("words", "ascending")]).combine_chunks()
    lists = group["features"].combine_chunks()
    words = np.maximum(group["words"].to_numpy(), 1)
    owner = np.repeat(np.arange(group.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    feature, counts = lists.flatten().to_numpy(), group["counts"].combine_chunks().flatten().to_numpy()
    value = np.empty(len(counts))
    for at in _sliced(len(counts)):
        value[at] = rates(counts[at], words[owner[at]])
    labels = np.array(group["y"].to_pylist(), float)
    fold = np.arange(group.num_rows) % FOLDS
    earlier, models = np.zeros((group.num_rows, 0)), []

    def fit(y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = select(owner, feature, y, rows)
        return chosen, logistic(dense(owner, feature, value, chosen, earlier)[rows], y[rows])

    for k in range(labels.shape[1]):
        y = labels[:, k]
        chosen, w = fit(y, np.ones(len(y), bool))
        models.append({"chosen": chosen.tolist(), "w": w.tolist()})
        apart = np.zeros(len(y))
        for f in range(FOLDS):
            if (fold != f).any():
                c, v = fit(y, fold != f)
                apart[fold == f] = sigmoid(dense(owner, feature, value, c, earlier)[fold == f] @ v)
        earlier = np.column_stack([earlier, apart])
    return pa.table({"chain": [json.dumps(models)]})


def train(documents: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, most: int = TRAINED) -> list[dict]:
    """The chain's models, one per category in order: chosen features and weights (for them, each earlier category and a constant).

    Rows of ``labels`` (doc_id and what the categories' SQL names) with a null label are
    left out; of repeated doc_ids the largest labels count. At most ``most`` labelled documents, those with
    the least hash of doc_id, are used, whole. A category's model for a fold gets the earlier
    categories' predictions from models that didn't see that fold. With no labelled
    document the list is empty.
    """
    wanted = categories or CATEGORIES
    y = labels.select(F.col("doc_id"), *[F.expr(e).cast("int").alias(f"__{c}") for c, e in wanted.items()]).dropna()
    y = y.groupBy("doc_id").agg(F.array(*[F.max(f"__{c}") for c in wanted]).alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    bound_batches(documents.sparkSession)
    rows = documents.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(y), "doc_id").select("doc_id", "text", "y")
    seen = rows.mapInArrow(textops.returning(_featurise), f"doc_id {dict(rows.dtypes)['doc_id']}, y array<int>, words long, features array<int>, counts array<int>")
    found = seen.groupBy(F.lit(0).alias("all")).applyInArrow(textops.returning_group(_train), "chain string").first()
    return json.loads(found[0]) if found else []




def _probabilities(models: list[dict], n: int, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges of a column of texts with their probabilities, a column per category."""
    chain = [(np.array(m["chosen"], np.int64), np.array(m["w"])) for m in models]
    wanted = np.zeros(SPACE, bool)
    for chosen, _ in chain:
        wanted[chosen] = True
    data, offsets = textops.buffers(column)
    for i, j in textops.slices(offsets):
        owner, feature, words = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        some = wanted[feature]
        key, count = np.unique(owner[some] * SPACE + feature[some], return_counts=True)
        owner, feature = key // SPACE, key % SPACE
        value, p = rates(count, words[owner]), np.zeros((j - i, 0))
        for chosen, w in chain:
            p = np.column_stack([p, sigmoid(dense(owner, feature, value, chosen, p) @ w)])
        p = p if chain else np.zeros((j - i, n))
        p[words == 0] = 0.0
        yield i, j, p


def _scorer(models: list[dict], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, p in _probabilities(models, n, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(p[:, k]) for k in range(n)]], ["id", *[f"p{k}" for k in range(n)]])

    return run


def score(documents: DataFrame, models: list[dict], categories: dict[str, str] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> (double) for each category and rejected (boolean) for every row of ``documents`` (doc_id, text).

    ``rejected`` says that the last category's probability reaches ``threshold``. Texts
    that are null, empty or without words have probability 0, as has every text when
    there are no models. Rows with null or repeated doc_id are scored like others; further columns are ignored. No shuffle.
    """
    names = list(categories or CATEGORIES)
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", F.lower("text").alias("text"))
    scored = rows.mapInArrow(textops.returning(_scorer(models, len(names))), f"id {kind}, " + ", ".join(f"p{k} double" for k in range(len(names))))
    last = F.col(f"p{len(names) - 1}")
    return scored.select(F.col("id").alias("doc_id"), *[F.col(f"p{k}").alias(f"p_{c}") for k, c in enumerate(names)], (last >= threshold).alias("rejected"))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``score`` of all documents by the chain trained on the labelled ones."""
    return score(documents, train(documents, labels), threshold=threshold)


def drop_toxic(documents: DataFrame, models: list[dict], threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that ``score`` does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, p in _probabilities(models, max(len(models), 1), batch.column(batch.num_columns - 1)):
                kept = batch.slice(i, j - i).filter(pa.array(p[:, -1] < threshold))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    return documents.select("*", F.lower("text").alias("__lower")).mapInArrow(textops.returning(run), documents.schema)
