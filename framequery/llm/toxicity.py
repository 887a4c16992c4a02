"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its words (lower case, letters and digits) and the words' beginnings of 4 and 5 bytes, so that
inflected forms share weight. A feature counts log(1 + occurrences) / sqrt(words of the text), which makes long and short
texts comparable. One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - t_k) with rising t_k. The output is the expected severity, the sum
of these probabilities, and the probability of any severity.

The model is fitted on the driver on a bounded sample of labelled documents, SAMPLE at most, chosen by a hash of the id;
only hashed word counts are brought there. Labels say toxic or not; toxic documents of the sample are graded 1 to
GRADES - 1 by how much of their text consists of words that the labels tie to toxicity.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z in lower case. Defined results: a null text is empty; an empty text
scores what the thresholds alone say; without labelled documents of both kinds nothing is toxic and severity is 0;
repeated rows each get their row; labels that are null or whose document is missing are left aside. An empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_arrow, utf8, word_table

SAMPLE, GRADES = 7_000, 4
#: Words in fewer of the sample's documents are no features.
MIN_DF = 5
#: Weight of the L2 penalty against the sum over all documents.
PENALTY, STEPS, RATE = 8.0, 150, 0.1
#: Documents with at least this probability of any severity are toxic, if their words raise the log-odds above those of
#: a text without known words by EVIDENCE at least: a text is not rejected for being unlike the sample.
LIMIT, EVIDENCE = 0.25, 1.0
#: Bytes of the beginnings of words that are features of their own.
STEMS = (4, 5)
SCALE = 10.0

_TABLE = word_table()


def word_counts(text: bytes) -> Counter:
    return Counter(text.translate(_TABLE).split())


def features_of(word: bytes) -> list[int]:
    """32-bit hashes of the word and its beginnings."""
    return [xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(word[:n], n) for n in STEMS if len(word) > n)]


def feature_counts(text: bytes, memo: Memo) -> tuple[Counter, int]:
    """Occurrences of each feature, and the number of words."""
    words, out = word_counts(text), Counter()
    for w, n in words.items():
        for f in memo[w]:
            out[f] += n
    return out, words.total()


class OrdinalModel:
    """Weights by feature hash, and the thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.asarray(thresholds, np.float64)

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k), one column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -50, 50)))

    def memo(self) -> Memo:
        """word -> those of its features that have a weight."""
        weights = self.weights
        return Memo(lambda w: [f for f in features_of(w) if f in weights])

    def margin(self, text: bytes, memo: Memo) -> float:
        counts, n = feature_counts(text, memo)
        weights = self.weights
        return SCALE * sum(weights[f] * log1p(c) for f, c in counts.items()) / sqrt(max(n, 1))


class Sample:
    """Sparse counts in coordinates: line (document), column (feature) and amount; features of fewer than min_df documents
    are left out at once, which keeps the driver's memory small."""

    def __init__(self, rows: list[np.ndarray], counts: list[np.ndarray], n_words: np.ndarray, min_df: int = MIN_DF):
        self.n, self.n_words = len(rows), np.maximum(n_words, 1)
        everything = np.concatenate(rows)
        ids, df = np.unique(everything, return_counts=True)
        self.ids = ids[df >= min_df]
        where = np.searchsorted(self.ids, everything).astype(np.int32)
        keep = np.isin(everything, self.ids)
        self.column = where[keep]
        self.line = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])[keep]
        self.amount = np.concatenate(counts)[keep].astype(np.float32)


#: Coordinates that are worked on at once.
PIECE = 1 << 18


def summed(at: np.ndarray, n: int, weights) -> np.ndarray:
    """Sums of weights(a, b), those of the coordinates a to b, by their place `at`; a piece at a time, to spare memory."""
    out = np.zeros(n)
    for a in range(0, len(at), PIECE):
        out += np.bincount(at[a : a + PIECE], weights(a, a + PIECE), minlength=n)
    return out


def fit(sample: Sample, grades: np.ndarray, n_grades: int, penalty: float = PENALTY, steps: int = STEPS, rate: float = RATE) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by Adam."""
    ids, line, column = sample.ids, sample.line, sample.column
    value = np.log1p(sample.amount)
    value *= (SCALE / np.sqrt(sample.n_words)).astype(np.float32)[line]
    n, levels = sample.n, n_grades - 1
    l2 = penalty / n
    w = np.zeros(len(ids), np.float32)
    share = np.array([(grades > k).mean() for k in range(levels)]).clip(1e-3, 1 - 1e-3)
    t = np.log((1 - share) / share)
    free = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])  # t_0 and the logarithms of the steps
    moments = [np.zeros(len(ids) + levels) for _ in range(2)]
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        margin = summed(line, n, lambda a, b: value[a:b] * w[column[a:b]])
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        up = 1 / (1 + np.exp(np.clip(margin - edges[grades + 1], -50, 50)))  # P(grade <= g)
        down = 1 / (1 + np.exp(np.clip(margin - edges[grades], -50, 50)))  # P(grade <= g - 1)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        g_margin = (d_up - d_down) / n  # of the negative logarithm of the likelihood
        g_t = np.bincount(grades, -d_up / n, minlength=levels + 1)[:levels] + np.bincount(grades, d_down / n, minlength=levels + 1)[1:]
        g_free = np.cumsum(g_t[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])
        g = np.concatenate([summed(column, len(ids), lambda a, b: value[a:b] * g_margin[line[a:b]]) + l2 * w, g_free])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = rate * (1 - step / (steps + 1)) * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, free = w - move[: len(ids)].astype(np.float32), free - move[len(ids) :]
    t = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
    strong = np.flatnonzero(np.abs(w) > 1e-2)
    return OrdinalModel({int(ids[k]): float(w[k]) for k in strong}, t.tolist())


def grades_of(sample: Sample, toxic: np.ndarray, n_grades: int) -> np.ndarray:
    """0 for clean documents; toxic ones in equal parts by the rate of words that occur mostly in toxic documents."""
    bad, good = (np.bincount(sample.column[toxic[sample.line] == k], minlength=len(sample.ids)) for k in (1, 0))
    tied = (bad >= MIN_DF) & ((bad + 0.5) / (toxic.sum() + 1) > 5 * (good + 0.5) / ((1 - toxic).sum() + 1))
    rate = np.bincount(sample.line, sample.amount * tied[sample.column], minlength=sample.n) / sample.n_words
    out = np.zeros(sample.n, np.int64)
    where = np.flatnonzero(toxic == 1)
    order = where[np.argsort(rate[where], kind="stable")]
    out[order] = 1 + np.arange(len(order)) * (n_grades - 1) // max(len(order), 1)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE, n_grades: int = GRADES) -> OrdinalModel:
    """Fits the model on at most `sample` labelled documents."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(toxic_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)  # the bounded sample
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(marked), texts.doc_id == marked.id).select("doc_id", "toxic", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(features_of)
        for batch in batches:
            found = [feature_counts(x, memo) for x in utf8(batch.column(2))]
            ids = [np.fromiter(c, np.uint32, len(c)).view(np.int32) for c, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for _, n in found], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "n_words", "ids", "counts"])

    got = map_arrow(chosen, counted, "doc_id long, toxic int, n_words long, ids array<int>, counts array<int>").toArrow().sort_by([("doc_id", "ascending")])
    toxic = np.array([int(x > 0) for x in got.column("toxic").to_pylist()], np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return OrdinalModel({}, [50.0] * (n_grades - 1))
    unpack = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in got.column(c)]
    sparse = Sample([x.view(np.uint32) for x in unpack("ids")], unpack("counts"), got.column("n_words").to_numpy())
    del got
    pa.default_memory_pool().release_unused()
    return fit(sparse, grades_of(sparse, toxic, n_grades), n_grades)


def scorer(model: OrdinalModel, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in batches:
            margins = np.array([model.margin(x, memo) for x in utf8(batch.column(text_at))], np.float64)
            yield batch, model.probabilities(margins), margins >= EVIDENCE

    return run


def severities(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, toxic and grade for each row of docs: 0 for what is not toxic, the most
    probable of the toxic grades for what is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p, sure in scorer(model, 1)(batches):
            each = np.diff(np.concatenate([1 - p, np.ones((len(p), 1))], axis=1), axis=1)  # of grades 1 and more
            toxic = (p[:, 0] >= limit) & sure
            grade = np.where(toxic, 1 + each.argmax(axis=1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(grade), pa.array(toxic)], names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """The rows of docs, with all their columns, that are not toxic. Null and empty texts stay, unless the thresholds
    alone find them toxic; repeated rows go or stay together; an empty table gives no rows."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p, sure in scorer(model, at)(batches):
            yield batch.filter(pa.array(~((p[:, 0] >= limit) & sure)))

    return map_arrow(docs, run, docs.schema)
