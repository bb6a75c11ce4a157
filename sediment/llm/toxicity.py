"""Toxicity grades by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - theta_k) for k = 1..GRADES-1, with one weight vector for all thresholds and
theta_1 < theta_2 < ...; the expected severity is the sum of these probabilities. Features are words and
word beginnings, valued log(1 + count) over the whole text.

Labels say toxic or not. Severity among toxic texts is taken from the texts: their counts of features that
mark the toxic class, cut into equal parts. The model is fitted on at most SAMPLE labelled rows of each
class, those of the smallest hashed ids; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.frames import Scratch, batch, ddl, prepare, read
from sediment.llm.kernel import ALNUM, U, text_words

GRADES = 4
#: Labelled rows of each class that the fit may use: the bound on what reaches the driver.
SAMPLE = 4096
#: Features kept: those of the largest class differences, of so many standard errors at least, in so many texts
#: and so large a share of the toxic ones at least.
FEATURES, LEAST_Z, LEAST_TEXTS, LEAST_SHARE = 4096, 4.0, 3, 0.005
#: Bytes of a word's beginning.
STEM = 4
_STEM_SALT = U(0x5851F42D4C957F2D)
_FLAG_BITS = 20


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of texts as (first row, feature hashes, the text of each); a feature stands for each occurrence."""
    stems = text_words(column, ALNUM, cut=STEM)
    for (first, words, off), (_, stem, _) in zip(text_words(column, ALNUM), stems, strict=True):
        at = np.repeat(np.arange(len(off) - 1), np.diff(off))
        yield first, np.concatenate([words, stem ^ _STEM_SALT]), np.concatenate([at, at])


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the ascending thresholds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.flags = np.zeros(1 << _FLAG_BITS, bool)
        self.flags[(self.vocabulary >> U(64 - _FLAG_BITS)).astype(np.int64)] = True

    def counts(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, count) of the vocabulary's features."""
        none = np.zeros(0, np.int64)
        if not len(self.vocabulary):
            return none, none, none
        near = np.flatnonzero(self.flags[(hashes >> U(64 - _FLAG_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes[near]
        pair, n = np.unique(text[near][hit] * len(self.vocabulary) + at[hit], return_counts=True)
        return pair // len(self.vocabulary), pair % len(self.vocabulary), n

    def tails(self, hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """(texts, GRADES - 1): the probability of each grade from 1 on, or more."""
        row, feature, n = self.counts(hashes, text)
        z = np.bincount(row, np.log1p(n) * self.weights[feature], minlength=texts)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -40, 40)))


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, *, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by Adam on all rows; gaps between thresholds stay positive."""
    n, cuts = len(grade), GRADES - 1
    above = grade[:, None] >= np.arange(1, GRADES)
    parts = np.zeros(n_features + cuts)
    parts[n_features] = 1.0
    m, v = np.zeros_like(parts), np.zeros_like(parts)
    for t in range(1, steps + 1):
        w, gaps = parts[:n_features], np.exp(parts[n_features + 1 :])
        theta = parts[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, value * w[feature], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40)))
        # likelihood of a grade: the difference of neighbouring tails
        tail = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        mass = np.maximum(tail[np.arange(n), grade] - tail[np.arange(n), grade + 1], 1e-9)
        slope = p * (1 - p)
        d = np.zeros((n, cuts))
        low, top = grade > 0, grade < cuts
        d[low, grade[low] - 1] += slope[low, grade[low] - 1] / mass[low]
        d[top, grade[top]] -= slope[top, grade[top]] / mass[top]
        to_theta = d.sum(axis=0) / n
        grad = np.empty_like(parts)
        grad[:n_features] = -np.bincount(feature, value * d.sum(axis=1)[row], minlength=n_features) / n + ridge * w
        grad[n_features] = to_theta.sum()
        grad[n_features + 1 :] = [to_theta[k + 1 :].sum() * gaps[k] for k in range(cuts - 1)]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        parts = parts - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    assert above.shape == (n, cuts)
    gaps = np.exp(parts[n_features + 1 :])
    return parts[:n_features], parts[n_features] + np.concatenate([[0], np.cumsum(gaps)])


_SEEN = {"feature": pa.int64(), "toxic": pa.int64()}


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each feature of each text once, with the text's label."""
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        for first, h, at in features(b.column("text")):
            order = np.lexsort((h, at))
            h, at = h[order], at[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
            yield batch(_SEEN, feature=h[new].view(np.int64), toxic=toxic[first + at[new]])


_ROWS = {"toxic": pa.int64(), "features": pa.binary(), "counts": pa.binary()}


def _rows(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(vocabulary, np.zeros(len(vocabulary)), np.zeros(1))
        for b in batches:
            toxic = b.column("toxic").to_pylist()
            for first, h, at in features(b.column("text")):
                row, feature, n = model.counts(h, at)
                texts = int(at.max()) + 1 if len(at) else 0
                cut = np.searchsorted(row, np.arange(texts + 1))
                parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                yield batch(_ROWS, toxic=toxic[first : first + texts], features=[feature[a:z].tobytes() for a, z in parts], counts=[n[a:z].tobytes() for a, z in parts])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels (doc_id, toxic) and docs (doc_id, text); rows with a null in any of them are left out.

    Without labelled texts of both classes no text is toxic: no features, all thresholds far above zero.
    """
    prepare(spark)
    s = Scratch(spark)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("bigint").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    sample = F.broadcast(s.save(chosen[0].union(chosen[1])))  # 2 * SAMPLE rows at most
    texts = s.save(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, "doc_id").select("text", "toxic"))
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    never = Model(np.zeros(0, np.uint64), np.zeros(0), np.arange(1.0, GRADES) * 20)
    if not bad or not good:
        return never
    share = (F.col("bad") + F.col("good")) / F.lit(float(bad + good))
    error = F.sqrt(share * (1 - share) * F.lit(1 / bad + 1 / good))
    seen = texts.mapInArrow(_seen, ddl(_SEEN)).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    z = (F.col("bad") / F.lit(float(bad)) - F.col("good") / F.lit(float(good))) / F.greatest(error, F.lit(1e-12))
    top = seen.where((F.col("bad") + F.col("good") >= max(LEAST_TEXTS, LEAST_SHARE * bad)) & (share < 1)).withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).collect()
    if not top:
        return never
    top.sort(key=lambda r: np.uint64(r.feature & (1 << 64) - 1))
    vocabulary = np.array([r.feature for r in top], np.int64).view(np.uint64)
    marks = np.array([r.z > 0 and r.bad / bad > 10 * r.good / good for r in top])
    rows = texts.mapInArrow(_rows(vocabulary), ddl(_ROWS)).collect()
    s.sweep()
    rows.sort(key=lambda r: (r.toxic, bytes(r.features), bytes(r.counts)))  # the fit does not depend on row order
    feature = np.concatenate([np.frombuffer(r.features, np.int64) for r in rows])
    counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r.features) // 8 for r in rows])
    toxic = np.array([r.toxic for r in rows])
    marked = np.bincount(row, counts * marks[feature], minlength=len(rows))
    cuts = np.quantile(marked[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1)) if bad else []
    grade = np.where(toxic == 1, 1 + np.sum([marked > c for c in cuts], axis=0), 0).astype(np.int64)
    weights, thresholds = fit_ordinal(row, feature, np.log1p(counts), grade, len(vocabulary))
    return Model(vocabulary, weights, thresholds)


def _score(model_parts, names: list[str], keep_clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*model_parts)
        for b in batches:
            tails = np.zeros((b.num_rows, GRADES - 1))
            for first, h, at in features(b.column("text").cast(pa.string())):
                n = int(at.max()) + 1 if len(at) else 0
                tails[first : first + n] = model.tails(h, at, n)
            if keep_clean:
                yield b.filter(pa.array(tails[:, 0] < 0.5))
                continue
            new = {"expected_severity": pa.array(tails.sum(axis=1).round(6)), "grade": pa.array((tails >= 0.5).sum(axis=1).astype(np.int32)), "is_toxic": pa.array(tails[:, 0] >= 0.5)}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c) if c in b.schema.names else None) for c in names], names=names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) as (doc_id, expected_severity, grade, is_toxic); a null or empty text is clean, a text of any length is read as a whole.

    grade counts the thresholds passed with probability 1/2 or more; is_toxic: it is 1 or more. Rows are
    scored one by one, so repeated rows and ids give equal rows; other columns are left out.
    """
    names = ["doc_id", "expected_severity", "grade", "is_toxic"]
    parts = (model.vocabulary, model.weights, model.thresholds)
    return docs.select("doc_id", "text").mapInArrow(_score(parts, names, False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_severity double, grade int, is_toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns whatever their names, that are not toxic; null and empty texts stay, repeated rows stay or go alike."""
    parts = (model.vocabulary, model.weights, model.thresholds)
    return docs.mapInArrow(_score(parts, docs.columns, True), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(spark, docs, read(spark, sf_dir, "labels")))
