"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every passage of every document is a query against the index of items. Scores are divided by the item's
score for its own text, so one threshold fits items of any length, and items at or above it are retrieved;
each is then verified by the word n-grams of its question part and its answer part found in the passage.

Items are dealt to indexes by their length. Passages overlap and are twice as long as the longest item of an index
may be, so an item lies whole in one of them. Where not even the largest weights of an item's terms in the passage
reach the threshold for any item, there is no pivot to begin with; this is found for all passages of a batch at once, by
the weights of rare terms that occur and those of all common ones. Every other passage goes through block-max WAND.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.frames import Scratch, batch, ddl, prepare, read
from sediment.llm.kernel import ALNUM, U, mix, text_words

K1, B = 1.2, 0.75
#: Least share of an item's own BM25 score.
THRESHOLD = 0.6
#: Postings in a block.
BLOCK = 8
#: Words of an overlap n-gram, and the least share of a part's n-grams to be found.
GRAM, OVERLAP = 3, 0.5
#: Share of the item's words, at its end, that count as its answer.
ANSWER = 0.3
#: Words of the items in the first index at most, and how many times as many in each further one.
SPAN, WIDER = 16, 4
#: Bytes of item text that a task holds; more items are dealt to several shards, each of which meets every document.
INDEX_BYTES = 32 << 20
_END = 1 << 60


def _grams(words: np.ndarray, order: int = GRAM) -> np.ndarray:
    n = min(order, len(words))
    if not n:
        return words
    h = words[: len(words) - n + 1]
    for k in range(1, n):
        h = mix(h) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h) + U(n))


@dataclass
class Stats:
    """What scores take from all items: their number, words in all, and items by term (ascending)."""

    items: int
    words: int
    terms: np.ndarray
    df: np.ndarray


def stats_of(words: list[np.ndarray]) -> Stats:
    terms, df = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Stats(len(words), sum(map(len, words)), terms, df)


def span_of(n: int) -> int:
    """The longest item, in words, of the index that an item of n words belongs to."""
    span = SPAN
    while span < n:
        span *= WIDER
    return span


@dataclass
class Index:
    """Postings by term, ascending by item, in blocks that know their largest weight. stats and span: those of all items, where these are a part."""

    item_ids: list[int]
    words: list[np.ndarray]
    stats: Stats | None = None
    span: int = 0
    terms: np.ndarray = field(default=None)
    posts: list[np.ndarray] = field(default=None)
    weights: list[np.ndarray] = field(default=None)

    def __post_init__(self):
        n = len(self.words)
        lengths = np.array([len(w) for w in self.words], float)
        stats = self.stats or stats_of(self.words)
        self.span = self.span or (int(lengths.max()) if n else 1)
        mean = stats.words / max(1, stats.items)
        rows = []
        for i, w in enumerate(self.words):
            term, tf = np.unique(w, return_counts=True)
            rows.append((term, np.full(len(term), i), tf))
        term, item, tf = (np.concatenate(x) if n else np.zeros(0, np.uint64) for x in zip(*rows, strict=True)) if n else (np.zeros(0, np.uint64),) * 3
        self.terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
        item = item.astype(np.int64)
        all_df = stats.df[np.searchsorted(stats.terms, self.terms)]
        idf = np.log1p((stats.items - all_df + 0.5) / (all_df + 0.5))
        self.stats = None
        impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean)) if len(at) else np.zeros(0)
        own = np.bincount(item, impact, minlength=n)
        weight = impact / own[item] if len(at) else impact
        order = np.lexsort((item, at))
        cuts = np.cumsum(df)[:-1]
        self.posts, self.weights = np.split(item[order], cuts), np.split(weight[order], cuts)
        if not len(self.terms):
            self.posts, self.weights = [], []
        self.block_max = [np.maximum.reduceat(w, np.arange(0, len(w), BLOCK)) for w in self.weights]
        self.block_end = [p[np.minimum(np.arange(BLOCK - 1, len(p) + BLOCK - 1, BLOCK), len(p) - 1)] for p in self.posts]
        self.upper = np.array([w.max() for w in self.weights])
        self._reach(at, item, weight, df, n)
        cut = [len(w) - max(1, round(ANSWER * len(w))) if len(w) > 1 else len(w) for w in self.words]
        # n-grams of each part and their order: a part of fewer than GRAM words is one n-gram of its own length
        self.parts = [tuple((min(GRAM, len(p)), _grams(p)) for p in (w[:c], w[c:])) for w, c in zip(self.words, cut, strict=True)]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.terms >> U(44)).astype(np.int64)] = True

    def _reach(self, at: np.ndarray, item: np.ndarray, weight: np.ndarray, df: np.ndarray, n: int) -> None:
        """Splits each item's terms: common ones, whose weights in all stay well below the threshold, and rare ones."""
        rare, self.common = np.ones(len(at), bool), np.zeros(n)
        for k in np.lexsort((weight, -df[at])).tolist() if len(at) else []:  # the most widespread first
            if self.common[item[k]] + weight[k] < THRESHOLD / 2:
                self.common[item[k]] += weight[k]
                rare[k] = False
        order = np.lexsort((item, at))
        order = order[rare[order]]
        self.rare_count = np.bincount(at[rare], minlength=len(self.terms)) if len(at) else np.zeros(0, np.int64)
        self.rare_start = np.concatenate([[0], np.cumsum(self.rare_count)])
        self.rare_item, self.rare_weight = item[order], weight[order]

    def passages_in_reach(self, words: np.ndarray, text: np.ndarray, position: np.ndarray) -> np.ndarray:
        """(n, 3): text, passage number and item of every item in reach of a passage, sorted."""
        none = np.zeros((0, 3), np.int64)
        hit = np.flatnonzero(self.flags[(words >> U(44)).astype(np.int64)])
        if not len(hit):
            return none
        at = np.minimum(np.searchsorted(self.terms, words[hit]), len(self.terms) - 1)
        ok = (self.terms[at] == words[hit]) & (self.rare_count[at] > 0)
        hit, at = hit[ok], at[ok]
        if not len(hit):
            return none
        n = self.rare_count[at]
        which = np.repeat(np.arange(len(hit)), n)
        post = np.repeat(self.rare_start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        number = position[hit][which] // self.span
        # a position lies in the passage that starts at its span and in the one before
        key = np.stack([np.tile(text[hit][which], 2), np.concatenate([number, number - 1]), np.tile(self.rare_item[post], 2), np.tile(at[which], 2), np.tile(post, 2)])
        key = key[:, key[1] >= 0]
        order = np.lexsort(key[[3, 2, 1, 0]])
        key = key[:, order]
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:4, 1:] != key[:4, :-1]).any(axis=0)  # a term counts once in a passage
        key = key[:, new]
        first = np.ones(key.shape[1], bool)
        first[1:] = (key[:3, 1:] != key[:3, :-1]).any(axis=0)
        at = np.flatnonzero(first)
        bound = np.add.reduceat(self.rare_weight[key[4]], at) + self.common[key[2, at]]
        return key[:3, at[bound >= THRESHOLD - 1e-9]].T

    def retrieve(self, passage: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item, score) of every item that reaches the threshold, by block-max WAND over the passage's terms."""
        words = np.unique(passage)
        at = np.searchsorted(self.terms, words)
        there = at < len(self.terms)
        at = at[there][self.terms[at[there]] == words[there]]
        lists = [[int(self.posts[t][0]), 0, t] for t in at.tolist()]  # current item, its place, term
        found, goal = [], threshold - 1e-9
        while lists:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += self.upper[x[2]]
                if total >= goal:
                    pivot = k
                    break
            if pivot < 0 or lists[pivot][0] >= _END:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # what the blocks that could hold the pivot item allow, and where the first of them ends
            total, end = 0.0, _END
            for x in lists[: pivot + 1]:
                block = int(np.searchsorted(self.block_end[x[2]], item))
                if block < len(self.block_end[x[2]]):
                    total += self.block_max[x[2]][block]
                    end = min(end, int(self.block_end[x[2]][block]))
            if total < goal:
                target = end + 1
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0])
                target = max(target, item + 1)
            elif lists[0][0] == item:
                score = float(sum(self.weights[x[2]][x[1]] for x in lists[: pivot + 1]))
                if score >= goal:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for x in lists[: pivot + 1]:
                if x[0] < target:
                    x[1] = int(np.searchsorted(self.posts[x[2]], target))
                    x[0] = int(self.posts[x[2]][x[1]]) if x[1] < len(self.posts[x[2]]) else _END
        return found

    def matches(self, words: np.ndarray, text: np.ndarray, position: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item): score and the two overlaps of the best verified passage."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        reach = self.passages_in_reach(words, text, position)
        for t, number in np.unique(reach[:, :2], axis=0).tolist() if len(reach) else []:
            lo = int(off[t]) + number * self.span
            passage = words[lo : min(int(off[t + 1]), lo + 2 * self.span)]
            grams: dict[int, np.ndarray] = {}
            for item, score in self.retrieve(passage):
                overlap = []
                for order, part in self.parts[item]:
                    if order not in grams:
                        grams[order] = _grams(passage, order)
                    overlap.append(float(np.isin(part, grams[order]).mean()) if order else 1.0)
                if min(overlap) >= OVERLAP:
                    best[t, item] = max(best.get((t, item), (0.0, 0.0, 0.0)), (score, *overlap))
        return best


_TERMS = {"shard": pa.int64(), "words": pa.int64(), "terms": pa.list_(pa.int64())}


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [w for _, w, _ in text_words(b.column("text").cast(pa.string()), ALNUM, at_most=1)] if b.num_rows else []
        kept = [k for k, w in enumerate(words) if len(w)]
        shards = b.column("shard").to_pylist()
        yield batch(_TERMS, shard=[shards[k] for k in kept], words=[len(words[k]) for k in kept], terms=[np.unique(words[k]).view(np.int64) for k in kept])


def _shard_stats(items: DataFrame, shards: int) -> Iterator[Stats]:
    """For each shard in turn, the figures of all items; document frequencies only of the shard's own terms."""
    s = Scratch(items.sparkSession)
    rows = s.save(items.mapInArrow(_item_terms, ddl(_TERMS)))
    each = rows.select("shard", F.explode("terms").alias("term")).groupBy("shard", "term").agg(F.count("*").alias("n"))
    each = s.save(each)
    whole = s.save(each.groupBy("term").agg(F.sum("n").alias("df")))
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    for k in range(shards):
        got = whole.join(each.where(F.col("shard") == k).select("term"), "term", "left_semi").toArrow()
        terms = got.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        yield Stats(n, words, terms[order], got.column("df").to_numpy()[order])
    s.drop(*s.tables)


def indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Shards of the items (item_id, text), each of at most about INDEX_BYTES of text, as one index for each class of lengths.

    Items without words have no place. Scores and finds do not depend on the shards: every index takes the figures of all items.
    """
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    shards = 1 + int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // INDEX_BYTES
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards).cast("bigint")))
    for k, of_all in enumerate(_shard_stats(items, shards) if shards > 1 else [None]):
        rows = items.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        words = [w for _, w, _ in text_words(pa.array([r.text for r in rows], pa.string()), ALNUM, at_most=1)] if rows else []
        kept = [(r.item_id, w) for r, w in zip(rows, words, strict=True) if len(w)]
        of_all = of_all or stats_of([w for _, w in kept])
        spans = sorted({span_of(len(w)) for _, w in kept})
        yield [Index([i for i, w in kept if span_of(len(w)) == span], [w for _, w in kept if span_of(len(w)) == span], of_all, span) for span in spans]


def _text_matches(shard: list[Index], column: pa.Array) -> Iterator[tuple[int, dict]]:
    """(first row, {(text, item_id): [score and overlaps]}) for each group of texts of a column; items that share an id give one entry each."""
    if not shard:
        return
    for first, words, off in text_words(column, ALNUM):
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        found: dict = {}
        for index in shard:
            for (t, i), got in index.matches(words, text, np.arange(len(words)) - off[text], off).items():
                found.setdefault((t, index.item_ids[i]), []).append(got)
        yield first, found


_LEAKS = {"doc_id": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}


def _leaks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        for b in batches:
            ids = b.column("doc_id")
            for first, found in _text_matches(shard, b.column("text")):
                rows = [(at, v) for at, each in sorted(found.items()) for v in sorted(each)]
                if rows:
                    yield batch(_LEAKS, doc_id=[ids[first + t].as_py() for (t, _), _ in rows], item_id=[i for (_, i), _ in rows], **{c: [round(v[k], 6) for _, v in rows] for k, c in enumerate(("score", "question_overlap", "answer_overlap"))})

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for first, found in _text_matches(shard, b.column("text").cast(pa.string())):
                keep[[first + t for t, _ in found]] = False
            yield b.filter(pa.array(keep))

    return run


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): items found in a document, at its best passage.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. Null and empty texts on either side match
    nothing; repeated documents and items each give their rows; a null doc_id stays null. A text of any length is
    searched as a whole. An empty table on either side gives no rows. Other columns are left out.
    """
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = None
    for shard in indexes(benchmark):
        part = texts.mapInArrow(_leaks(spark.sparkContext.broadcast(shard)), ddl(_LEAKS))
        out = part if out is None else out.union(part)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, in which no item is found.

    Null and empty texts hold nothing and stay; repeated rows stay or go alike; a text of any length is searched as a whole.
    """
    prepare(spark)
    for shard in indexes(benchmark):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(shard)), docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
