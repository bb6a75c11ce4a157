"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes of lower-cased text, of order ORDER, trained on every document labelled as good. Its
counts, continuation counts, context totals and interpolated probabilities are tables sharded by n-gram,
made by aggregates and joins. A document's perplexity comes from joining its n-grams to these tables:
a model within MODEL_ROWS n-grams goes to the tasks and is looked up there; a larger one stays sharded,
and the documents' n-gram counts are shuffled to it. Both ways give the same sums.

A document is kept if its perplexity lies between two quantiles of its language's trusted documents. The upper one is of
perplexities under models that have not seen the document: trusted documents are dealt to two folds, and each is scored by
the model of the other one. The lower one is of perplexities under the whole model, since no clean text can be more familiar to it
than what it was trained on. All three models are made at once, as rows of the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.frames import Scratch, batch, ddl, prepare, read
from sediment.llm.kernel import CHUNK, U, _string_parts, mix, take_ranges

ORDER = 5
#: N-grams of all orders that a model may hold to be sent to the tasks, some 100 MB; and ids of trusted rows likewise.
MODEL_ROWS, TRUSTED_ROWS = 4 << 20, 1 << 20
#: Quantiles of the trusted documents that are the limits, and steps of perplexity, to each factor of e, that they are taken in.
LOW, HIGH, STEPS = 0.005, 0.995, 1000
#: The whole model, and the two that have seen one fold each.
WHOLE, FOLDS = 2, (0, 1)
#: N-gram entries that a task holds before it sends them on.
HELD = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PAD = 0x20


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of texts as (first row, the ORDER-gram that ends at each byte, offsets); texts begin after spaces."""
    data, off = _string_parts(column)
    rows, row, pad = len(off) - 1, 0, ORDER - 1
    while row < rows:
        end = max(int(np.searchsorted(off, off[row] + CHUNK, side="right")) - 1, row + 1)
        lens = np.diff(off[row : end + 1])
        at = np.concatenate([[0], np.cumsum(lens + pad)])
        buf = np.full(int(at[-1]) + pad, PAD, np.int64)
        buf[take_ranges(at[:-1] + pad, lens)] = _LOWER[data[int(off[row]) : int(off[end])]]
        g = buf[: len(buf) - pad].copy()
        for j in range(1, ORDER):
            g = (g << 8) | buf[j : len(buf) - pad + j]
        yield row, g[take_ranges(at[:-1], lens)], np.concatenate([[0], np.cumsum(lens)])
        row = end


_COUNTS = {"gram": pa.int64(), "n": pa.int64()}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram counts of a task."""
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        g, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, at = np.unique(g, return_inverse=True)
        return keys, np.bincount(at, n, minlength=len(keys)).astype(np.int64)

    for b in batches:
        for _, g, _ in grams(b.column("text")):
            held.append(np.unique(g, return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield batch(_COUNTS, gram=held[0][0], n=held[0][1])
                    held, size = [], 0
    if held:
        keys, n = merged()
        yield batch(_COUNTS, gram=keys, n=n)


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many n-grams occur 1, 2, 3 and 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [k - (k + 1) * y * b / a if a and b else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.1), k - 0.1) for k, x in enumerate(d, 1))


def build(s: Scratch, trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (model, gram, p) of what was seen and (model, context, gamma) of the contexts seen.

    trusted: (text, fold). Model WHOLE has seen all, model k of FOLDS the documents of that fold.
    """
    parts = [trusted.where(F.col("fold") == k).select("text").mapInArrow(_counts, ddl(_COUNTS)).withColumn("fold", F.lit(k)) for k in FOLDS]
    seen = parts[0].union(parts[1]).groupBy("fold", "gram").agg(F.sum("n").alias("c"))
    seen = seen.select(F.explode(F.array("fold", F.lit(WHOLE))).alias("model"), "gram", "c")
    counts = s.save(seen.groupBy("model", "gram").agg(F.sum("c").alias("c")))
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # a lower order counts the different bytes before an n-gram
        levels.insert(0, s.save(levels[0].groupBy("model", F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).agg(F.count("*").alias("c"))))
    out, below = [], None
    for k, level in enumerate(levels, 1):
        few = level.groupBy("model").agg(*[F.sum((F.col("c") == j).cast("bigint")).alias(f"n{j}") for j in range(1, 5)]).collect()
        off = F.lit(None).cast("double")
        for r in few:
            d1, d2, d3 = discounts(*(float(x or 0) for x in (r.n1, r.n2, r.n3, r.n4)))
            off = F.when(F.col("model") == r.model, F.when(F.col("c") == 1, F.lit(d1)).when(F.col("c") == 2, F.lit(d2)).otherwise(F.lit(d3))).otherwise(off)
        level = level.withColumn("h", F.shiftright("gram", 8))
        context = s.save(level.groupBy("model", "h").agg(F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("gamma")))
        joined = level.join(context, ["model", "h"]).select("model", "gram", ((F.col("c") - off) / F.col("total")).alias("own"), "gamma")
        if below is None:
            p = F.col("own") + F.col("gamma") / F.lit(256.0)
        else:
            low = below.select("model", F.col("gram").alias("low"), F.col("p").alias("q"))
            joined = joined.withColumn("low", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(low, ["model", "low"])
            p = F.col("own") + F.col("gamma") * F.col("q")
        below = s.save(joined.select("model", "gram", p.alias("p")))
        out.append((below, context.select("model", F.col("h").alias("context"), "gamma")))
    return out


def one_model(levels: list[tuple[DataFrame, DataFrame]], model: int) -> list[tuple[DataFrame, DataFrame]]:
    return [tuple(t.where(F.col("model") == model).drop("model") for t in level) for level in levels]


class Lookup:
    """int64 keys to doubles, in an open-addressed table that is read for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.shift = U(64 - (size.bit_length() - 1))
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.zeros(size)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            slots, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[slots], self.values[slots] = keys[put], values[put]
            rest = self.keys[slot] != keys[left]
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out, slot = np.full(len(keys), default), self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            got = self.keys[slot]
            hit = got == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (got != -1)
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out


class Model:
    """The tables of every order, for lookups in a task."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.seen = [Lookup(g, np.log(p)) for g, p, _, _ in levels]
        self.context = [Lookup(h, np.log(gamma)) for _, _, h, gamma in levels]

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        """The log probability of each ORDER-gram's last byte after the others."""
        out, left, now = np.zeros(len(gram)), np.arange(len(gram)), gram
        for k in range(ORDER, 0, -1):
            p = self.seen[k - 1].get(now, 1.0)  # no log probability is positive
            hit = p <= 0
            out[left[hit]] += p[hit]
            left, now = left[~hit], now[~hit]
            if not len(left):
                return out
            out[left] += self.context[k - 1].get(now >> 8, 0.0)
            now = now & _mask(k - 1)
        out[left] += -np.log(256.0)
        return out


_SUMS = {"n_bytes": pa.int64(), "log_p": pa.float64()}


def _sums(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            for first, g, off in grams(b.column("text")):
                sums = np.concatenate([[0.0], np.cumsum(model.log_p(g))])[off]
                part = b.slice(first, len(off) - 1)
                new = {"n_bytes": pa.array(np.diff(off)), "log_p": pa.array(np.diff(sums))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in names], names=names)

    return run


_ENTRIES = {"row": pa.int64(), "gram": pa.int64(), "n": pa.int64()}


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("row").to_numpy()
        for first, g, off in grams(b.column("text")):
            for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                if z > a:
                    key, n = np.unique(g[a:z], return_counts=True)
                    yield batch(_ENTRIES, row=np.full(len(key), ids[first + i]), gram=key, n=n)


def score_joined(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(row, log_p) of docs (row, text) by joins to the sharded tables, n-grams of one text counted first."""
    entries = docs.select("row", "text").mapInArrow(_entries, ddl(_ENTRIES))
    # each different n-gram of the documents gets its log probability once
    left = entries.select("gram").distinct().withColumns({"now": F.col("gram"), "log": F.lit(0.0)})
    done = None
    for k in range(ORDER, 0, -1):
        seen, context = model[k - 1]
        got = left.join(seen.select(F.col("gram").alias("now"), "p"), "now", "left")
        part = got.where("p is not null").select("gram", (F.col("log") + F.log("p")).alias("log"))
        done = part if done is None else done.union(part)
        rest = got.where("p is null").drop("p").withColumn("context", F.shiftright("now", 8)).join(context, "context", "left")
        left = rest.select("gram", F.col("now").bitwiseAND(F.lit(_mask(k - 1))).alias("now"), (F.col("log") + F.coalesce(F.log("gamma"), F.lit(0.0))).alias("log"))
    done = done.union(left.select("gram", (F.col("log") - F.log(F.lit(256.0))).alias("log")))
    return entries.join(done, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("log_p"))


def score(spark: SparkSession, s: Scratch, docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], most: int = MODEL_ROWS) -> DataFrame:
    """docs (doc_id, lang, text) as (doc_id, lang, n_bytes, log_p)."""
    texts = docs.select("doc_id", "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if sum(t.count() for level in model for t in level) <= most:
        tables = [tuple(c.to_numpy() for t in level for c in t.toArrow().columns) for level in model]
        shared = spark.sparkContext.broadcast(tables)
        names = ["doc_id", "lang", *_SUMS]
        kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang"))
        return texts.mapInArrow(_sums(shared, names), f"{kinds}, {ddl(_SUMS)}")
    numbered = s.save(texts.withColumn("row", F.monotonically_increasing_id()))
    sums = score_joined(numbered, model)
    out = numbered.withColumn("n_bytes", F.octet_length("text").cast("bigint")).join(sums, "row", "left")
    return out.select("doc_id", "lang", "n_bytes", F.coalesce("log_p", F.lit(0.0)).alias("log_p"))


def _perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))))


def quantile_step(scored: DataFrame, share: float, *by: str) -> DataFrame:
    """(by, step): the step of log perplexity that holds the quantile. Rows are counted by step, so no group is collected."""
    steps = scored.groupBy(*by, F.floor(F.log("perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    reached = steps.withColumns({"upto": upto, "all": F.sum("n").over(group)}).where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("all"))))
    return reached.groupBy(*by).agg(F.min("step").alias("step"))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, low: float = LOW, high: float = HIGH, most: int = MODEL_ROWS) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, keep) for each row of docs (doc_id, lang, text).

    The model is trained on all rows of docs whose doc_id has quality 1 in labels (doc_id, quality). A row is
    kept if its perplexity lies between the limits of its language, or those of all where lang is null or has no trusted rows:
    the low quantile of trusted rows under the whole model and the high one of trusted rows under the model of the other
    fold, each rounded outwards to a step of a thousandth. An empty or null text has a null perplexity
    and is not kept; without any trusted text the model is uniform and every other row is kept. A text of any length is
    scored as a whole. Repeated rows count as often as they stand, and those of one doc_id are in one fold; other columns are left out.
    """
    prepare(spark)
    s = Scratch(spark)
    good = s.save(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    held = good
    if good.count() <= TRUSTED_ROWS:
        good = F.broadcast(good)
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    trusted = s.save(rows.join(good, "doc_id", "left_semi").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(len(FOLDS))).cast("int")))
    model = build(s, trusted)
    scored = s.save(_perplexity(score(spark, s, rows, one_model(model, WHOLE), most)))
    unseen = [score(spark, s, trusted.where(F.col("fold") == k), one_model(model, 1 - k), most) for k in FOLDS]
    unseen = s.save(_perplexity(unseen[0].union(unseen[1])).where("perplexity is not null"))
    s.sweep(scored, unseen, held)
    seen = scored.join(good, "doc_id", "left_semi").where("perplexity is not null")
    limits, everyone = None, {}
    for name, source, share in (("least", seen, low), ("most", unseen, high)):
        step = F.col("step") / STEPS if name == "least" else (F.col("step") + 1) / STEPS
        one = quantile_step(source.where("lang is not null"), share, "lang").select("lang", F.exp(step).alias(name))
        limits = one if limits is None else limits.join(one, "lang", "full")
        everyone[name] = quantile_step(source, share).select(F.exp(step).alias("x")).first()
    limits = s.save(limits, narrow=True)
    bound = {name: F.coalesce(name, F.lit(r.x if r else None).cast("double")) for name, r in everyone.items()}
    usual = F.coalesce(F.col("perplexity").between(bound["least"], bound["most"]), F.lit(True))
    keep = F.col("perplexity").isNotNull() & usual
    return scored.join(limits, "lang", "left").select("doc_id", "lang", "n_bytes", F.round("perplexity", 6).alias("perplexity"), keep.alias("keep"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
