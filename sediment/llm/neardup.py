"""MinHash near-duplicates by chosen-path set similarity join.

Documents branch down independent trees: a node of a tree is a path of minwise tokens, the path so far
chooses the coordinate whose token comes next, and documents with similar sets tend to choose the same
path. A node of few documents is compared exhaustively on sketches; larger ones branch on. What trees
bring together is then confirmed on full shingle sets, cluster by cluster, so a wrong guess costs time
and never a wrong link.

Copies of one set are one vertex from the start, known by the smallest doc_id, or by a hash of that and the text where rows share it and differ in text. A cluster too large for one task is dealt into blocks:
links within blocks first, then of every block to the cluster's most central documents, then of what
is still outside the largest component to every block. No step sees all pairs of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.frames import Scratch, batch, components, ddl, groups, prepare, read
from sediment.llm.kernel import U, mix, shingle_sets

#: Independent trees. Two sets of Jaccard 0.85 share a token of one tree's root with probability 0.85: 12 miss with 1e-10.
TREES = 12
#: Levels of a tree. After the last, documents still together in a large node become one cluster to confirm.
DEPTH = 4
#: Minwise coordinates: the first PATHS choose paths, all of them make the sketch.
COORDS, PATHS = 128, 64
#: Documents that a node may hold to be compared exhaustively.
LEAF = 64
#: A pair is a candidate from this share of equal sketch coordinates: 4.7 deviations below a Jaccard of 0.85.
SKETCH = 0.70
#: Members of clusters, 24 bytes each, up to which they are told to all tasks, so that texts stay where they are.
TOLD = 1 << 20
#: Documents of a cluster that one task confirms, and of a block of larger clusters.
CLUSTER, BLOCK = 256, 128
#: Central documents that every block of a large cluster is held against.
LEADERS = 8

_rng = np.random.default_rng(1409)
_MULT = (_rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) << U(1)) | U(1)
_SALT = _rng.integers(1, 1 << 63, TREES, dtype=np.uint64)
_ROOT = _rng.permutation(PATHS)[:TREES]
_STEP = U(0x9FB21C651E98DF25)


def minwise(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The COORDS minwise tokens of each non-empty set."""
    out = np.empty((len(off) - 1, COORDS), np.uint64)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(sets * _MULT[k], off[:-1])
    return out


def paths(tokens: np.ndarray) -> np.ndarray:
    """(documents, TREES, DEPTH): the node of each document at each level of each tree."""
    n = len(tokens)
    out, rows = np.empty((n, TREES, DEPTH), np.uint64), np.arange(n)
    for t in range(TREES):
        node, coord = np.full(n, _SALT[t]), np.full(n, _ROOT[t])
        for d in range(DEPTH):
            node = mix(node * _STEP + tokens[rows, coord] + coord.astype(np.uint64))
            out[:, t, d] = node
            coord = (node % U(PATHS)).astype(np.int64)
    return out


_FEATURES = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n_shingles": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "sketch": pa.binary(), "path": pa.binary()}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, sets, off in shingle_sets(b.column("text")):
            n = np.diff(off)
            rows = len(n)
            full = np.flatnonzero(n)
            f1, f2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            sketch, path = [None] * rows, [None] * rows
            if len(full):
                at = off[:-1][full]
                f1[full] = np.add.reduceat(mix(sets), at)
                f2[full] = np.add.reduceat(mix(sets ^ _STEP), at)
                tokens = minwise(sets, np.append(at, len(sets)))
                short, long = (tokens & U(0xFFFF)).astype(np.uint16), paths(tokens)
                for i, r in enumerate(full.tolist()):
                    sketch[r], path[r] = short[i].tobytes(), long[i].tobytes()
            yield batch(_FEATURES, doc_id=b.column("doc_id").slice(first, rows), text_hash=b.column("text_hash").slice(first, rows), n_shingles=n.astype(np.int64), f1=f1.view(np.int64), f2=f2.view(np.int64), sketch=sketch, path=path)


_NODES = {"vertex": pa.int64()} | {f"k{d}": pa.int64() for d in range(1, DEPTH + 1)}


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        at = np.frombuffer(b"".join(b.column("path").to_pylist()), np.int64).reshape(-1, DEPTH)
        ids = np.repeat(b.column("vertex").to_numpy(), TREES)
        yield batch(_NODES, vertex=ids, **{f"k{d + 1}": at[:, d] for d in range(DEPTH)})


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


_EDGES = {"a": pa.int64(), "b": pa.int64()}


def _leaf_edges(sketch: float):
    """Compares a small node exhaustively on sketches; a spanning forest of its candidates is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups(batches, "node"):
            ids = g.column("vertex").to_numpy()
            s = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint16).reshape(len(ids), COORDS)
            found = Union(ids.tolist())
            for i in range(1, len(ids)):
                for j in np.flatnonzero((s[:i] == s[i]).mean(axis=1) >= sketch).tolist():
                    found.join(int(ids[i]), int(ids[j]))
            for x in found.up:
                if (r := found.find(x)) != x:
                    a.append(x)
                    b.append(r)
            if len(a) >= 4096:
                yield batch(_EDGES, a=a, b=b)
                a, b = [], []
        yield batch(_EDGES, a=a, b=b)

    return run


_SETS = {"cluster": pa.int64(), "size": pa.int64(), "vertex": pa.int64(), "shingles": pa.binary()}


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, sets, off in shingle_sets(b.column("text")):
            rows = len(off) - 1
            packed = [sets[lo:hi].tobytes() for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield batch(_SETS, shingles=packed, **{k: b.column(k).slice(first, rows) for k in ("cluster", "size", "vertex")})


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity: 100 * |intersection| >= percent * |union|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class _Members:
    def __init__(self, g: pa.RecordBatch, rule: tuple[int, float]):
        self.percent, self.least = rule
        self.ids = g.column("vertex").to_numpy()
        self.sets = [np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()]
        off = np.concatenate([[0], np.cumsum([len(s) for s in self.sets])])
        self.sketch = (minwise(np.concatenate(self.sets), off) & U(0xFFFF)).astype(np.uint16)

    def confirm(self, found: Union, label: np.ndarray, i: int, others: np.ndarray) -> None:
        """Link member i to those of others that no link joins it to yet; the likeliest are tried first."""
        like = (self.sketch[others] == self.sketch[i]).mean(axis=1)
        for k in np.argsort(-like, kind="stable").tolist():
            if like[k] < self.least:
                break
            j = int(others[k])
            if found.find(int(label[i])) != found.find(int(label[j])) and linked(self.sets[i], self.sets[j], self.percent):
                found.join(int(label[i]), int(label[j]))


def _confirm_clusters(rule: tuple[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "cluster"):
            m = _Members(g, rule)
            found = Union(m.ids.tolist())
            for i in range(1, len(m.ids)):
                m.confirm(found, m.ids, i, np.arange(i))
            ids = list(found.up)
            yield batch(_EDGES, a=ids, b=[found.find(x) for x in ids])

    return run


_BLOCKS = _EDGES | {"cluster": pa.int64(), "block": pa.int64(), "sketch": pa.binary(), "score": pa.float64(), "shingles": pa.binary()}


def _confirm_blocks(rule: tuple[int, float]):
    """Links within a block, each document's sketch, and the block's most central document with its mean likeness to the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "cluster", "block"):
            m = _Members(g, rule)
            found = Union(m.ids.tolist())
            like = np.zeros(len(m.ids))
            for i in range(1, len(m.ids)):
                m.confirm(found, m.ids, i, np.arange(i))
            for i in range(len(m.ids)):
                like[i] = (m.sketch == m.sketch[i]).mean()
            best = int(np.argmax(like))
            ids = list(found.up)
            at = ids.index(int(m.ids[best]))
            score, sets = [None] * len(ids), [None] * len(ids)
            score[at], sets[at] = float(like[best]), m.sets[best].tobytes()
            place = {k: [g.column(k)[0].as_py()] * len(ids) for k in ("cluster", "block")}
            sketch = dict(zip(m.ids.tolist(), m.sketch, strict=True))
            yield batch(_BLOCKS, a=ids, b=[found.find(x) for x in ids], sketch=[sketch[x].tobytes() for x in ids], score=score, shingles=sets, **place)

    return run


def _confirm_across(rule: tuple[int, float]):
    """Links between the documents marked `near` and the others of a group; `label` is the component known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "cluster", "block", "other"):
            near = g.column("near").to_numpy(zero_copy_only=False).astype(bool)
            if near.all() or not near.any():
                continue
            m = _Members(g, rule)
            label = g.column("label").to_numpy()
            found, rest = Union(label.tolist()), np.flatnonzero(~near)
            for i in np.flatnonzero(near).tolist():
                m.confirm(found, label, i, rest)
            ids = [x for x in found.up if found.find(x) != x]
            if ids:
                yield batch(_EDGES, a=ids, b=[found.find(x) for x in ids])

    return run


_LIKELY = {"cluster": pa.int64(), "block": pa.int64(), "other": pa.int64(), "near": pa.bool_(), "label": pa.int64(), "vertex": pa.int64()}


def _likely_across(least: float):
    """What _confirm_across could link, by sketches alone: rows of a group with a partner on the other side, in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "cluster", "block", "other"):
            near = g.column("near").to_numpy(zero_copy_only=False).astype(bool)
            label = g.column("label").to_numpy()
            sketch = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDS)
            hit, rest = np.zeros(g.num_rows, bool), np.flatnonzero(~near)
            for i in np.flatnonzero(near).tolist():
                like = ((sketch[rest] == sketch[i]).mean(axis=1) >= least) & (label[rest] != label[i])
                hit[i] |= like.any()
                hit[rest[like]] = True
            if hit.any():
                part = g.filter(pa.array(hit))
                yield batch(_LIKELY, **{k: part.column(k) for k in _LIKELY})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, *, percent: int = 85, sketch: float = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Texts whose sets of distinct 5-word shingles reach `percent` of Jaccard similarity are linked; a text of
    fewer words is one shingle, a null text or one without words is linked with nothing and keeps its
    own doc_id as component_id. kept: the row's doc_id is its component's smallest. Rows of equal text
    are linked; rows that repeat a doc_id each get their own text's component. A null doc_id never
    names a component unless no copy has an id. Further columns of docs are ignored; an empty table gives none; a text
    of any length gives all its shingles. sketch: pairs that share fewer of their sketch's coordinates are not
    confirmed; with 0, every pair is that a tree brings together, at more cost.
    """
    return marked_rows(spark, docs, percent=percent, sketch=sketch).drop("text_hash")


def text_hash(column: str) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.col(column).cast("string"))


def marked_rows(spark: SparkSession, docs: DataFrame, *, percent: int = 85, sketch: float = SKETCH) -> DataFrame:
    """near_duplicates with the text_hash of each row."""
    prepare(spark)
    s = Scratch(spark)
    feats = s.save(_texts(docs).mapInArrow(_features, ddl(_FEATURES)))
    some = feats.where("n_shingles > 0")
    sets = ["n_shingles", "f1", "f2"]
    reps = some.groupBy(*sets).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("row"), F.first("sketch").alias("sketch"), F.first("path").alias("path"), F.count("*").alias("copies"))
    ids = some.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
    shared = s.save(ids.where("low != high").select("doc_id", F.lit(True).alias("shared")), narrow=True)
    # a vertex is the doc_id, or where different texts share that, a hash of both
    reps = reps.select("*", "row.doc_id", "row.text_hash").drop("row").join(shared, "doc_id", "left")
    reps = s.save(reps.withColumn("vertex", F.when(F.col("shared"), F.xxhash64("doc_id", "text_hash")).otherwise(F.col("doc_id"))))
    own = None if shared.isEmpty() else reps.where("shared").select("vertex", "doc_id", "text_hash")

    edges = s.save(_candidates(s, reps.where("doc_id is not null"), sketch), narrow=True)
    s.sweep(feats, reps, edges)
    clusters = s.save(components(s, edges), narrow=True)
    s.sweep(feats, reps, clusters)
    roots = s.save(_links(s, docs, own, clusters, (percent, sketch)), narrow=True)
    if own is not None:
        named = roots.join(reps.select("vertex", "doc_id"), roots.node == F.col("vertex")).groupBy("root").agg(F.min("doc_id").alias("name"))
        roots = s.save(roots.join(named, "root").select("node", F.col("name").alias("root")), narrow=True)
    s.sweep(feats, reps, roots)

    # a class of copies takes its representative's component; classes of one unlinked row need no join
    moved = reps.join(roots, reps.vertex == roots.node, "left").select(*sets, F.coalesce("root", "doc_id").alias("root")).where("root is not null")
    moved = s.save(reps.where("copies > 1").select(*sets).union(reps.join(roots, reps.vertex == roots.node, "left_semi").select(*sets)).distinct().join(moved, sets), narrow=True)
    s.sweep(feats, moved)
    out = feats.select("doc_id", "text_hash", *sets).join(moved, sets, "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), text_hash("text").alias("text_hash"))


def _candidates(s: Scratch, reps: DataFrame, sketch: float) -> DataFrame:
    """Edges between documents that a tree brings together and whose sketches agree."""
    now = reps.select("path", "vertex").mapInArrow(_nodes, ddl(_NODES))
    leaves, last = [], f"k{DEPTH}"
    for d in range(1, DEPTH + 1):
        key = f"k{d}"
        counts = s.save(now.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), narrow=True)
        met = s.save(now.join(counts, key).select(*_NODES, "n"), narrow=True)
        leaves.append(met.where(F.col("n") <= LEAF).select(F.col(key).alias("node"), "vertex"))
        now = met.where(F.col("n") > LEAF).select(*_NODES)
        if now.isEmpty():
            now = None
            break
    small = leaves[0]
    for more in leaves[1:]:
        small = small.union(more)
    small = small.distinct().join(reps.select("vertex", "sketch"), "vertex").repartition("node").sortWithinPartitions("node")
    edges = small.mapInArrow(_leaf_edges(sketch), ddl(_EDGES)).distinct()
    if now is not None:
        first = s.save(now.groupBy(last).agg(F.min("vertex").alias("b")), narrow=True)
        edges = edges.union(now.join(first, last).select(F.col("vertex").alias("a"), "b").distinct())
    return edges


def _links(s: Scratch, docs: DataFrame, own: DataFrame | None, clusters: DataFrame, rule: tuple[int, float]) -> DataFrame:
    """(node, root): the confirmed component of every set in a cluster."""
    sizes = s.save(clusters.groupBy("root").agg(F.count("*").alias("size")), narrow=True)
    member = s.save(clusters.join(sizes, "root").select(F.col("root").alias("cluster"), "size", F.col("node").alias("vertex")), narrow=True)
    if member.count() <= TOLD:
        member = F.broadcast(member)
    texts = _texts(docs)
    rows = texts.select(F.col("doc_id").alias("vertex"), "text").join(member, "vertex").select("vertex", "text", "cluster", "size")
    if own is not None:
        rows = rows.union(texts.join(member.join(own, "vertex"), ["doc_id", "text_hash"]).select(*rows.columns))
    held = s.save(rows.mapInArrow(_sets, ddl(_SETS)).where("length(shingles) > 0"))
    whole = held.where(F.col("size") <= CLUSTER).repartition("cluster").sortWithinPartitions("cluster")
    done = s.save(whole.mapInArrow(_confirm_clusters(rule), ddl(_EDGES)), narrow=True)
    large = held.where(F.col("size") > CLUSTER).withColumn("block", F.pmod(F.xxhash64("vertex"), F.ceil(F.col("size") / BLOCK)))
    if large.isEmpty():
        return done.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))

    dealt = large.repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    inner = s.save(dealt.mapInArrow(_confirm_blocks(rule), ddl(_BLOCKS)))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "a")
    leaders = s.save(inner.where("score is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS).select("cluster", F.col("a").alias("vertex"), "shingles"))
    blocks = large.select("cluster", "block").distinct()
    label = inner.select("cluster", F.col("a").alias("vertex"), F.col("b").alias("label"))
    rows = ["cluster", "block", "other", "near", "label", "vertex", "shingles"]
    known = large.join(label, ["cluster", "vertex"])
    to_all = known.select("cluster", "block", F.lit(0).cast("bigint").alias("other"), F.lit(False).alias("near"), "label", "vertex", "shingles")
    led = leaders.join(label, ["cluster", "vertex"]).join(blocks, "cluster").select("cluster", "block", F.lit(0).cast("bigint").alias("other"), F.lit(True).alias("near"), "label", "vertex", "shingles")
    across = to_all.select(*rows).union(led.select(*rows)).repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    edges = s.save(inner.select("a", "b").union(across.mapInArrow(_confirm_across(rule), ddl(_EDGES))))
    parts = s.save(components(s, edges), narrow=True)

    # what is outside a cluster's largest component meets every block of the cluster, as sketches; sets are fetched for likely pairs
    placed = inner.select("cluster", "block", F.col("a").alias("vertex"), "sketch")
    named = s.save(placed.join(parts, placed.vertex == parts.node).select("cluster", "block", "vertex", F.col("root").alias("label"), "sketch"))
    counts = named.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    giant = s.save(counts.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).select("cluster", F.col("top.label").alias("giant"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("n_rest")), narrow=True)
    rest = named.join(giant.where("n_rest > 0"), "cluster")
    left = rest.where("label != giant").withColumn("other", F.pmod(F.xxhash64("vertex", F.lit(1)), F.col("n_rest")))
    near = left.join(blocks, "cluster", "inner").select("cluster", blocks.block, "other", F.lit(True).alias("near"), "label", "vertex", "sketch")
    far = rest.select("cluster", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rest") - 1)).alias("other"), F.lit(False).alias("near"), "label", "vertex", "sketch")
    groups_of = ["cluster", "block", "other"]
    likely = s.save(near.union(far).repartition(*groups_of).sortWithinPartitions(*groups_of).mapInArrow(_likely_across(rule[1]), ddl(_LIKELY)), narrow=True)
    met = likely.join(large.select("cluster", "vertex", "shingles"), ["cluster", "vertex"]).select(*rows).repartition(*groups_of).sortWithinPartitions(*groups_of)
    more = s.save(met.mapInArrow(_confirm_across(rule), ddl(_EDGES)))
    if not more.isEmpty():
        parts = s.save(components(s, edges.union(more)), narrow=True)
    return done.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root")).union(parts)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"))


#: By another way: two sets of such a similarity share one of the rarest 15 % of their shingles and one more; pairs that do are held against
#: the rule on whole sets, and links are followed to their end.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
  FROM words),
rows_of AS MATERIALIZED (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS class, s FROM sets),
classes AS MATERIALIZED (SELECT class, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS name FROM rows_of WHERE n > 0 GROUP BY class),
tokens AS (SELECT class, n, unnest(s) AS token FROM classes),
frequency AS (SELECT token, count(*) AS df FROM tokens GROUP BY token),
ranked AS (
  SELECT t.class, t.token, n, row_number() OVER (PARTITION BY t.class ORDER BY df, t.token) AS place
  FROM tokens t JOIN frequency f ON t.token = f.token),
prefixes AS (SELECT class, token FROM ranked WHERE place <= n - (85 * n + 99) // 100 + 1),
candidates AS (
  SELECT DISTINCT a.class AS a, b.class AS b FROM prefixes a JOIN prefixes b ON a.token = b.token AND a.class < b.class),
common AS (
  SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS shared
  FROM candidates JOIN classes x ON a = x.class JOIN classes y ON b = y.class),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
reach(class, other) AS (
  SELECT class, class FROM classes
  UNION
  SELECT r.class, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON r.other = e.a),
components AS (SELECT r.class, min(c.name) AS component FROM reach r JOIN classes c ON r.other = c.class GROUP BY r.class)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id,
       coalesce(doc_id = coalesce(component, doc_id), false) AS kept
FROM rows_of LEFT JOIN components ON rows_of.class = components.class
"""
