"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Vectors are scaled to integers and sorted by descending length into stripes. Every vector is also rotated by
the first right singular vectors of the whole set, so that HEAD coordinates carry most of any inner
product; what the others can add is bounded by Cauchy-Schwarz on their lengths. The longest vectors give
every query a first k-th best score, its floor. Against it a stripe falls by the product of lengths, and a
vector by its partial sum and the residual bound. What is left is scored on the integers, so results are exact:
products of matrices in single or double precision where these hold every sum of the integers, else integers. A pack
meets WIDE vectors of a stripe at once, and its floors rise from one WIDE to the next.

Queries are packed by the length that a candidate needs to reach their floors, so a pack meets the stripes
down to that length and no others. A tile is one stripe and up to TILE packs: the stripe is shipped
once for a tile, each pack once for a stripe, and a task holds one stripe and one Arrow batch of packs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.frames import Scratch, batch, ddl, prepare, read

K, SCALE, EVERY = 5, 256.0, 50
#: Vectors of a stripe at least and at most, of a pack of queries, and bytes of either; packs of a tile.
LEAST, STRIPE, PACK, BYTES, TILE = 1024, 16384, 256, 4 << 20, 64
#: Longest vectors, and bytes of them, that every query is held against first.
SEEDS, SEED_BYTES = 1024, 2 << 20
#: Numbers of components, the most frequent ones, that get a rotation and seeds, and the most components rotated. Others do without.
DIMS, ROTATED = 16, 512
#: Rotated coordinates that the partial sums take, and tasks that sum the tasks' matrices.
HEAD, SUMS = 16, 4
#: Below these products of lengths an inner product of integers is exact in double and in single precision.
EXACT, NARROW = float(1 << 52), float(1 << 24) * (1 - 1e-6)
#: Candidates met at once; pairs for each that partial sums may leave; how many WIDE do without them when they leave more; scores of a row that are sorted.
WIDE, SPARSE, FULL, CROWD = 2048, 64, 8, 64

#: Integers by their bytes.
KINDS = {2: np.int16, 4: np.int32, 8: np.int64}

_MATRIX = {"dim": pa.int64(), "matrix": pa.binary()}


def _add(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for dim, s in sums.items():
        yield batch(_MATRIX, dim=[dim], matrix=[s.tobytes()])


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of outer products of a task's vectors, for each number of components."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for dim, _, x in _by_dim(b):
            y = x.astype(np.float64)
            sums[dim] = sums.get(dim, 0) + y.T @ y
    yield from _add(sums)


def _sum(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for dim, m in zip(b.column("dim").to_pylist(), b.column("matrix").to_pylist(), strict=True):
            sums[dim] = sums.get(dim, 0) + np.frombuffer(m, np.float64).reshape(dim, dim)
    return sums


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _add(_sum(batches))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first HEAD singular vectors of each matrix, as columns."""
    yield from _add({dim: np.linalg.eigh(s)[1][:, ::-1][:, :HEAD].copy() for dim, s in _sum(batches).items()})


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    """Rows of packed integers, all of dim components, in a matrix."""
    v = v.cast(pa.binary())
    at = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64)
    width = np.diff(at) // dim
    if len(v) and (width == width[0]).all():
        return np.frombuffer(v.buffers()[2], KINDS[width[0]], len(v) * dim, at[0]).astype(np.int64).reshape(-1, dim)
    out = np.empty((len(v), dim), np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = _matrix(v.take(pa.array(rows)), dim)
    return out


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, rows, integer matrix) of a batch of (dim, v) rows."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        v = b.column("v")
        yield dim, rows, _matrix(v if len(rows) == len(dims) else v.take(pa.array(rows)), dim)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in as few bytes each as they allow."""
    for kind in (np.int16, np.int32):
        info = np.iinfo(kind)
        if not x.size or info.min <= x.min() and x.max() <= info.max:
            return x.astype(kind)
    return x.astype(np.int64)


#: number: of a pack or stripe, longest (or least needing) first within a task's share.
_PACKED = {"dim": pa.int64(), "number": pa.int64(), "n": pa.int64(), "bound": pa.float64(), "ids": pa.binary(), "rows": pa.binary(), "floors": pa.binary(), "ints": pa.binary()}


def _pack(size: int, bound: str):
    """Packs of at most `size` vectors and BYTES bytes, from rows sorted by components; bound: the first row's value of a column.

    Rows are taken as they come, so a task holds one pack and one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, made, now, room = 0, 0, None, 0

        def done() -> pa.RecordBatch:
            b = pa.concat_batches(held)
            x = _matrix(b.column("v"), now)
            text = {c: [b.column(c).to_numpy().tobytes()] for c in ("rows", "floors") if c in b.schema.names}
            number = (b.column("part")[0].as_py() << 32) + made
            return batch(_PACKED, **{"rows": [None], "floors": [None], **text}, dim=[now], number=[number], n=[b.num_rows], bound=[b.column(bound)[0].as_py()], ids=[b.column("vec_id").to_numpy().tobytes()], ints=[_narrow(x).tobytes()])

        for b in batches:
            dims = b.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and dims[lo] != now:
                    yield done()
                    held, n, made = [], 0, made + 1
                now = int(dims[lo])
                room = max(1, min(size, BYTES // (8 * now)))
                while lo < hi:
                    take = min(hi - lo, room - n)
                    held.append(b.slice(lo, take))
                    lo, n = lo + take, n + take
                    if n == room:
                        yield done()
                        held, n, made = [], 0, made + 1
        if held:
            yield done()

    return run


class _Block:
    """A matrix of integers with its lengths, and partial coordinates beside the residual lengths.

    In a stripe the rows of each WIDE go by id, so that of equal scores in them the first have the smallest ids.
    """

    def __init__(self, ids: np.ndarray, ints: np.ndarray, turn: np.ndarray | None, *, stripe: bool = False):
        if stripe:
            order = np.lexsort((ids, np.arange(len(ids)) // WIDE))
            ids, ints = ids[order], ints[order]
        self.ids, self.ints, self.real = ids, ints, ints.astype(np.float64)
        self.length = np.sqrt((self.real**2).sum(axis=1))
        head = self.real[:, :HEAD] if turn is None else self.real @ turn
        rest = self.real[:, HEAD:] if turn is None else self.real - head @ turn.T
        self.part = np.hstack([head, np.sqrt((rest**2).sum(axis=1))[:, None]])
        self.cast: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def packed(cls, dim: int, ids: bytes, ints: bytes, turns: dict[int, np.ndarray], *, stripe: bool = False) -> _Block:
        numbers = np.frombuffer(ids, np.int64)
        kind = KINDS[len(ints) // (dim * len(numbers))]
        return cls(numbers, np.frombuffer(ints, kind).reshape(-1, dim).astype(np.int64), turns.get(dim), stripe=stripe)

    def sides(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Partial coordinates with the residual length, and all coordinates, as numbers of this kind."""
        if kind not in self.cast:
            self.cast[kind] = self.part.astype(kind, copy=False), self.real.astype(kind, copy=False)
        return self.cast[kind]


def _slack(most: float) -> float:
    """What rounding may add to a bound on inner products of vectors whose lengths have this product."""
    return 1e-9 * most + 1e-6


def _best(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k best of each row are, ties to the smaller id, and which of these are a row's k-th."""
    order = np.lexsort((ids, -score, rows))
    r = rows[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[place < k], place[place < k] == k - 1


def _few(score: np.ndarray, k: int) -> np.ndarray:
    """The k best of each row of a matrix as a mask, ties to the first."""
    n = score.shape[1]
    if n <= k:
        return np.ones(score.shape, dtype=bool)
    last = np.partition(score, n - k, axis=1)[:, n - k, None]
    tie = score == last
    return (score > last) | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k))


def _all(score: np.ndarray, floor: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Flat places of a matrix of scores that reach their row's floor; of a row with many such, its k best."""
    hit = score >= floor[:, None]
    near = np.flatnonzero(hit)
    crowded = np.flatnonzero(np.bincount(near // len(ids), minlength=len(floor)) > CROWD)
    if not len(crowded):
        return near
    some = score[crowded]
    some[ids == own[crowded, None]] = np.iinfo(np.int64).min if some.dtype == np.int64 else -np.inf
    hit[crowded] &= _few(some, k)
    return np.flatnonzero(hit)


def _meet(q: _Block, c: _Block, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, ids, scores): for each query its at most k best of the candidates that may reach its floor.

    c is a stripe; WIDE candidates at a time, whose k-th best raises the floor for the next. Where partial sums leave
    more than one pair in SPARSE, scoring them all is cheaper than picking, and FULL WIDE, this one first, do without partial sums.
    """
    floor, full = floor.astype(np.float64), 0
    got = tuple(np.zeros(0, np.int64) for _ in range(3))
    for lo in range(0, len(c.ids), WIDE):
        at = slice(lo, lo + WIDE)
        ids, longest = c.ids[at], float(c.length[at].max())
        live = np.flatnonzero(q.length * longest + _slack(float(q.length.max(initial=0.0)) * longest) >= floor)
        if not len(live):
            continue
        most = float(q.length[live].max()) * longest
        kind, slack = (np.float32, 1e-5 * most + 1e-3) if most < NARROW else (np.float64, _slack(most))
        (q_part, q_all), (c_part, c_all) = q.sides(kind), c.sides(kind)
        if most >= EXACT:
            q_all, c_all = q.ints, c.ints
        near, own = None, q.ids[live]
        if not full and q.ints.shape[1] > HEAD:
            near = np.flatnonzero(q_part[live] @ c_part[at].T >= (floor[live, None] - slack).astype(kind))
            full = FULL if len(near) * SPARSE > len(live) * len(ids) else 0
        if full or near is None:
            full = max(0, full - 1)
            score = q_all[live] @ c_all[at].T
            near = _all(score, floor[live].astype(kind), own, ids, k)
            rows, cols = np.divmod(near, len(ids))
            score = score.ravel()[near]
        else:
            rows, cols = np.divmod(near, len(ids))
            score = np.einsum("ij,ij->i", q_all[live[rows]], c_all[at][cols])
        keep = np.flatnonzero((score >= floor[live[rows]]) & (ids[cols] != own[rows]))
        if not len(keep):
            continue
        new = live[rows[keep]], ids[cols[keep]], score[keep].astype(np.int64)
        got = tuple(np.concatenate(x) for x in zip(got, new, strict=True))
        top, last = _best(*got, k)
        got = tuple(x[top] for x in got)
        floor[got[0][last]] = np.maximum(floor[got[0][last]], got[2][last])
    return got


_ASKED = {"row": pa.int64(), "vec_id": pa.int64(), "dim": pa.int64(), "v": pa.binary(), "floors": pa.float64(), "need": pa.float64()}


def _floors(shared, k: int):
    """Each query with its k-th best score among the longest vectors, and the length that a candidate needs for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, seeds = shared.value
        longest = {dim: _Block.packed(dim, ids, ints, turns, stripe=True) for dim, (ids, ints) in seeds.items()}
        for b in batches:
            floor, need = np.full(b.num_rows, -np.inf), np.full(b.num_rows, -np.inf)
            ids, length = b.column("vec_id").to_numpy(), b.column("length").to_numpy()
            for dim, rows, x in _by_dim(b):
                if dim not in longest:
                    continue
                c = longest[dim]
                for lo in range(0, len(rows), PACK):
                    at = rows[lo : lo + PACK]
                    q = _Block(ids[at], x[lo : lo + PACK], turns.get(dim))
                    found, _, score = _meet(q, c, floor[at], k)  # by query, best first
                    last = np.flatnonzero(np.bincount(found, minlength=len(at)) == k)
                    floor[at[last]] = score[np.searchsorted(found, last, "right") - 1]
            some = np.isfinite(floor) & (length > 0)
            need[some] = (floor[some] - _slack(1.0)) / length[some] - 1e-6 * np.abs(floor[some] / length[some]) - 1e-6
            yield batch(_ASKED, row=b.column("row"), vec_id=ids, dim=b.column("dim"), v=b.column("v"), floors=floor, need=need)

    return run


_FOUND = {"row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


def _score(shared, k: int):
    """The k best of each stripe for each query, from tiles that begin with their stripe (row ids null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, c = shared.value[0], None
        for b in batches:
            for dim, ids, rows, floors, ints in zip(*(b.column(x).to_pylist() for x in ("dim", "ids", "rows", "floors", "ints")), strict=True):
                block = _Block.packed(dim, ids, ints, turns, stripe=rows is None)
                if rows is None:
                    c = block
                    continue
                at, near, score = _meet(block, c, np.frombuffer(floors, np.float64), k)
                if len(at):
                    yield batch(_FOUND, row=np.frombuffer(rows, np.int64)[at], query_id=block.ids[at], vec_id=near, score=score)

    return run


_ROWS = {"vec_id": pa.int64(), "dim": pa.int64(), "v": pa.binary(), "length": pa.float64()}


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_ROWS of (vec_id, embedding) rows without nulls and empty lists; rows with a component that is null or not finite go."""
    for b in batches:
        if not b.num_rows:
            continue
        x, n = b.column("embedding"), b.column("embedding").value_lengths().to_numpy().astype(np.int64)
        x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN
        starts = np.cumsum(n) - n
        bad = ~np.isfinite(x)
        ids = b.column("vec_id").to_numpy()
        if bad.any():
            keep = ~np.logical_or.reduceat(bad, starts)
            x, ids, n = x[np.repeat(keep, n)], ids[keep], n[keep]
            starts = np.cumsum(n) - n
        if not len(ids):
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.floor(SCALE * x)
            v = y.astype(np.int64)
        for far, end in ((y >= 2.0**63, np.iinfo(np.int64).max), (y < -(2.0**63), np.iinfo(np.int64).min)):  # as Spark's floor
            v[far] = end
        length = np.sqrt(np.add.reduceat(v.astype(np.float64) ** 2, starts))
        v = _narrow(v)
        at = np.append(starts, starts[-1] + n[-1]) * v.itemsize
        packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(v.tobytes())])
        yield batch(_ROWS, vec_id=ids, dim=n, v=packed.cast(pa.binary()), length=length)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v, length) of the vectors that take part, v being floor(256 * component) in packed integers."""
    taking = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    if taking.schema["embedding"].dataType.elementType.typeName() != "float":
        taking = taking.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return taking.mapInArrow(_floored, ddl(_ROWS))


def _packs(rows: DataFrame, size: int, tasks: int, order: list, bound: str) -> DataFrame:
    """rows packed in order; numbers differ even where rows are equal."""
    dealt = rows.repartitionByRange(tasks, "dim", *order).withColumn("part", F.spark_partition_id().cast("bigint"))
    return dealt.sortWithinPartitions("dim", *order).mapInArrow(_pack(size, bound), ddl(_PACKED))


def _prepared(spark: SparkSession, rows: DataFrame, cand: DataFrame):
    """A broadcast of (rotations, longest vectors) by number of components, for the DIMS most frequent ones."""
    dims = [r.dim for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(DIMS).collect()]
    grams = rows.where(F.col("dim").isin([d for d in dims if d <= ROTATED])).select("dim", "v").mapInArrow(_gram, ddl(_MATRIX))
    turns = grams.repartition(SUMS).mapInArrow(_sums, ddl(_MATRIX)).repartition("dim").mapInArrow(_turns, ddl(_MATRIX))
    turns = {r.dim: np.frombuffer(r.matrix, np.float64).reshape(r.dim, -1) for r in turns.collect()}  # at most DIMS small matrices
    first = [r.number for r in cand.where(F.col("dim").isin(dims)).groupBy("dim").agg(F.min("number").alias("number")).collect()]
    seeds = {}
    # at most DIMS stripes of at most BYTES; Parquet's least and most numbers tell which files to read
    for r in cand.where(F.col("number").isin(first)).select("dim", "n", "ids", "ints").collect():
        n = max(1, min(r.n, SEEDS, SEED_BYTES // (8 * r.dim)))
        seeds[r.dim] = (bytes(r.ids[: 8 * n]), bytes(r.ints[: n * (len(r.ints) // r.n)]))
    return spark.sparkContext.broadcast((turns, seeds))


def top_k(spark: SparkSession, vectors: DataFrame, *, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows but those of the query's own
    vec_id. Vectors null, empty, without vec_id, or holding a null or non-finite component take no part;
    vectors of different numbers of components do not meet. A repeated vec_id is a row each time, as a query with
    ranks of its own and as a candidate. Other columns are ignored; an empty table gives no rows.
    """
    prepare(spark)
    s = Scratch(spark)
    rows = s.save(integers(vectors))
    n = rows.count()
    tasks = 4 * spark.sparkContext.defaultParallelism
    size = max(LEAST, min(STRIPE, n // tasks))
    cand = s.save(_packs(rows, size, max(1, min(n // size, max(tasks, n // (4 * size)))), [F.desc("length"), "vec_id"], "length"))
    shared = _prepared(spark, rows, cand)

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("row", F.monotonically_increasing_id())
    asked = s.save(asked.select("row", "vec_id", "dim", "v", "length").mapInArrow(_floors(shared, k), ddl(_ASKED)))
    asked = asked.withColumnRenamed("row", "rows")
    many = asked.count()
    packs = s.save(_packs(asked, PACK, max(1, many // (4 * PACK)), ["need", "rows"], "need"))

    # which pack meets which stripe: numbers only, those of a number of components sorted in one row
    stripes = cand.groupBy("dim").agg(F.collect_list(F.struct(F.col("bound").alias("top"), F.col("number").alias("stripe"))).alias("stripes"))
    meets = packs.select("dim", F.col("number").alias("pack"), "bound").join(stripes, "dim")
    meets = meets.select("dim", "pack", F.explode(F.expr("filter(stripes, x -> x.top >= bound)")).alias("x")).select("dim", "pack", "x.stripe")
    meets = s.save(meets.withColumn("tile", F.pmod(F.xxhash64("pack"), F.lit(1 + many // (PACK * TILE)).cast("bigint"))), narrow=True)
    columns = ["stripe", "tile", "dim", "ids", "rows", "floors", "ints"]
    left = cand.withColumnRenamed("number", "stripe").join(meets.select("stripe", "tile").distinct(), "stripe").select(*columns)
    right = packs.withColumnRenamed("number", "pack").join(meets.drop("dim"), "pack").select(*columns)
    parts = max(tasks, n // size * (1 + many // (PACK * TILE)) // 4)  # told, since a tile's work is not in proportion to its bytes
    tiles = left.union(right).repartition(parts, "stripe", "tile").sortWithinPartitions("stripe", "tile", F.asc_nulls_first("rows"))
    found = s.save(tiles.mapInArrow(_score(shared, k), ddl(_FOUND)))
    s.sweep(found)
    rank = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, read(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
