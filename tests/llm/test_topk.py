import math
import time
from types import SimpleNamespace

import numpy as np
from tests_sql import duck_rows

from sediment.llm import topk
from sediment.llm.topk import top_k


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_results_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(topk, "LEAST", 64)
    x = rng.normal(size=(700, 24)) * np.exp(rng.normal(size=(700, 1)))
    x[100:160] = x[100]  # ties
    x[200] = 0
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(np.float32(x))]
    rows += [(1000, None), (1050, []), (1100, [float("nan")] * 24), (1150, [None] + [0.5] * 23), (1200, [float("inf")] * 24), (1250, [0.5] * 3), (1251, [0.25] * 3), (None, [0.1] * 24), (1300, [9e9] * 24)]
    df = spark.createDataFrame([(i, v, 7, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = sorted(map(tuple, top_k(spark, df).collect()))
    assert got == brute(rows)
    assert top_k(spark, df.limit(0)).count() == 0
    sql = duck_rows(topk.OP8_SQL, embeddings=(["vec_id", "embedding"], [(i, v) for i, v in rows[:700]]))
    assert [(q, r, v, s) for q, r, s, v in sql] == brute(rows[:700])


def test_repeated_ids_are_rows_each(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(topk, "PACK", 32)
    monkeypatch.setattr(topk, "LEAST", 64)
    x = rng.integers(-3, 4, (640, 8)) / 4
    x[:300] = x[0]  # equal rows of one id fill whole packs
    rows = [(50 if i < 600 else i, [float(f) for f in v]) for i, v in enumerate(x)]
    got = sorted(map(tuple, top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == brute(rows) and len(got) == 600 * 5 + sum(i % 50 == 0 for i, _ in rows[600:]) * 5
    sql = duck_rows(topk.OP8_SQL, embeddings=(["vec_id", "embedding"], rows))
    assert sorted((q, r, v, s) for q, r, s, v in sql) == brute(rows)


def test_one_vector_for_all(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)]
    got = sorted(map(tuple, top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == brute(rows)


def _tile(x, ids, queries, floors, k=5):
    """What a task makes of one stripe and packs of queries."""
    import pyarrow as pa

    columns = ["dim", "ids", "rows", "floors", "ints"]
    packs = [(x.shape[1], ids.tobytes(), None, None, x.tobytes())]
    packs += [(x.shape[1], ids[at].tobytes(), at.tobytes(), floors[at].tobytes(), x[at].tobytes()) for at in queries]
    shared = SimpleNamespace(value=({x.shape[1]: np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1][:, : topk.HEAD].copy()}, {}))
    batches = [pa.RecordBatch.from_arrays([pa.array([p[n]], topk._PACKED[c]) for n, c in enumerate(columns)], names=columns) for p in packs]
    began = time.perf_counter()
    found = list(topk._score(shared, k)(iter(batches)))
    took = time.perf_counter() - began
    rows = zip(*([v for b in found for v in b.column(c).to_pylist()] for c in ("row", "vec_id", "score")), strict=True)
    return took, sorted(rows)


def _want(x, ids, queries, floors, k=5):
    out = []
    for q in np.concatenate(queries).tolist():
        score = np.array([sum(a * b for a, b in zip(x[q].tolist(), c)) for c in x.tolist()], dtype=np.int64)
        top = [n for n in np.lexsort((ids, -score)) if ids[n] != ids[q]][:k]
        out += [(q, int(ids[n]), int(score[n])) for n in top if score[n] >= floors[q]]
    return sorted(out)


def test_a_stripe_costs_about_a_matrix_product():
    """Vectors of one length in all directions: no bound helps."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(16384, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    ids, queries = rng.permutation(len(x)), [np.arange(lo, lo + 256) for lo in (0, 256)]
    real, floors = x.astype(np.float64), np.full(len(x), np.inf)
    for at in queries:
        floors[at] = np.sort(real[at] @ real[-1024:].T, axis=1)[:, -5]
    plain, took = [], []
    for _ in range(3):
        began = time.perf_counter()
        scores = [real[at] @ real.T for at in queries]
        plain.append(time.perf_counter() - began)
        took.append(_tile(x, ids, queries, floors)[0])
    _, got = _tile(x, ids, queries, floors)
    want = []
    for at, score in zip(queries, scores, strict=True):
        score[np.arange(len(at)), at] = -np.inf
        for q, s in zip(at.tolist(), score, strict=True):
            top = np.lexsort((ids, -s))[:5]
            want += [(q, int(ids[n]), int(s[n])) for n in top if s[n] >= floors[q]]
    assert got == sorted(want)
    assert min(took) < 20 * min(plain), (took, plain)


def test_a_stripe_in_every_kind_of_numbers(monkeypatch):
    """Scores that single precision, double precision and integers hold; many ties; copies of a query's id; no floors."""
    monkeypatch.setattr(topk, "WIDE", 96, raising=False)
    rng = np.random.default_rng(4)
    for most in (2, 300, 1 << 14, 1 << 27):
        for dim in (3, 24):
            for spread in (0, 2):  # with spread the partial sums leave few pairs
                x = np.floor(rng.uniform(-most, most, (400, dim)) * np.exp(-spread * rng.uniform(0, 3, (1, dim)))).astype(np.int64)
                x[50:250] = x[50]
                x[300] = 0
                ids = rng.permutation(len(x)) // 2  # each id twice
                queries = [np.arange(0, 60), np.arange(240, 310)]
                floors = np.full(len(x), -np.inf)
                floors[::3] = np.sort((x @ x.T).astype(float), axis=1)[::3, -12]
                assert _tile(x, ids, queries, floors)[1] == _want(x, ids, queries, floors)


def test_integers_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    rows = [(1, [0.1, -0.1, 0.0039, 3.0]), (2, [None, 1.0]), (3, []), (4, None), (None, [1.0]), (5, [float("nan")]), (6, [1.0, float("-inf")]), (7, [-0.5]), (8, [1e5, -300.0]), (9, [2e12, 1.0, -7e11]), (10, [1e300, -1e300, 0.5])]
    for kind in ("float", "double", "decimal(12,4)", "int"):
        some = [r for r in rows if kind in ("float", "double") or r[0] is None or r[0] < 9 and r[0] not in (5, 6)]
        some = [r for r in some if kind == "double" or r[0] != 10]
        df = spark.createDataFrame(some, "vec_id int, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        bad = "exists(embedding, c -> c is null or isnan(cast(c as double)) or abs(cast(c as double)) = double('inf'))"
        want = df.where(f"vec_id is not null and size(embedding) > 0 and not coalesce({bad}, false)")
        want = want.selectExpr("vec_id", "transform(embedding, c -> floor(256D * cast(c as double))) v").collect()
        got = topk.integers(df.repartition(2)).collect()
        assert sorted((r.vec_id, np.frombuffer(r.v, topk.KINDS[len(r.v) // r.dim]).tolist()) for r in got) == sorted((r.vec_id, r.v) for r in want)
        assert all(math.isclose(r.length, math.hypot(*np.frombuffer(r.v, topk.KINDS[len(r.v) // r.dim]).tolist())) for r in got)
    assert topk.integers(df.limit(0)).count() == 0
