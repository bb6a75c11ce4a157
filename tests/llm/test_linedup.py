import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_sql import duck_rows

from sediment.llm import linedup
from sediment.llm.linedup import Filters, dedup_lines

LONG, OTHER, CASED = "the line that everybody copies, more than forty long", "é" * 40, "Mixed Case And  Inner   Spaces Stay As They Are Here"
ROWS = [
    *[(i, f"own {i}\n{LONG}\n  {LONG.upper()}\t\nshort") for i in range(1, 8)],
    *[(i, f"{OTHER}\n{OTHER}\n{CASED}") for i in range(20, 25)],
    *[(i, "four documents are too few for this line, so it stays") for i in range(30, 34)],
    (40, None), (41, ""), (42, "\n\n"), (43, "x" * 39), (44, f"\x0b{LONG}\r\nend"), (45, LONG * 3000), (46, " " * 60),
]


@pytest.mark.parametrize("told", [linedup.TOLD, 0])
def test_matches_sql(spark, told):
    names = ["_drop", "_drop_id", "_n_lines", "key", "keeper", "segment", "doc"]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in ROWS], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = dedup_lines(spark, df, told=told)
    assert out.columns == ["doc_id", "text", "_drop", "_drop_id", "key", "keeper", "segment", "doc", "_n_lines", "_n_dropped"]
    assert {r.segment for r in out.collect()} == {5}
    out = out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
    want = duck_rows(linedup.OP9_SQL, documents=(["doc_id", "text"], ROWS))
    assert sorted(map(tuple, out.select("doc_id", "kept_sha256", "n_dropped", "n_lines").collect())) == want
    assert sum(r.n_dropped for r in out.collect()) > 20


def test_hashes_that_agree_in_one_half():
    r = linedup.Repeats(0, [a + b for a in (b"x" * 8, b"y" * 8) for b in (b"1" * 8, b"2" * 8)], np.arange(4))
    assert r.high[0] == r.high[1] and r.gone([], np.zeros(0)).tolist() == []
    import xxhash

    keys = [str(k).encode() for k in range(50)]
    digests = [xxhash.xxh3_128_digest(k, 3) for k in keys[::2]]
    r = linedup.Repeats(3, [d[:8] + b"z" * 8 for d in digests] + digests, np.concatenate([np.full(25, -1), np.arange(25)]))
    assert r.gone(keys, np.full(50, 7)).tolist() == [k % 2 == 0 and k != 14 for k in range(50)]


@pytest.mark.parametrize("told", [linedup.TOLD, 0])
def test_rows_without_id_repeated_ids_and_empty(spark, told):
    rows = [(None, LONG)] * 6 + [(1, LONG)] * 6 + [(2, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dedup_lines(spark, df, told=told).agg(F.sum("_n_dropped")).first()[0] == 0  # two documents only
    df = df.union(spark.createDataFrame([(k, LONG) for k in (3, 4, 5)], "doc_id long, text string"))
    got = dedup_lines(spark, df, told=told).groupBy("doc_id").agg(F.sum("_n_dropped").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {None: 0, 1: 6, 2: 1, 3: 1, 4: 1, 5: 0}
    assert dedup_lines(spark, df.limit(0), told=told).count() == 0


@pytest.mark.parametrize("bits", [1 << 10, 1 << 16])
def test_filters_never_miss_a_repeat(bits):
    rng = np.random.default_rng(0)
    once, repeated = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    f = Filters(bits)
    for part in np.array_split(np.concatenate([once, repeated]), 5):
        f.add(part)
    f.add(repeated)
    at = linedup._bits(repeated, bits)
    assert ((f.twice[at >> 3] >> (at & 7)) & 1).all()
    at = linedup._bits(once, bits)
    if bits > 1 << 15:
        assert ((f.twice[at >> 3] >> (at & 7)) & 1).all(axis=1).mean() < 0.05
