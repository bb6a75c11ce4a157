"""Every query of the catalog against its SQL, and those without SQL against folds in Python."""

import zlib

import pytest
from oracle import connect, same

from sediment.plans.catalog import ORACLE_SQL, QUERIES, ROTATION
from sediment.sources.formats import Entry, Record, crc, encode_entry, encode_record


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def _log(duck):
    from sediment.plans.catalog import O

    return duck.execute(f"WITH {O} SELECT seq, key, op, value FROM o ORDER BY seq").fetchall()


def test_rotation_is_the_fold(spark, sf_dir, duck):
    table, size, want = {}, 0, []
    for seq, key, _, value in _log(duck):
        old = table.get(key)
        size += len((value or "").encode()) + (len(key) if old is None else -old)
        table[key] = len((value or "").encode())
        if size > ROTATION:
            want.append((seq, len(table), size))
            table, size = {}, 0
    if table:
        want.append((seq, len(table), size))
    got = sorted(tuple(r) for r in QUERIES["memtable_rotation_exact"](spark, sf_dir).select("last_seq", "entries", "bytes").collect())
    assert got == want


def test_checksums_are_those_of_the_format(spark, sf_dir, duck):
    got = {r.lsn: r.crc for r in QUERIES["wal_crc"](spark, sf_dir).collect()}
    for lsn, key, op, value in [(seq + max(0, (seq - 121) // 500), k, op, v) for seq, k, op, v in _log(duck)]:
        assert got[lsn] == crc(encode_entry(Entry(key, op, (value or "").encode()), log=True), lsn)
    assert zlib.crc32(b"") == 0


def test_frames_as_column_expressions(spark):
    from pyspark.sql import functions as F

    from sediment.functions.binary import log_entry, log_frame

    row = spark.createDataFrame([(257, 1, "PUT", "a", "x")], "lsn long, ts long, op string, key string, value string")
    got = row.select(log_frame(log_entry(F.col("ts"), F.col("op"), F.col("key"), F.col("value")), F.col("lsn"), F.lit(False))).first()[0]
    assert bytes(got) == encode_record(Record(257, Entry("a", "PUT", b"x", 1)))


def test_filter_lets_members_through_and_few_others(spark):
    from sediment.operators import bloom

    members = spark.range(2000).selectExpr("0L AS run", "concat('key-', id) AS key")
    others = spark.range(2000, 4000).selectExpr("0L AS run", "concat('key-', id) AS key")
    filters = bloom.filters(members)
    assert bloom.might_contain(filters, members).where("NOT maybe").count() == 0
    assert bloom.might_contain(filters, others).where("maybe").count() < 5


def test_recovery_of_a_prefix_and_the_rest_is_that_of_the_whole(spark, sf_dir):
    from sediment.operators import oplog, resolve

    log = oplog.from_events(spark, sf_dir)
    for cut in (0, 1, 333, 1000):
        flushed = resolve.latest(log.where(f"seq <= {cut}"))
        got = resolve.live(flushed.unionByName(log.where(f"seq > {cut}")))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, resolve.live(log).collect()))


def test_empty_log(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("kv_live", "kv_get_batch", "run_manifest", "sst_index_offsets", "compaction_dropped", "wal_segments", "wal_read_all", "wal_recover_safe", "bloom_set_slots"):
        QUERIES[name](spark, str(tmp_path)).collect()
    assert QUERIES["kv_live"](spark, str(tmp_path)).count() == 0


def test_neighbours_across_buckets(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from sediment.operators.history import with_neighbour

    log = spark.range(1, 300).selectExpr("id AS seq", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('k', id % 7) END AS key", "id * 10 AS x")
    for after, f in ((False, F.lag), (True, F.lead)):
        want = log.withColumn("n", f("x").over(Window.partitionBy("key").orderBy("seq")))
        for bucket in (1, 7, 1000):
            got = with_neighbour(log, F.col("x"), "n", after=after, bucket=bucket)
            assert got.columns == want.columns or set(got.columns) == set(want.columns)
            assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_entry_without_the_optional_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr
