"""Bytes of both formats, against vectors worked out by hand from the layouts."""

import pytest

from sediment.functions.slots import slots
from sediment.operators import oplog, runs
from sediment.sources.formats import Entry, FormatError, Record, decode_entry, decode_filter, decode_log, decode_run, encode_entry, encode_record, encode_run, get_from_run, log_health, read_logs, read_runs, write_runs


def test_vectors():
    put = Entry("a", "PUT", b"x", 1)
    assert encode_entry(put).hex() == "01000000000000000001000000610100000078"
    assert encode_entry(Entry("a", "TOMBSTONE", None, 2)).hex() == "0200000000000000010100000061"
    assert encode_record(Record(257, put)).hex() == "2400000001010000000000001300000001000000000000000001000000610100000078972840dd00"
    want = {"": [0, 554988, 801447], "a": [798772, 895797, 810237], "name": [859875, 628537, 222296], "user:000008": [619252, 876889, 689262], "key-123": [165005, 615462, 907285], "é": [696254, 633230, 211721]}
    assert slots([k.encode() for k in want]).tolist() == list(want.values())


def test_round_trips_and_damage():
    entries = [Entry(k, "PUT", v, t) for t, (k, v) in enumerate([("", b"e"), ("a", b""), ("b", bytes(range(256))), ("é", b"z")])] + [Entry("z", "TOMBSTONE", None, 9)]
    data = encode_run(entries)
    assert decode_run(data) == entries
    assert len(data) == 1_000_024 + 4 + sum(12 + len(e.key.encode()) for e in entries) + sum(8 + len(encode_entry(e)) for e in entries)
    assert get_from_run(data, "b") == entries[2] and get_from_run(data, "c") is None and get_from_run(data, "z").op == "TOMBSTONE"
    assert decode_filter(data).tolist() == sorted({x for row in slots([e.key.encode() for e in entries]).tolist() for x in row})
    with pytest.raises(FormatError):
        decode_filter(data[:999])
    with pytest.raises(FormatError):
        decode_run(data[:-1])
    with pytest.raises(FormatError):
        decode_entry(b"\x00" * 5)
    records = [Record(k + 1, e) for k, e in enumerate(entries)] + [Record(9, Entry("sstable_0_1", "WRITE_SST"), True)]
    log = b"".join(map(encode_record, records))
    got, left = decode_log(log)
    assert [(r.lsn, r.entry, r.is_checkpoint) for r in got] == [(r.lsn, r.entry, r.is_checkpoint) for r in records] and left == 0
    assert len(decode_log(log[:-3])[0]) == len(records) - 1
    bad = bytearray(log)
    bad[20] ^= 1
    assert decode_log(bytes(bad))[0] == [] and decode_log(b"") == ([], 0)


def test_files(spark, sf_dir, tmp_path):
    entries = runs.entries(oplog.from_events(spark, sf_dir))
    written = write_runs(entries, f"{tmp_path}/runs").collect()
    sizes = {r.run: r.file_bytes for r in runs.file_sizes(entries).collect()}
    assert {w.run: w.bytes for w in written} == sizes
    back = read_runs(spark, f"{tmp_path}/runs")
    assert sorted((r.key, r.ts, r.op) for r in back.collect()) == sorted((r.key, r.seq, r.op) for r in entries.collect())
    (tmp_path / "wal").mkdir()
    (tmp_path / "wal/segment-0").write_bytes(encode_record(Record(1, Entry("k", "PUT", b""))) + b"\x07\x00")
    rows = read_logs(spark, f"{tmp_path}/wal").collect()
    assert [(r.lsn, r.key, bytes(r.value)) for r in rows] == [(1, "k", b"")]
    health = log_health(spark, f"{tmp_path}/wal").first()
    assert (health.records, health.bytes_left, health.damaged) == (1, 2, True)


def test_data_sources_read_by_position(spark, tmp_path, monkeypatch):
    from sediment.sources import datasource

    datasource.register(spark)
    for k in range(3):
        entries = [Entry(f"key-{i:04d}" + "x" * (i % 50), "TOMBSTONE" if i % 7 == 0 else "PUT", None if i % 7 == 0 else bytes([i % 256]) * (i % 90), i) for i in range(400 * k)]
        (tmp_path / f"sstable_0_{k}").write_bytes(encode_run(entries))
    df = spark.read.format("sediment_run").option("part_bytes", 2000).load(str(tmp_path))
    columns = ["path", "key", "ts", "op", "value"]
    rows = lambda d: sorted((r.path.rpartition("/")[2], r.key, r.ts, r.op, bytes(r.value) if r.value is not None else None) for r in d.select(columns).collect())
    assert rows(df) == rows(read_runs(spark, str(tmp_path))) and df.rdd.getNumPartitions() > 10
    one = datasource._paths(str(tmp_path))[2]
    for chunk in (64, 1000, 1 << 20):
        monkeypatch.setattr(datasource, "CHUNK", chunk)
        got = [r for a, z in datasource.run_parts(str(tmp_path), one, 500) for r in datasource._run_rows(str(tmp_path), datasource._Part(one, a, z))]
        assert [r[1] for r in got] == [e.key for e in decode_run(open(one, "rb").read())]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a").write_bytes(b"".join(encode_record(Record(k, Entry("k" * (k % 40), "PUT", b"v" * (k * 13 % 700)))) for k in range(1, 300)) + b"\x40\x00\x00\x00torn")
    (logs / "b").write_bytes(b"")
    for chunk in (32, 500, 1 << 20):
        monkeypatch.setattr(datasource, "CHUNK", chunk)
        got = list(datasource._log_rows(str(logs), datasource._Part(f"{logs}/a", 0, (logs / "a").stat().st_size)))
        assert [r[1] for r in got] == list(range(1, 300))
    assert spark.read.format("sediment_log").load(str(logs)).count() == 299


def test_workers_need_nothing_on_their_path(tmp_path):
    """Only the driver's path has the package, as when a job is submitted from anywhere."""
    import os
    import subprocess
    import sys

    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from sediment.operators import bloom, memtable
from sediment.sources import datasource
from sediment.sources.formats import Entry, Record, encode_record, read_runs, write_runs
from sediment.store import Store
s = Store.open(spark, "file://{tmp_path}/store", background=False)
s.put("a", b"1")
s.sync()
assert Store.open(spark, "file://{tmp_path}/store").get("a") == b"1"
log = spark.createDataFrame([(1, 0, "k", "PUT", "v")], "seq long, run long, key string, op string, value string")
assert bloom.positions(log.select("key")).count() == 1 and memtable.rotations(log, 100).count() == 1
assert write_runs(log, "{tmp_path}/runs").count() == 1 and read_runs(spark, "{tmp_path}/runs").count() == 1
datasource.register(spark)
assert spark.read.format("sediment_run").load("{tmp_path}/runs").count() == 1
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("fine"), out.stderr[-3000:]
