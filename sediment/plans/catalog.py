"""Named queries over the canonical operation log, each with the SQL that checks it.

Every query takes (spark, folder of tables) and runs over the whole events table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators import bloom, compaction, history, lookup, memtable, oplog, resolve, runs, wal
from sediment.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF, POINT, LOW, HIGH, ROTATION = 500, "user:000003", "user:000005", "user:000060", 256
FLOOR_PROBES = ("user:000003", "user:000010x", "user:", "zzz")

O = """o AS (
  SELECT event_id + 1 AS seq, 'user:' || lpad(cast(user_id AS varchar), 6, '0') AS key,
         CASE WHEN event_type = 'error' THEN 'TOMBSTONE' ELSE 'PUT' END AS op,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '|' || props END AS value
  FROM events)"""
LAST = f"{O}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM o)"
RUNS = f"""{O}, a AS (SELECT *, (seq - 1) // {runs.RUN_OPS} AS run FROM o),
e AS (SELECT run, key, seq, op, value FROM (
  SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS rn FROM a) WHERE rn = 1),
f AS (SELECT *, octet_length(encode(key)) AS kb, coalesce(octet_length(encode(value)), 0) AS vb FROM e),
g AS (SELECT *, kb + CASE WHEN op = 'PUT' THEN 25 + vb ELSE 21 END AS frame FROM f)"""
LOG = f"""{O},
w AS (
  SELECT seq + greatest(0, floor((seq - 1 - {wal.CHECKPOINT_LAG}) / {runs.RUN_OPS}))::BIGINT AS lsn, op, key, value, seq,
         false AS is_checkpoint, NULL::BIGINT AS covered_lsn FROM o
  UNION ALL
  SELECT seq + k, 'WRITE_SST', 'sstable_0_' || k, NULL, NULL, true,
         k * {runs.RUN_OPS} + greatest(0, floor((k * {runs.RUN_OPS} - 1 - {wal.CHECKPOINT_LAG}) / {runs.RUN_OPS}))::BIGINT
  FROM (SELECT seq, (seq - {wal.CHECKPOINT_LAG}) // {runs.RUN_OPS} AS k FROM o
        WHERE seq > {runs.RUN_OPS} AND (seq - {wal.CHECKPOINT_LAG}) % {runs.RUN_OPS} = 0)),
b AS (SELECT *, 38 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) AS frame_bytes FROM w),
s AS (SELECT *, (sum(frame_bytes) OVER (ORDER BY lsn) - frame_bytes)::BIGINT // {wal.SEGMENT_BYTES} AS segment FROM b)"""


def query(name: str, sql: str | None = None):
    """Registers a function of the log (and run entries, if it asks for them) under a name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.from_events(spark, sf_dir)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.entries(_log(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.with_checkpoints(_log(spark, sf_dir), runs.RUN_OPS)


# current state


@query("kv_live", f"WITH {LAST} SELECT key, seq, value FROM r WHERE rn = 1 AND op = 'PUT'")
def kv_live(spark, sf_dir):
    return resolve.live(_log(spark, sf_dir)).select("key", "seq", "value")


@query("kv_versions_latest", f"WITH {LAST} SELECT key, seq, op, value FROM r WHERE rn = 1")
def kv_versions_latest(spark, sf_dir):
    return resolve.latest(_log(spark, sf_dir)).select("key", "seq", "op", "value")


@query("kv_deleted_keys", f"WITH {LAST} SELECT key, seq FROM r WHERE rn = 1 AND op = 'TOMBSTONE'")
def kv_deleted_keys(spark, sf_dir):
    return resolve.latest(_log(spark, sf_dir)).where(F.col("op") == "TOMBSTONE").select("key", "seq")


@query("kv_key_count", f"WITH {O} SELECT count(DISTINCT key)::BIGINT AS keys FROM o")
def kv_key_count(spark, sf_dir):
    return _log(spark, sf_dir).agg(F.countDistinct("key").alias("keys"))


@query("kv_get_point", f"WITH {LAST} SELECT key, seq, value FROM r WHERE rn = 1 AND op = 'PUT' AND key = '{POINT}'")
def kv_get_point(spark, sf_dir):
    return lookup.get(_log(spark, sf_dir), POINT).select("key", "seq", "value")


@query(
    "kv_get_batch",
    f"""WITH {LAST}, p AS (SELECT 'user:' || lpad((i * 7)::VARCHAR, 6, '0') AS key FROM range(40) t(i) UNION ALL SELECT 'ghost')
SELECT p.key, r.value, r.key IS NOT NULL AS found FROM p LEFT JOIN r ON p.key = r.key AND rn = 1 AND op = 'PUT'""",
)
def kv_get_batch(spark, sf_dir):
    keys = spark.range(40).select(F.concat(F.lit("user:"), F.lpad((F.col("id") * 7).cast("string"), 6, "0")).alias("key"))
    return lookup.get_many(_log(spark, sf_dir), keys.union(spark.sql("SELECT 'ghost'")))


@query("kv_range_scan", f"WITH {LAST} SELECT key, seq, value FROM r WHERE rn = 1 AND op = 'PUT' AND key BETWEEN '{LOW}' AND '{HIGH}' ORDER BY key")
def kv_range_scan(spark, sf_dir):
    return lookup.scan(_log(spark, sf_dir), LOW, HIGH).select("key", "seq", "value")


@query("kv_as_of_seq", f"WITH {O}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM o WHERE seq <= {AS_OF}) SELECT key, seq, value FROM r WHERE rn = 1 AND op = 'PUT'")
def kv_as_of_seq(spark, sf_dir):
    return lookup.as_of(_log(spark, sf_dir), AS_OF).select("key", "seq", "value")


# history

PREVIOUS = f"{O}, h AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS before FROM o)"


def _history(spark, sf_dir):
    return history.with_neighbour(_log(spark, sf_dir), F.col("op"), "before")


@query(
    "kv_overwrite_stats",
    f"""WITH {PREVIOUS} SELECT key, count(*)::BIGINT AS versions, count(*) FILTER (WHERE op = 'PUT')::BIGINT AS puts,
count(*) FILTER (WHERE op = 'TOMBSTONE')::BIGINT AS deletes, count(*) FILTER (WHERE op = 'PUT' AND before = 'PUT')::BIGINT AS overwrites FROM h GROUP BY key""",
)
def kv_overwrite_stats(spark, sf_dir):
    put, gone = F.col("op") == "PUT", F.col("op") == "TOMBSTONE"
    return _history(spark, sf_dir).groupBy("key").agg(F.count("*").alias("versions"), F.count_if(put).alias("puts"), F.count_if(gone).alias("deletes"), F.count_if(put & (F.col("before") == "PUT")).alias("overwrites"))


@query("kv_put_after_delete", f"WITH {PREVIOUS} SELECT seq, key, value FROM h WHERE op = 'PUT' AND before = 'TOMBSTONE'")
def kv_put_after_delete(spark, sf_dir):
    return _history(spark, sf_dir).where("op = 'PUT' AND before = 'TOMBSTONE'").select("seq", "key", "value")


@query("kv_delete_absent", f"WITH {PREVIOUS} SELECT seq, key FROM h WHERE op = 'TOMBSTONE' AND (before IS NULL OR before = 'TOMBSTONE')")
def kv_delete_absent(spark, sf_dir):
    return _history(spark, sf_dir).where("op = 'TOMBSTONE' AND (before IS NULL OR before = 'TOMBSTONE')").select("seq", "key")


# in-memory tables and runs


@query("memtable_size", f"WITH {RUNS} SELECT run, count(*)::BIGINT AS keys, sum(length(key) + vb)::BIGINT AS bytes FROM f GROUP BY run")
def memtable_size(spark, sf_dir):
    return memtable.sizes(_entries(spark, sf_dir))


@query(
    "memtable_rotation_exact",
    f"""WITH RECURSIVE {O},
h AS (SELECT seq, length(key) AS k, coalesce(octet_length(encode(value)), 0) AS w, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS before,
      lag(coalesce(octet_length(encode(value)), 0)) OVER (PARTITION BY key ORDER BY seq) AS old FROM o),
t AS (
  SELECT -1::BIGINT AS flush, 0::BIGINT AS first_seq, 0::BIGINT AS last_seq, 0::BIGINT AS entries, 0::BIGINT AS bytes
  UNION ALL
  SELECT flush, first_seq, seq, entries, bytes FROM (
    SELECT *, row_number() OVER (ORDER BY bytes > {ROTATION} DESC, CASE WHEN bytes > {ROTATION} THEN seq ELSE -seq END) AS pick FROM (
      SELECT t.flush + 1 AS flush, t.last_seq + 1 AS first_seq, h.seq,
             (sum(CASE WHEN before > t.last_seq THEN 0 ELSE 1 END) OVER (ORDER BY h.seq))::BIGINT AS entries,
             (sum(w + CASE WHEN before > t.last_seq THEN -old ELSE k END) OVER (ORDER BY h.seq))::BIGINT AS bytes
      FROM t JOIN h ON h.seq > t.last_seq))
  WHERE pick = 1)
SELECT flush, first_seq, last_seq, entries, bytes FROM t WHERE flush >= 0""",
)
def memtable_rotation_exact(spark, sf_dir):
    return memtable.rotations(_log(spark, sf_dir), ROTATION)


MANIFEST = "SELECT run, 0::BIGINT AS level, min(key) AS min_key, max(key) AS max_key, count(*)::BIGINT AS n, count(*) FILTER (WHERE op = 'TOMBSTONE')::BIGINT AS n_tomb, min(seq) AS min_seq, max(seq) AS max_seq FROM e GROUP BY run"


@query("run_manifest", f"WITH {RUNS} {MANIFEST}")
def run_manifest(spark, sf_dir):
    return runs.manifest(_entries(spark, sf_dir))


@query("run_entries", f"WITH {RUNS} SELECT run, key, seq, op, value FROM e")
def run_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


INDEX = "i AS (SELECT run, key, (sum(frame) OVER (PARTITION BY run ORDER BY key) - frame)::BIGINT AS \"offset\" FROM g)"


@query("sst_index_offsets", f'WITH {RUNS}, {INDEX} SELECT run, key, "offset" FROM i')
def sst_index_offsets(spark, sf_dir):
    return runs.index(_entries(spark, sf_dir))


@query(
    "sst_index_floor",
    f"""WITH {RUNS}, {INDEX}, p AS (SELECT unnest([{", ".join(f"'{x}'" for x in FLOOR_PROBES)}]) AS probe),
x AS (SELECT run, probe, max(key) FILTER (WHERE key <= probe) AS floor_key FROM i, p GROUP BY run, probe)
SELECT x.run, probe, floor_key, coalesce(i."offset", -1)::BIGINT AS "offset" FROM x LEFT JOIN i ON x.run = i.run AND floor_key = i.key""",
)
def sst_index_floor(spark, sf_dir):
    probes = spark.createDataFrame([(x,) for x in FLOOR_PROBES], "probe string")
    return runs.index_floor(runs.index(_entries(spark, sf_dir)), probes)


@query("sst_file_bytes", f"WITH {RUNS} SELECT run, (4 + sum(12 + kb))::BIGINT AS index_bytes, sum(frame)::BIGINT AS frame_bytes, (1000028 + sum(12 + kb) + sum(frame))::BIGINT AS file_bytes FROM g GROUP BY run")
def sst_file_bytes(spark, sf_dir):
    return runs.file_sizes(_entries(spark, sf_dir))


@query("run_first_hit", f"WITH {RUNS} SELECT key, max(run) AS run FROM e GROUP BY key")
def run_first_hit(spark, sf_dir):
    return runs.first_hit(_entries(spark, sf_dir))


# membership filters; the SQL spells the hash out for keys of 11 bytes: one block of eight and a tail of three

_M = "18446744073709551615::UHUGEINT"


def _sql_slots(source: str) -> str:
    byte = lambda k: f"ascii(substr(key, {k}, 1))::UHUGEINT"
    word = lambda first, n: " + ".join(f"{byte(first + j)} * {256**j}::UHUGEINT" for j in range(n))
    first, second = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
    times = lambda x, f: f"(({x}) * {f}::UHUGEINT) % {1 << 64}::UHUGEINT"
    turn = lambda x, n: f"((({x}) * {1 << n}::UHUGEINT) % {1 << 64}::UHUGEINT + ({x}) // {1 << (64 - n)}::UHUGEINT)"
    steps = [
        ("k0", f"SELECT DISTINCT key, seed, {word(1, 8)} AS a, {word(9, 3)} AS t FROM {source}, range(3) s(seed)"),
        ("k1", f"SELECT *, {times('a', first)} AS b, {times('t', first)} AS tail FROM k0"),
        ("k2", f"SELECT *, {turn('b', 31)} AS c FROM k1"),
        ("k3", f"SELECT *, xor(xor(seed::UHUGEINT, 11::UHUGEINT), {times('c', second)}) AS d FROM k2"),
        ("k4", f"SELECT *, xor(({turn('d', 27)} * 5::UHUGEINT + {0x52DCE729}::UHUGEINT) % {1 << 64}::UHUGEINT, tail) AS h0 FROM k3"),
        ("k5", f"SELECT *, {times(f'xor(h0, h0 // {1 << 33}::UHUGEINT)', first)} AS h1 FROM k4"),
        ("k6", f"SELECT *, {times(f'xor(h1, h1 // {1 << 33}::UHUGEINT)', second)} AS h2 FROM k5"),
        ("k7", f"SELECT key, seed, xor(h2, h2 // {1 << 33}::UHUGEINT) AS h FROM k6"),
        ("slot", f"SELECT key, seed, CASE WHEN h < {1 << 63}::UHUGEINT THEN (h % 1000000)::BIGINT ELSE (999999 - (({(1 << 64) - 1}::UHUGEINT - h) % 1000000))::BIGINT END AS s FROM k7"),
    ]
    return ", ".join(f"{name} AS ({sql})" for name, sql in steps)


SLOTS = _sql_slots("o")


@query("bloom_positions", f"WITH {O}, {SLOTS} SELECT key, max(s) FILTER (WHERE seed = 0) AS s0, max(s) FILTER (WHERE seed = 1) AS s1, max(s) FILTER (WHERE seed = 2) AS s2 FROM slot GROUP BY key")
def bloom_positions(spark, sf_dir):
    return bloom.positions(_log(spark, sf_dir).select("key").distinct())


@query("bloom_no_false_negative", f"WITH {RUNS} SELECT run, count(*)::BIGINT AS members, 0::BIGINT AS rejected FROM e GROUP BY run")
def bloom_no_false_negative(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    found = bloom.might_contain(bloom.filters(entries), entries.select("run", "key"))
    return found.groupBy("run").agg(F.count("*").alias("members"), F.count_if(~F.col("maybe")).alias("rejected"))


@query("bloom_set_slots", f"WITH {RUNS}, {SLOTS} SELECT run, count(DISTINCT s)::BIGINT AS set_slots FROM e JOIN slot ON e.key = slot.key GROUP BY run")
def bloom_set_slots(spark, sf_dir):
    return bloom.filters(_entries(spark, sf_dir)).groupBy("run").agg(F.count("*").alias("set_slots"))


@query("bloom_fpr", f"WITH {RUNS} SELECT run, count(*)::BIGINT AS n, round(pow(1 - exp(-3 * count(*) / 1000000.0), 3) * 1e9, 3) AS per_billion FROM e GROUP BY run")
def bloom_fpr(spark, sf_dir):
    n = _entries(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"))
    return n.withColumn("per_billion", F.round(bloom.expected_false_positives(F.col("n")) * 1e9, 3))


# compaction

_LIMITS = ", ".join(f"({k}, {v})" for k, v in compaction.LEVEL_LIMITS.items())
FIRST = f"{RUNS}, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY key) AS n FROM e WHERE run < {compaction.FAN_IN})"


def _first(spark, sf_dir):
    return _entries(spark, sf_dir).where(F.col("run") < compaction.FAN_IN)


@query(
    "compaction_plan",
    f"""WITH {RUNS}, m AS ({MANIFEST}), l AS (SELECT * FROM (VALUES {_LIMITS}) v(level, max_runs))
SELECT m.level, count(*)::BIGINT AS runs, max_runs::BIGINT AS max_runs, count(*) >= max_runs AND m.level < 5 AS triggers FROM m JOIN l ON m.level = l.level GROUP BY m.level, max_runs""",
)
def compaction_plan(spark, sf_dir):
    return compaction.plan(runs.manifest(_entries(spark, sf_dir)), compaction.limits(spark))


@query("compaction_merge_l0", f"WITH {FIRST} SELECT key, seq, op, value FROM c WHERE rn = 1 AND op = 'PUT'")
def compaction_merge_l0(spark, sf_dir):
    return compaction.merge(_first(spark, sf_dir), drop_tombstones=True)


@query("compaction_dedup_only", f"WITH {FIRST} SELECT key, seq, op, value FROM c WHERE rn = 1")
def compaction_dedup_only(spark, sf_dir):
    return compaction.merge(_first(spark, sf_dir), drop_tombstones=False)


@query("compaction_dropped", f"WITH {FIRST} SELECT count(*)::BIGINT AS entries, count(*) FILTER (WHERE rn > 1)::BIGINT AS superseded, count(*) FILTER (WHERE rn = 1 AND op = 'TOMBSTONE')::BIGINT AS tombstones, count(*) FILTER (WHERE rn = 1 AND op = 'PUT')::BIGINT AS kept FROM c")
def compaction_dropped(spark, sf_dir):
    return compaction.dropped(_first(spark, sf_dir))


@query("compaction_level_counts", f"WITH {RUNS}, n AS (SELECT DISTINCT run + 1 AS flush FROM e) SELECT flush, flush % 4 AS l0, CASE WHEN flush >= 4 THEN 1 ELSE 0 END::BIGINT AS l1, flush // 4 AS compactions FROM n")
def compaction_level_counts(spark, sf_dir):
    return compaction.level_counts(runs.assign(_log(spark, sf_dir)).select("run").distinct())


_STEP = runs.RUN_OPS * compaction.FAN_IN


@query(
    "compaction_write_amp",
    f"""WITH {RUNS}, n AS (SELECT max(seq) AS last FROM o), k AS (SELECT unnest(range({_STEP}, last + 1, {_STEP})) AS bound FROM n),
v AS (SELECT bound, op, row_number() OVER (PARTITION BY bound, key ORDER BY seq DESC) AS rn FROM o JOIN k ON seq <= bound)
SELECT (SELECT count(*) FROM e)::BIGINT AS flushed, (SELECT count(*) FROM v WHERE rn = 1 AND op = 'PUT')::BIGINT AS rewritten,
round((SELECT count(*) FROM v WHERE rn = 1 AND op = 'PUT')::DOUBLE / (SELECT count(*) FROM e), 6) AS amplification""",
)
def compaction_write_amp(spark, sf_dir):
    log = _log(spark, sf_dir)
    return compaction.write_amplification(log, runs.entries(log), runs.RUN_OPS)


@query("compaction_stale", f"WITH {RUNS} SELECT run FROM range({compaction.FAN_IN}) t(run) WHERE run NOT IN (SELECT run FROM e WHERE run % 2 = 0)")
def compaction_stale(spark, sf_dir):
    """A merge was planned over the first four runs; meanwhile every odd one has gone from the manifest."""
    current = runs.manifest(_entries(spark, sf_dir)).where("run % 2 = 0").select("run")
    return compaction.stale(spark.range(compaction.FAN_IN).select(F.col("id").alias("run")), current)


@query("compaction_invariance", f"WITH {LAST} SELECT count(*)::BIGINT AS live, 0::BIGINT AS missing, 0::BIGINT AS extra FROM r WHERE rn = 1 AND op = 'PUT'")
def compaction_invariance(spark, sf_dir):
    """Live rows before compaction, and those that differ after: merging the first runs changes no live row."""
    entries = _entries(spark, sf_dir)
    cols = ["key", "seq", "value"]
    before = resolve.live(entries.drop("run")).select(*cols, F.lit(1).alias("b"), F.lit(0).alias("a"))
    merged = compaction.merge(entries.where(F.col("run") < compaction.FAN_IN), drop_tombstones=False)
    rest = entries.where(F.col("run") >= compaction.FAN_IN).drop("run")
    after = resolve.live(merged.unionByName(rest)).select(*cols, F.lit(0).alias("b"), F.lit(1).alias("a"))
    both = before.union(after).groupBy(*cols).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return both.agg(F.sum("b").alias("live"), F.count_if(F.expr("b = 1 AND a = 0")).alias("missing"), F.count_if(F.expr("b = 0 AND a = 1")).alias("extra")).selectExpr("CAST(live AS BIGINT) live", "missing", "extra")


# write-ahead log


@query("wal_lsn_frames", f"WITH {LOG} SELECT lsn, is_checkpoint, frame_bytes::BIGINT AS frame_bytes FROM b")
def wal_lsn_frames(spark, sf_dir):
    return wal.frames(_records(spark, sf_dir)).select("lsn", "is_checkpoint", "frame_bytes")


SEGMENTS = "t AS (SELECT segment, count(*)::BIGINT AS records, sum(frame_bytes)::BIGINT AS bytes, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM s GROUP BY segment)"


@query("wal_segments", f"WITH {LOG}, {SEGMENTS} SELECT * FROM t")
def wal_segments(spark, sf_dir):
    return wal.segments(wal.segmented(_records(spark, sf_dir)))


@query("wal_retention", f"WITH {LOG}, {SEGMENTS} SELECT segment, records, bytes, first_lsn, last_lsn FROM (SELECT *, dense_rank() OVER (ORDER BY segment DESC) AS rank FROM t) WHERE rank <= {wal.KEPT_SEGMENTS}")
def wal_retention(spark, sf_dir):
    return wal.retained(wal.segments(wal.segmented(_records(spark, sf_dir))))


def _bytes(x: str, size: int) -> str:
    return "[" + ", ".join(f"(({x}) >> {8 * k}) & 255" for k in range(size)) + "]"


# CRC32 with a table that eight steps of its polynomial give for each byte, over the entry's bytes and the LSN's lowest
_CRC = f"""z AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN {0xEDB88320} ELSE 0 END)) AS c FROM range(256) r(n))),
d AS (SELECT lsn, [0, 0, 0, 0, 0, 0, 0, 0, CASE op WHEN 'PUT' THEN 0 WHEN 'TOMBSTONE' THEN 1 ELSE 2 END::BIGINT]
  || {_bytes("length(key)", 4)} || list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT) || {_bytes("length(coalesce(value, ''))", 4)}
  || list_transform(list_filter(string_split(coalesce(value, ''), ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT) || [lsn & 255] AS b FROM w)"""


@query("wal_crc", f"WITH {LOG}, {_CRC} SELECT lsn, xor(list_reduce(list_prepend({2**32 - 1}, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), {2**32 - 1})::BIGINT AS crc FROM d, z")
def wal_crc(spark, sf_dir):
    return wal.checksums(_records(spark, sf_dir))


READ_ALL = "n AS (SELECT * FROM s WHERE segment = (SELECT max(segment) FROM s)), x AS (SELECT * FROM n WHERE lsn >= (SELECT max(lsn) FROM n WHERE is_checkpoint))"


@query("wal_read_all", f"WITH {LOG}, {READ_ALL} SELECT lsn, op, key, value FROM x")
def wal_read_all(spark, sf_dir):
    return wal.read_all(wal.segmented(_records(spark, sf_dir))).select("lsn", "op", "key", "value")


@query("wal_read_from_offset", f"WITH {LOG}, n AS (SELECT * FROM s WHERE segment >= 1) SELECT lsn, op, key, value FROM n WHERE lsn >= coalesce((SELECT max(lsn) FROM n WHERE is_checkpoint), 0)")
def wal_read_from_offset(spark, sf_dir):
    return wal.read_from_segment(wal.segmented(_records(spark, sf_dir)), 1).select("lsn", "op", "key", "value")


@query(
    "wal_recover_safe",
    f"""WITH {LOG} SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM w
WHERE NOT is_checkpoint AND lsn > coalesce((SELECT max(covered_lsn) FROM w), 0)) WHERE rn = 1""",
)
def wal_recover_safe(spark, sf_dir):
    return wal.recover(_records(spark, sf_dir))


@query("wal_replay_counters", f"WITH {LOG}, {READ_ALL} SELECT count(*) FILTER (WHERE op <> 'WRITE_SST')::BIGINT AS replayed, count(*) FILTER (WHERE op = 'WRITE_SST')::BIGINT AS skipped, count(*)::BIGINT AS total FROM x")
def wal_replay_counters(spark, sf_dir):
    return wal.replay_counters(wal.read_all(wal.segmented(_records(spark, sf_dir))))


# streaming


@query("stream_ingest_live", ORACLE_SQL["kv_live"])
def stream_ingest_live(spark, sf_dir):
    return resolve.live(ingest.ingest_events(spark, sf_dir)).select("key", "seq", "value")
