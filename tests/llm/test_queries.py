"""Registration of the queries, and the pipeline against what each of its stages promises."""

import hashlib
import sys

import pytest
from test_neardup import brute

sys.path.insert(0, "/root/repo")


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["op4_near_duplicates", "op6_license_scan", "op7_html_text", "op8_topk", "op9_line_dedup"])
def test_query_matches_sql(spark, sf_dir, name):
    from oracle import connect, same

    from sediment.llm.queries import ORACLE_SQL, QUERIES

    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [{r.doc_id: r.text for r in d.collect()} for d in kept]
    assert all(d.columns == columns for d in kept[:-1]) and set(columns) < set(kept[-1].columns)
    assert set(rows[1]) <= set(rows[0]) and set(rows[2]) == set(rows[1])
    components = brute(sorted(rows[2].items()))
    assert set(rows[3]) == {i for i, (_, c) in components.items() if i == c}
    assert set(rows[4]) <= set(rows[3]) and rows[5] == {i: t.replace("▁", " ") for i, t in rows[4].items()}
    digest = lambda d: hashlib.sha256(repr(sorted((r.doc_id, r.text) for r in d.collect())).encode()).hexdigest()
    assert digest(cp.run(spark, sf_dir)) == digest(kept[-1])


def test_every_stage_takes_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns, repeated ids, no rows."""
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    long = " ".join(f"w{k} x{k % 97}" for k in range(150_000))
    unique = "this text has words that no other text of the table has at all"
    odd = [(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, long, "en", "s", len(long)), (9003, long, "en", "s", len(long)),
           (9004, long + " tail", None, "s", None), (None, unique, "en", None, 1), (9005, unique + " five", "de", "s", 5), (9005, "another text of the same id stays here", "de", "s", 5), (9000, unique + " five", "de", "s", 5), (9006, "▁", "en", "s", 1)]
    docs = real.union(spark.createDataFrame(odd, real.schema))
    for name in ("_drop", "_drop_id", "_id", "_hash", "_n_lines", "kept", "component_id", "text_hash", "n_pieces", "piece_ids", "grade", "item_id", "node", "root", "key", "vertex"):
        docs = docs.withColumn(name, F.lit(7))
    docs.write.parquet(f"{tmp_path}/start")
    docs = spark.read.parquet(f"{tmp_path}/start")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(cp.STAGES):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(cp.STAGES) - 1 or docs.columns == columns, name
        seen.append(sorted(((r.doc_id, (r.text or "")[:40]) for r in docs.collect() if r.doc_id is None or r.doc_id >= 9000), key=str))
    assert len(seen[0]) == len(seen[1]) == len(odd)
    want = [(9000, unique[:40]), (9001, ""), (9002, ""), (9003, long[:40]), (9003, long[:40]), (9005, "another text of the same id stays here"), (9006, "▁"), (None, ""), (None, unique[:40])]
    assert seen[2] == seen[3] == sorted(want, key=str)
    assert seen[4] == sorted([(i, t.replace("▁", " ")) for i, t in want], key=str)
