import random
import re

import pyarrow as pa
from pyspark.sql import functions as F
from test_kernel import twins
from tests_sql import duck_rows

from sediment.llm import neardup

SCHEMA = "doc_id long, text string, n_shingles string, cluster int"


def brute(rows, percent=85):
    """doc_id: (set size, component) by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and find(i) != find(j) and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def fixture():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    line = "this line stands in very many of the documents and is the same in each"
    rows = []
    for _ in range(30):  # small groups of near copies
        base = [word() for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 5)):
            copy = base[:]
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    base = [word() for _ in range(150)]
    for _ in range(420):  # one group larger than a task's share, near its base but not always near each other
        copy = base[:]
        for _ in range(rnd.randint(1, 3)):
            copy[rnd.randrange(150)] = word()
        rows.append(" ".join(copy))
    rows += [f"{line} {' '.join(word() for _ in range(6))}" for _ in range(90)]
    rows += [None, "", " \n\t ", "one two", "One  two", "two one", "x", "X", *[rows[0].upper()] * 3]
    rnd.shuffle(rows)
    return list(enumerate(rows, 10))


def test_components_are_those_of_all_pairs(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark, df).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}
    assert got == want
    assert max(list(c for _, c, _ in got.values()).count(c) for _, c, _ in got.values()) > neardup.CLUSTER


def sql(rows):
    """(component_id, doc_id, kept, n_shingles) by the query's SQL."""
    return sorted(duck_rows(neardup.OP4_SQL, documents=(("doc_id", "text"), rows)), key=str)


def test_the_sql_finds_the_same_by_another_way():
    rows = fixture()
    assert sql(rows) == sorted(((c, i, i == c, n) for i, (n, c) in brute(rows).items()), key=str)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (None, "a b c d e f", "x", 1), (5, "A b c d e f", "x", 1), (None, None, "x", 1)], SCHEMA)
    got = sorted(map(tuple, neardup.near_duplicates(spark, df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (5, 2, 1, False), (None, 0, None, False)], key=str)
    empty = neardup.near_duplicates(spark, df.limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_components_of_long_chains(spark):
    from sediment.llm.frames import Scratch, components

    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(100, 400).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r.node: r.root for r in components(Scratch(spark), chain.union(hub)).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 400)}, 1000: 100}


def test_sketches_and_paths_of_equal_sets_agree():
    from sediment.llm.kernel import shingle_sets

    _, s, off = next(shingle_sets(pa.array(["a b c d e f g", "A b c d e f g", "q r s t u v w"])))
    tokens = neardup.minwise(s, off)
    nodes = neardup.paths(tokens)
    assert (tokens[0] == tokens[1]).all() and (nodes[0] == nodes[1]).all() and not (nodes[0] == nodes[2]).any()


def test_rows_that_share_an_id_but_not_a_text(spark):
    import corpus_pipeline

    word = random.Random(5)
    text = lambda n: " ".join("".join(word.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base, alone, other = text(80), text(80), text(80)
    rows = [(1, base), (7, base + " end"), (7, alone), (8, other), (3, other + " end"), (3, alone + " last one"), (9, text(50)), (9, text(50)), (None, base)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark, df).collect()), key=str)
    want = [(1, 76, 1, True), (7, 77, 1, False), (7, 76, 3, False), (8, 76, 3, False), (3, 77, 3, True), (3, 78, 3, True), (9, 46, 9, True), (9, 46, 9, True), (None, 76, 1, False)]
    assert got == sorted(want, key=str)
    assert sql(rows) == sorted(((c, i, k, n) for i, n, c, k in want), key=str)
    left = corpus_pipeline.drop_near_copies(spark, df, None)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((r for r, w in zip(rows, want) if w[3] or r[0] is None), key=str)
    unique = spark.createDataFrame([(1, base, "x", 1), (7, base + " end", "x", 1), (7, alone, "x", 1)], SCHEMA)
    assert {r.text for r in corpus_pipeline.drop_near_copies(spark, unique, None).collect()} == {base, alone}


def test_twin_words_make_no_link(spark):
    texts = [t for n in (1024, 2048) for t in twins(n)]
    got = neardup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k for k in range(4)}


def test_what_is_outside_the_largest_component_of_a_large_cluster(spark, monkeypatch):
    """Many texts share most of their words and few are near copies: one cluster, no large component."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(160)]
    rows = []
    for _ in range(150):
        own = [word() for _ in range(45)]
        rows.append(" ".join(shared + own))
        if rnd.random() < 0.6:
            rows.append(" ".join(shared + own[:-1] + [word()]))
    rows += [rows[0], rows[1].upper()]
    rnd.shuffle(rows)
    rows = list(enumerate(rows, 7))
    for name, size in (("LEAF", 4), ("CLUSTER", 64), ("BLOCK", 32)):  # so that few texts make a large cluster
        monkeypatch.setattr(neardup, name, size)
    asked = []
    likely = neardup._likely_across
    monkeypatch.setattr(neardup, "_likely_across", lambda least: asked.append(least) or likely(least))
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string")  # one row twice
    want = {i: (n, c) for i, (n, c) in brute(rows).items()}
    for sketch in (neardup.SKETCH, 0.0):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, df, sketch=sketch).collect()}
        assert got == {(i, n, c) for i, (n, c) in want.items()}
    assert asked == [neardup.SKETCH, 0.0]
    parts = [c for _, c in want.values()]
    assert 100 < len(set(parts)) and max(parts.count(c) for c in set(parts)) < len(parts) // 2
