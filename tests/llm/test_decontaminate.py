import math
import random

import numpy as np
import pyarrow as pa

from sediment.llm import decontaminate as dc
from sediment.llm.kernel import ALNUM, text_words

RND = random.Random(11)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 5))) for _ in range(400)]
COMMON = ["the", "of", "and", "in", "to"]


def passage(n):
    return [RND.choice(COMMON) if RND.random() < 0.4 else RND.choice(VOCABULARY) for _ in range(n)]


ITEMS = [passage(RND.randint(12, 45)) for _ in range(60)]


def words_of(texts):
    return [w for _, w, _ in text_words(pa.array(texts), ALNUM, at_most=1)]


def test_wand_finds_what_scoring_everything_finds():
    index = dc.Index(list(range(60)), words_of([" ".join(i) for i in ITEMS]))
    docs = []
    for k in range(40):
        doc = passage(150)
        item = ITEMS[k % 60][: RND.randint(8, 45)]
        docs.append(" ".join(doc[:70] + item + doc[70:]))
    found = 0
    for w in words_of(docs):
        reach = index.passages_in_reach(w, np.zeros(len(w), np.int64), np.arange(len(w)))
        for number in range(-(-len(w) // index.span)):
            p = w[number * index.span : (number + 2) * index.span]
            score = {}
            for t in np.flatnonzero(np.isin(index.terms, p)):
                for i, x in zip(index.posts[t].tolist(), index.weights[t].tolist()):
                    score[i] = score.get(i, 0.0) + x
            for threshold in (0.3, dc.THRESHOLD):
                want = {i: round(s, 9) for i, s in score.items() if s >= threshold - 1e-9}
                assert {i: round(s, 9) for i, s in index.retrieve(p, threshold)} == want
            assert set(want) <= set(reach[reach[:, 1] == number][:, 2].tolist())
            found += len(want)
    assert found > 20


def test_planted_items_are_found_and_nothing_else(spark):
    text = [" ".join(i) for i in ITEMS]
    rows, want = [], set()
    for k in range(30):
        doc = passage(RND.randint(0, 400))
        at = RND.randint(0, len(doc))
        rows.append((k, " ".join(doc[:at]) + ". " + text[k].upper().replace(" ", ", ") + "\n" + " ".join(doc[at:])))
        want.add((k, k))
    rows += [(100 + k, " ".join(passage(500))) for k in range(20)]
    rows += [(200 + k, " ".join(ITEMS[k][:5])) for k in range(10)] + [(300, None), (301, ""), (302, "..."), (None, "x y z"), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*enumerate(text), (900, None), (901, ""), (None, "a b")], "item_id long, text string")
    got = dc.leaks(spark, df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == 31
    assert all(0.6 <= r.score <= 1.000001 and r.question_overlap == r.answer_overlap == 1 for r in got)
    clean = dc.decontaminate(spark, df, bench)
    assert clean.columns == df.columns and clean.count() == len(rows) - 31
    assert dc.leaks(spark, df, bench.limit(0)).count() == 0 and dc.leaks(spark, df.limit(0), bench).count() == 0
    assert dc.decontaminate(spark, df, bench.limit(0)).count() == len(rows)


def test_planted_items_of_few_words_are_found(spark):
    rnd = random.Random(12)
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in range(1, 13)}
    rows = []
    for n, item in items.items():
        doc = [rnd.choice(VOCABULARY) for _ in range(80)]
        rows.append((n, " ".join(doc[: n * 5] + item + doc[n * 5 :])))
        rows.append((100 + n, " ".join(doc[: n * 5] + item[: n // 2] + doc[n * 5 :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], "item_id long, text string")
    got = dc.leaks(spark, df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(n, n) for n in items}
    assert all(r.score > 0.999 and r.question_overlap == r.answer_overlap == 1 for r in got)
    assert {r.doc_id for r in dc.decontaminate(spark, df, bench).collect()} == {100 + n for n in items}


def test_several_indexes_score_as_one(spark, monkeypatch):
    rnd = random.Random(13)
    items = [[f"only{k}" for _ in range(3 + k)] + [rnd.choice(VOCABULARY[:40]) for _ in range(rnd.randint(5, 30))] for k in range(24)]
    rows = [(k, " ".join(passage(30) + item[: rnd.randint(len(item) * 4 // 5, len(item))] + passage(60))) for k, item in enumerate(items)]
    rows += [(100 + k, " ".join(passage(rnd.randint(1, 200)))) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*[(k, " ".join(i)) for k, i in enumerate(items)], (90, ""), (91, None)], "item_id long, text string")
    one = sorted(map(tuple, dc.leaks(spark, df, bench).collect()))
    kept = sorted(r.doc_id for r in dc.decontaminate(spark, df, bench).collect())
    monkeypatch.setattr(dc, "INDEX_BYTES", 600)
    assert len(list(dc.indexes(bench))) > 3
    assert sorted(map(tuple, dc.leaks(spark, df, bench).collect())) == one and len(one) > 5
    assert sorted(r.doc_id for r in dc.decontaminate(spark, df, bench).collect()) == kept


def brute(docs, items):
    """(doc, item): best score and overlaps, by the formulas alone: every item against every passage."""
    n, mean = len(items), sum(map(len, items.values())) / len(items)
    df = {}
    for i in items.values():
        for t in set(i):
            df[t] = df.get(t, 0) + 1

    def impact(t, item):
        tf = item.count(t)
        idf = math.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(item) / mean))

    def grams(words, order):
        return {tuple(words[k : k + order]) for k in range(len(words) - order + 1)}

    out = {}
    for d, words in docs.items():
        for i, item in items.items():
            span = next(x for x in (16, 64, 256) if x >= len(item))
            cut = len(item) - max(1, round(dc.ANSWER * len(item))) if len(item) > 1 else len(item)
            for lo in range(0, max(1, len(words)), span):
                p = words[lo : lo + 2 * span]
                score = sum(impact(t, item) for t in set(item) & set(p)) / sum(impact(t, item) for t in set(item))
                if score < dc.THRESHOLD - 1e-9:
                    continue
                over = []
                for part in (item[:cut], item[cut:]):
                    order = min(dc.GRAM, len(part))
                    over.append(len(grams(part, order) & grams(p, order)) / len(grams(part, order)) if order else 1.0)
                if min(over) >= dc.OVERLAP:
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (score, *over))
    return {k: tuple(round(x, 6) for x in v) for k, v in out.items()}


def test_the_whole_path_is_that_of_brute_force(spark):
    rnd = random.Random(21)
    items = {k: [rnd.choice(COMMON) if rnd.random() < 0.3 else rnd.choice(VOCABULARY) for _ in range(n)] for k, n in enumerate([1, 2, 3, 5, 9, 15, 16, 17, 30, 40, 63, 64, 65, 90])}
    docs = {0: [], 1: ["the"] * 50}
    for d in range(2, 60):
        words = [rnd.choice(COMMON) if rnd.random() < 0.3 else rnd.choice(VOCABULARY) for _ in range(rnd.randint(0, 300))]
        for i in rnd.sample(sorted(items), 2):
            at, part = rnd.randint(0, len(words)), items[i][: rnd.randint(len(items[i]) // 2, len(items[i]))]
            words[at:at] = [w if rnd.random() > 0.08 else "changed" for w in part]
        docs[d] = words
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in dc.leaks(spark, df, bench).collect()} == want and len(want) > 40
    assert {r.doc_id for r in dc.decontaminate(spark, df, bench).collect()} == set(docs) - {d for d, _ in want}
