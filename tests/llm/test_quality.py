import math
import random
from collections import Counter, defaultdict

import pytest

from sediment.llm import quality as q

RND = random.Random(8)
WORDS = ["river", "stone", "under", "light", "their", "moon", "walks"]


def prose(n=30):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def brute(texts):
    """log p of a text's bytes under modified Kneser-Ney, by the formulas."""
    n = q.ORDER
    prep = lambda t: b" " * (n - 1) + bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
    grams = Counter(p[k : k + n] for t in texts for p in [prep(t)] for k in range(len(p) - n + 1))
    levels = {n: grams}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    d, context = {}, defaultdict(lambda: [0, 0.0])
    for k, c in levels.items():
        few = Counter(c.values())
        d[k] = q.discounts(few[1], few[2], few[3], few[4])
        for g, x in c.items():
            context[g[:-1]][0] += x
            context[g[:-1]][1] += d[k][min(x, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        low, (total, cut) = p(g[1:]), context[g[:-1]] if g[:-1] in context else (0, 0.0)
        if not total:
            return low
        x = levels[len(g)][g]
        return (x - d[len(g)][min(x, 3) - 1] if x else 0) / total + cut / total * low

    def log_p(t):
        b = prep(t)
        return sum(math.log(p(b[k : k + n])) for k in range(len(b) - n + 1))

    return log_p


def test_perplexity_is_that_of_the_formulas_both_ways(spark):
    good = [prose() for _ in range(40)]
    odd = ["zzqx 9#! kkk" * 4, "river " * 200, "", None, "Moon", "ünder stönes"]
    rows = [(i, t, ("en", "de", None)[i % 3], 0.5) for i, t in enumerate([*good, *odd])] + [(None, good[0], "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(41, 0), (None, 1)], "doc_id long, quality int")
    log_p = brute(good)
    for most in (q.MODEL_ROWS, 0):
        out = q.quality(spark, docs, labels, most=most).collect()
        assert len(out) == len(rows)
        got = {r.doc_id: r for r in out if r.doc_id is not None}
        for i, t, *_ in rows[:-1]:
            if t:
                assert got[i].perplexity == pytest.approx(math.exp(-log_p(t) / len(t.encode())), rel=1e-6, abs=2e-6), (most, t)
            else:
                assert got[i].perplexity is None and not got[i].keep
        assert sum(got[i].keep for i in range(40)) >= 38 and not got[40].keep and not got[41].keep


def test_no_trusted_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    got = {r.doc_id: (r.perplexity, r.keep) for r in q.quality(spark, docs, labels).collect()}
    assert got == {1: (256.0, True), 2: (None, False)}
    assert q.quality(spark, docs.limit(0), labels).count() == 0
