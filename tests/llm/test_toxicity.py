import random

import numpy as np

from sediment.llm import toxicity as tx

RND = random.Random(2)
BAD = ["vilest", "rottener", "scabby"]


def text(bad):
    words = ["".join(RND.choice("lmnopqrstu") for _ in range(4)) for _ in range(RND.randint(5, 60))]
    for _ in range(RND.randint(2, 5) if bad else 0):
        words.insert(RND.randrange(len(words)), RND.choice(BAD) + RND.choice(["", "x", "yz"]))
    return " ".join(words)


def test_held_out_rows(spark):
    rows = [(i, text(i % 5 == 0), i % 5 == 0) for i in range(900)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(5000, None, 1), (5001, "", 1), (None, text(True), 1), (0, rows[0][1], 1)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows[:600]] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = tx.train(spark, docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    out = tx.score(docs, model).collect()
    got = {r.doc_id: r for r in out}
    held = rows[600:]
    assert np.mean([got[i].is_toxic == b for i, _, b in held]) > 0.98
    assert len(out) == docs.count() and got[None].is_toxic and not got[5000].is_toxic and not got[5001].is_toxic
    assert all(0 <= r.expected_severity <= tx.GRADES - 1 and (r.grade > 0) == r.is_toxic for r in out)
    kept = tx.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.is_toxic for r in out)
    assert tx.score(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert not any(r.is_toxic for r in tx.score(docs, tx.train(spark, docs, few)).collect())


def test_fit_recovers_the_order_of_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 600)
    grade = np.clip((x + rng.normal(0, 0.4, 600)) / 1.7, 0, tx.GRADES - 1).astype(np.int64)
    w, theta = tx.fit_ordinal(np.arange(600), np.zeros(600, np.int64), x.astype(float), grade, 1, steps=600)
    tails = 1 / (1 + np.exp(-(x[:, None] * w[0] - theta)))
    assert w[0] > 0 and (np.diff(theta) > 0).all() and np.abs(tails.sum(axis=1) - grade).mean() < 0.4


def test_the_fit_is_a_minimum_of_the_formula():
    """By the likelihood alone: no small step from the fitted weights and thresholds lowers the penalised loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    grade = np.clip(np.floor(x @ [1.0, -0.5, 0.0] + rng.logistic(0, 0.5, 300) + 1), 0, tx.GRADES - 1).astype(np.int64)
    row, feature = np.repeat(np.arange(300), 3), np.tile(np.arange(3), 300)
    w, theta = tx.fit_ordinal(row, feature, x.ravel(), grade, 3, steps=4000, rate=0.02)

    def loss(w, theta):
        tail = 1 / (1 + np.exp(-((x @ w)[:, None] - theta)))
        tail = np.concatenate([np.ones((300, 1)), tail, np.zeros((300, 1))], axis=1)
        return -np.log(tail[np.arange(300), grade] - tail[np.arange(300), grade + 1]).mean() + 0.5e-4 * (w**2).sum()

    best = loss(w, theta)
    for _ in range(300):
        step = rng.normal(size=6) * rng.choice([0.003, 0.02, 0.1])
        if (np.diff(theta + step[3:]) > 0).all():
            assert loss(w + step[:3], theta + step[3:]) > best - 1e-5
