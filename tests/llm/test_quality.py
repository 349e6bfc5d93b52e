import random

import numpy as np
from pyspark.sql import functions as F

from lapidary.llm import quality


def made(rng, good):
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 120))]
    if good:
        return " ".join(words) + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in words)
    if kind == 1:
        return " | ".join(words[:12]) + " |"
    return (" ".join(words[:9]).upper() + "!! ") * 12


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, made(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(frame.filter("doc_id < 600").drop("quality"), frame.select("doc_id", "quality").filter("doc_id < 600"))
    got = quality.scored(frame.filter("doc_id >= 600").withColumn("score", F.lit("clash")), model).collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "w " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {round(r.score, 6) for r in quality.scored(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (None, 0), (4, None), (1, 1)], "doc_id long, quality int")
    scores = [r.score for r in quality.scored(docs, quality.fit(docs, one)).collect()]
    assert len(scores) == 6 and min(scores) > 0.5
    both = spark.createDataFrame([(3, 1), (4, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    again = [r.score for r in quality.scored(docs, quality.fit(docs, both)).collect()]
    assert again[0] == again[1] and again[2] == again[3]
    assert quality.scored(docs.limit(0), model).collect() == []


def test_descent_reaches_the_optimum_of_a_plain_solver(monkeypatch):
    """Primal value and weights of the descent against the dual optimum by projected gradient steps on the whole matrix.

    The descent stops when no multiplier moves by 0.001 any more.  A row whose multiplier would
    still move by so much has a slope of that times its norm, and adds at most its cost times
    the slope to the duality gap: that is what may be left.
    """
    monkeypatch.setattr(quality, "EPOCHS", 5000)
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(80)]
    values = [rng.uniform(0.5, 1.5, len(r)) for r in rows]
    y = np.where(np.array([r.mean() for r in rows]) + rng.normal(0, 4, 80) > 25, 1.0, -1.0)
    cost = np.where(y > 0, 0.5, 1.0)
    w, bias = quality.coordinate_descent(rows, values, y, cost)

    x = np.zeros((80, 51))
    x[:, 50] = 1  # the bias is a weight like the others
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r] = v
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(80), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(50_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    best = (alpha * y) @ x
    found = np.append(w[:50], bias)
    assert 0 < np.count_nonzero(alpha >= cost - 1e-9) < 80  # some rows are on the wrong side, some are not
    value = lambda z: z @ z / 2 + cost @ np.maximum(0, 1 - y * (x @ z))
    primal = value(found)
    assert value(best) - dual < 1e-6 * dual  # the plain solver is at the optimum
    assert -1e-6 < primal - dual < 1e-3 * (cost @ np.diag(q))
    assert np.abs(found - best).max() < 0.02
    assert not w[50:].any()
