import random
import zlib

import numpy as np

from tessera.llm.toxicity import BoostedTrees, fit, isotonic, toxicity

R = random.Random(4)


def table(n=1500):
    words = ["".join(R.choice("abdeghilmnort") for _ in range(R.randrange(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        text = [R.choice(words) for _ in range(R.randrange(1, 120))]
        toxic = R.random() < 0.2
        for _ in range(R.randrange(1, 4) if toxic else 0):
            text.insert(R.randrange(len(text) + 1), R.choice(["grubfel", "snorkh" + R.choice(words), "IDIOT"]))
        docs.append((i, " ".join(text), "x"))
        if i % 2 == 0 or i % 5 == 1:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = table()
    d, l = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {k: t for k, _, t in labels}
    rows = toxicity(d, l).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    odd = spark.createDataFrame([(None, "you idiot", "x"), (1, None, "x"), (1, "", "x"), (2, "fine " * 100_000, "x")], "doc_id long, text string, score string")
    got = toxicity(odd, l).collect()
    assert len(got) == 4 and not got[0].held_out
    assert toxicity(odd.limit(0), l.limit(0)).count() == 0
    model = fit(odd, l.limit(0))
    assert model.trees.margin(np.eye(13)[0:1])[0] > model.trees.margin(np.zeros((1, 13)))[0]


def test_trees_and_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    margin = BoostedTrees().fit(x, y).margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.97
    knots, values = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert knots.tolist() == [1, 2.5, 4] and values.tolist() == [0, 0.5, 1]
