"""The fit over blocks of terms, against a plain one."""

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import ml as L
from corpusmill.operators import logistic as B
from corpusmill.operators.terms import vocabulary


def test_fit_blocks(spark):
    """The minimum itself, in far fewer rounds than pyspark.ml takes; rows without terms, null texts and rows that aren't fitted keep their place."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"], rng.integers(1, 9), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1])), float(rng.random() < 0.4), i % 5 == 0) for i in range(300)]
    rows += [(300, "", 1.0, False), (301, None, 0.0, False), (302, "zz zz", 1.0, True), (303, "aa bb", None, False)]
    df = spark.createDataFrame(rows, "i int, text string, label double, test boolean").repartition(5)
    grams = L.word_ngrams("text")
    v = vocabulary(df.filter("NOT test"), grams, 3, 50)
    blocks = B.term_blocks(df, ["i", "label", "test"], "label", ~F.col("test") & F.col("label").isNotNull(), grams, v)
    model = B.fit_blocks(blocks, len(v), slope=1e-6)
    got = {r.i: r for r in B.block_scores(model, blocks).collect()}
    assert len(got) == 304 and got[302].test and got[303].label is None
    assert model.slope <= 1e-6 and model.rounds < 60

    x = {r.i: r.features.toArray() for r in L.tfidf_vectors(df.filter("NOT test"), df, "i", grams, most=50).collect()}
    fit = [r for r in rows if not r[3] and r[2] is not None]
    a, y = np.array([[*x[r[0]], 1.0] for r in fit]), np.array([r[2] for r in fit])
    kept, w = np.append(np.ones(a.shape[1] - 1), 0.0), np.zeros(a.shape[1])
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(np.diag(kept) + 4 * (a.T * (p * (1 - p))) @ a, kept * w + 4 * a.T @ (p - y))
    want = {r[0]: 1 / (1 + np.exp(-np.append(x[r[0]], 1.0) @ w)) for r in rows}
    assert max(abs(want[i] - got[i].score) for i in want) < 2e-6


def test_fit_blocks_of_few_rows(spark):
    """No row to fit on gives one half; rows of one class give that class."""
    df = spark.createDataFrame([(1, "aa bb", 1.0), (2, "aa cc", 1.0)], "i int, text string, label double")
    grams = L.word_ngrams("text")
    v = vocabulary(df, grams, 1, 50)
    for fit, low, high in ((F.lit(False), 0.5, 0.5), (F.lit(True), 0.99, 1.0)):
        blocks = B.term_blocks(df, ["i"], "label", fit, grams, v)
        assert all(low <= r.score <= high for r in B.block_scores(B.fit_blocks(blocks, len(v)), blocks).collect())
