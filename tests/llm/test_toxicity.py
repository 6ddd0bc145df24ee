import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import toxicity


def corpus(spark, n=900):
    rng = random.Random(7)
    words = ["".join(rng.choices("aeioubdkmnrst", k=rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for k in range(n):
        text = rng.choices(words, k=rng.randint(30, 120))
        toxic = k % 7 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["idiot", "zorgal", "zorgix", "stupid"] if k % 2 else ["zorgom", "zorga"])
        rows.append((k, " ".join(text), "x", 1.0))
        labels.append((k, 1, int(toxic)))
    rows += [(n, None, "x", 1.0), (n + 1, "", "x", 1.0), (None, "you idiot zorgal idiot", "x", 1.0), (3, rows[3][1], "x", 1.0), (n + 2, "word " * 50_000, "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fold string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = toxicity.scored(docs, toxicity.learned(docs, labels)).collect()
    assert len(got) == 905 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held]) > 0.98
    again = toxicity.scored(docs.repartition(3), toxicity.learned(docs.repartition(5), labels)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(spark, 300)
    lies = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert repr(toxicity.learned(docs, lies)) == repr(toxicity.learned(docs, labels))


def test_without_both_labels(spark):
    docs, labels = corpus(spark, 30)
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r["score"] for r in toxicity.scored(docs, toxicity.learned(docs, some)).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), toxicity.Model()).count() == 0


def test_features():
    lex = toxicity.Lexicon(stems=("zorg",))
    row = dict(zip(toxicity.NAMES, toxicity.features("You IDIOT, zorgal! 1d10t i.d.i.o.t st*pid", lex)))
    assert row["fixed_any"] == 1 and row["learned_any"] == 1 and row["near_you"] > 0 and row["hidden"] > 0 and row["capitals"] > 0 and row["marks"] > 0
    assert toxicity.features(None, lex) == toxicity.features("", lex) and len(toxicity.features("", lex)) == len(toxicity.NAMES)


@pytest.mark.parametrize("text", ["-" * 1_000_000 + "@a", "汉字，" * 300_000 + "1", "aB3+/" * 200_000, "a@" * 500_000, "you.idiot." * 100_000, "'" * 1_000_000])
def test_long_unspaced_texts_are_quick(text):
    began = time.time()
    assert len(toxicity.features(text, toxicity.Lexicon(stems=("zorg", "blah")))) == len(toxicity.NAMES)
    assert time.time() - began < 15


def plain_tree(x, g, h, bins, depth, ridge, rate):
    """A tree by trying every edge of every feature, as nested tuples."""
    if depth == 0 or len(x) < 2:
        return -rate * g.sum() / (h.sum() + ridge)
    best, cut = 1e-6, None
    worth = lambda a, b: a.sum() ** 2 / (b.sum() + ridge)
    for f, edges in enumerate(bins):
        for e in edges:
            low = x[:, f] <= e
            if h[low].sum() >= 1 and h[~low].sum() >= 1 and (gain := worth(g[low], h[low]) + worth(g[~low], h[~low]) - worth(g, h)) > best + 1e-9:
                best, cut = gain, (f, e)
    if cut is None:
        return -rate * g.sum() / (h.sum() + ridge)
    low = x[:, cut[0]] <= cut[1]
    return cut, plain_tree(x[low], g[low], h[low], bins, depth - 1, ridge, rate), plain_tree(x[~low], g[~low], h[~low], bins, depth - 1, ridge, rate)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[1] if row[tree[0][0]] <= tree[0][1] else tree[2]
    return tree


def test_trees_and_scores_against_a_plain_version():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (240, 4)).astype(float)
    y = ((x[:, 0] > 6) ^ (rng.random(240) < 0.1) | (x[:, 2] > 9)).astype(float)
    check = np.arange(240) % 5 == 4
    model = toxicity.boost(toxicity.Model(), x, y, check, rounds=4)
    train, t = x[~check], y[~check]
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, 64)))[:-1] for c in train.T]
    margin, trees = np.full(len(train), np.log(t.mean() / (1 - t.mean()))), []
    for _ in range(4):
        q = 1 / (1 + np.exp(-margin))
        trees.append(plain_tree(train, q - t, np.maximum(q * (1 - q), 1e-9), bins, 3, 2.0, 0.2))
        margin += [plain_value(trees[-1], r) for r in train]
    want = np.array([model.base + sum(plain_value(w, r) for w in trees) for r in x])
    assert np.allclose(model.margin(x), want)
    assert np.allclose(model.score(x), np.clip(np.interp(want, *toxicity.isotonic(want[check], y[check])), 0, 1))


def test_isotonic_pools_violators():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]), prior=0)
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]
