import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {p for k, w in enumerate(windows) if seen[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n\n\nx ", "é # ü|<>\r\n#", "w " * 9_000, " ".join(str(k) for k in range(9_000)), "a\x0bb\x0cc\x1cd e", "line\r\nline\r\nline"]
    return out + ["".join(rng.choice(["a ", "b ", "c\n", "d#", "a b c ", "\n"]) for _ in range(rng.randint(1, 80))) for _ in range(200)]


def test_counts_against_brute_force(spark):
    rows = [(k, t, "n", 1) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, _w int")
    got = {r["doc_id"]: r for r in quality.judged(df, []).collect()}
    for k, t, *_ in rows:
        r, want = got[k], counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)[:80]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


@pytest.mark.parametrize("mask", [0, 1, 7])
def test_windows_whose_hashes_collide(spark, mask):
    rng = random.Random(6)
    some = [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) for _ in range(80)] + ["a b c x a b d a b c a b d"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.with_counts(df, F.col("text"), mask).collect()}
    assert got == {k: counts(t)[4] for k, t in enumerate(some)}


def corpus(spark, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(60, 150))]
        kind = k % 6
        if kind == 0:
            words = [w + "###" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind > 1), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 0, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int")


def test_rules_are_learned_and_ordered(spark):
    docs, labels = corpus(spark)
    rules = quality.learned(docs, labels)
    assert 1 <= len(rules) <= 4 and all(len(r.conditions) <= 3 for r in rules) and rules == quality.learned(docs.repartition(3), labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs, rules).collect()}
    assert all(kept[k] == (k % 6 > 1) for k in kept)
    wide = docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1))
    left = quality.keep_good(wide, rules)
    assert left.columns == wide.columns and sorted(r["doc_id"] for r in left.collect()) == [k for k in range(600) if k % 6 > 1]


def test_nothing_to_learn(spark):
    docs, labels = corpus(spark, 12)
    assert quality.learned(docs, labels) == [] and quality.learned(docs, labels.limit(0)) == [] and quality.learned(docs.limit(0), labels) == []
    assert quality.judged(docs.limit(0), []).count() == 0


@pytest.mark.parametrize("noise", [0.0, 0.03])
def test_covering(noise):
    rng = np.random.default_rng(0)
    x = rng.random((900, 2))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 0] < 0.5))
    good = ~(bad ^ (rng.random(900) < noise))
    rules = quality.learn(x, good.astype(int), ["a", "b"])
    hit = np.any([r.holds(x, ["a", "b"]) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.9 and (hit & ~bad).sum() <= 20


def test_no_python_in_the_plan(spark):
    docs, _ = corpus(spark, 6)
    rules = [quality.Rule((("symbols_a_word", ">=", 1.0),))]
    for df in (quality.judged(docs, rules), quality.keep_good(docs, rules)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
