import hashlib
import os
import random

import pytest
from pyspark.sql import Row

from rollcall.llm import exact

DOCS = "doc_id long, text string, keep_id string, n string, _row int"


def docs(spark, rows):
    """Rows of (doc_id, text), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], DOCS)


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(exact.normalised(t), []).append(d)
    return groups


CASES = [(1, "a"), (2, "A"), (2, "A"), (3, None), (4, ""), (None, "b"), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "a "), (None, "only null")]


def test_groups_against_brute_force(spark):
    rows = CASES + [(100 + k, f"text {k % 7}") for k in range(60)]
    got = exact.exact_groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for text, ids in brute(rows).items():
        sha = hashlib.sha256(text).hexdigest()
        own = [r for r in got if r["text_sha256"] == sha]
        top = max((d for d in ids if d is not None), default=None)
        assert sorted(map(repr, (r["doc_id"] for r in own))) == sorted(map(repr, ids)) and {(r["keep_id"], r["group_size"]) for r in own} == {(top, len(ids))}
        assert [r["doc_id"] for r in own if r["kept"]] == [top]


def test_dedup_keeps_rows_and_columns(spark):
    rows = CASES + [(100 + k, f"text {k % 7}") for k in range(60)]
    left = exact.dedup(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "keep_id", "n", "_row"]
    want = [(max((d for d in ids if d is not None), default=None), text) for text, ids in brute(rows).items()]
    assert sorted(map(repr, ((r["doc_id"], exact.normalised(r["text"])) for r in left.collect()))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert exact.exact_groups(docs(spark, [])).count() == 0 and exact.dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("budget", [1, 2_000, 1 << 20])
def test_spilling_changes_nothing(budget, tmp_path):
    rng = random.Random(3)
    rows = [(rng.getrandbits(64) if k % 3 else 7 << 60, b"t%d" % (k % 40), k, 1) for k in range(400)]
    rows = [(int(hashlib.md5(t).hexdigest()[:16], 16) if k % 2 else 5 << 58, t, d, n, 1) for k, (_, t, d, n) in enumerate(rows)]
    got = sorted((h, t, d, n) for h, t, d, n, _ in exact.grace(iter(rows), budget, folder=str(tmp_path)))
    want = {}
    for h, t, d, n, _ in rows:
        top, count = want.get((h, t), (d, 0))
        want[h, t] = (max(top, d), count + n)
    assert got == sorted((h, t, d, n) for (h, t), (d, n) in want.items()) and os.listdir(tmp_path) == []


def test_equal_hashes_are_told_apart_by_content():
    got = list(exact.grace(iter([(1, b"a", 1, 1, 1), (1, b"b", 2, 1, 1), (1, b"a", 3, 1, 1), (1, b"b", 2, 1, 1)])))
    assert sorted(got) == [(1, b"a", 3, 2, 1), (1, b"b", 2, 2, 2)]


def test_batches_hold_unsigned_hashes():
    (batch,) = exact._batches(iter([((1 << 64) - 1, b"a", None, 1, 1)]))
    assert batch.to_pylist() == [Row(h=-1, text=b"a", keep_id=None, n=1, ties=1).asDict()]
