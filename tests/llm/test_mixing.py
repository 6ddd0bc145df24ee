import heapq
import time
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, 0, "q") for d, t, s in rows], "doc_id long, text string, source string, n_chars long, _quota string")


def heap_seats(seats, votes, caps):
    got, heap = [0] * len(votes), [(-Fraction(v), k) for k, v in enumerate(votes) if v]
    heapq.heapify(heap)
    while seats and heap:
        _, k = heapq.heappop(heap)
        if got[k] < caps[k]:
            got[k] += 1
            seats -= 1
            heapq.heappush(heap, (-Fraction(votes[k]) / (2 * got[k] + 1), k))
    return got


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=8))
def test_seats_go_by_highest_quotients(seats, rows):
    votes, caps = [v for v, _ in rows], [c for _, c in rows]
    assert mixing.sainte_lague(seats, votes, caps) == heap_seats(seats, votes, caps)


def test_targets_share_the_excess_again():
    assert [float(t) for t in mixing.targets([10, 1000, 1000])] == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    got = mixing.targets([5, 100, 3, 40, 0, 7])
    assert sum(got) == 155 and all(t <= 3 * s for t, s in zip(got, [5, 100, 3, 40, 0, 7]))


ROWS = [(k, " ".join(["w"] * (7 * k % 90)), f"s{k % 5}") for k in range(400)] + [(500, None, "s1"), (501, "", None), (502, "a b\tc\x1cd", None), (503, "x " * 5000, None), (None, "n n n", "s2"), (7, "dup dup", "s3"), (7, "dup dup", "s3"), (504, "", "zero")]


def test_mix_comes_near_its_targets(spark):
    got = mixing.mixed(docs(spark, ROWS), shard_words=1500).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    size = {r["doc_id"]: r["size"] for r in got}
    assert (size[502], size[500], size[501], size[503]) == (3, 0, 0, 5000)
    by = {}
    for r in got:
        t = by.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["size"]
        t[1] += r["taken"]
    assert all(s == source and abs(taken - target) <= 3 * mixing.BLOCK_WORDS for (source, target), (s, taken) in by.items())
    again = mixing.mixed(docs(spark, ROWS[::-1]).repartition(5), shard_words=1500).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_rows_hold_the_words_taken(spark):
    out = mixing.mix(docs(spark, ROWS), shard_words=1500)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "_quota"]
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len([w for w in r["text"].replace("\t", " ").split(" ") if w])
        assert r["n_chars"] == len(r["text"])
    taken = {}
    for r in mixing.mixed(docs(spark, ROWS), shard_words=1500).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert words == {d: t for d, t in taken.items() if t}


def test_tiny_sources_come_near_their_targets(spark):
    rows = [(k, "w " * 500, "big") for k in range(200)] + [(1000, "a b c d e", "tiny"), (1001, "a " * 40, "small"), (1002, "x", "one")]
    got = {r["source_size"]: [r["target"], 0] for r in mixing.mixed(docs(spark, rows)).collect()}
    for r in mixing.mixed(docs(spark, rows)).collect():
        got[r["source_size"]][1] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert {5: 15, 40: 120, 1: 3} == {n: t for n, (t, _) in got.items() if n < 100}
    assert all(abs(taken - target) <= 0.02 * target + 0.5 for target, taken in got.values()), got


def test_many_sources_are_quick():
    sizes, began = [1 + 7 * k % 900 for k in range(30_000)], time.time()
    want = mixing.targets(sizes)
    assert sum(mixing.sainte_lague(int(sum(want)) // 4, want, [3 * n // 4 for n in sizes])) > 0 and time.time() - began < 20


def test_one_source_and_empty(spark):
    got = mixing.mixed(docs(spark, [(k, "a b c", "one") for k in range(50)])).collect()
    assert sum(r["taken"] for r in got) == 160 - 160 % mixing.BLOCK_WORDS or abs(sum(r["taken"] for r in got) - 150) <= mixing.BLOCK_WORDS
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
