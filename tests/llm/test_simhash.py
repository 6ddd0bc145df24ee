import itertools
import random

import numpy as np
import pytest
import xxhash

from rollcall.llm import simhash
from rollcall.llm.components import components


def plain(text):
    """The fingerprint bit by bit."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b c d", "ÉÈ x y b c d e", "w " * 70_000, "one two three four five six seven one two three four"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_golay_code_covers_all_words_and_near_errors():
    tables = simhash.golay_tables()
    assert len(set(tables[2].tolist())) == 2048 and max(int(e).bit_count() for e in tables[2]) == 3
    x = np.random.default_rng(1).integers(0, 1 << 23, 20_000)
    nearest, every = simhash.indices(x, tables)
    for i in range(23):
        other, more = simhash.indices(x ^ (1 << i), tables)
        assert (more == nearest[:, None]).any(1).all() and (every == other[:, None]).any(1).all()
        for j in range(i):
            _, more = simhash.indices(x ^ (1 << i) ^ (1 << j), tables)
            assert (more[:, :, None] == every[:, None, :]).any((1, 2)).all()


def test_four_errors_always_meet():
    tables, rng = simhash.golay_tables(), random.Random(5)
    for _ in range(3_000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        key, fp = simhash.keys(np.array([a, b], np.uint64), tables)
        assert set(key[fp == a]) & set(key[fp == b])


def brute(fps):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(up), 2):
        if (a ^ b).bit_count() <= 4:
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in up}


def clouds(seed=2):
    """Random points, a dense ball, and a chain that no ball holds."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(150)]
    center = rng.getrandbits(64)
    out += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(250)]
    at = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), 4):
            at ^= 1 << b
        out.append(at)
    return sorted(set(out))


@pytest.mark.parametrize("limit", [8, 1 << 15])
def test_links_against_brute_force(spark, limit):
    fps = clouds()
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(simhash.links(df, limit)).collect()}
    want = brute(fps)
    same = lambda of: {frozenset(f for f in fps if of.get(f, f) == r) for r in {of.get(f, f) for f in fps}}
    assert same(got) == same(want)


def test_dense_groups_send_forests_only():
    forest = simhash.Forest()
    simhash.reach(np.array(clouds(), np.uint64), forest)
    assert len(forest.links) == len(clouds()) - len(set(brute(clouds()).values()))


def corpus():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3_000)]
    rows = [(k, " ".join(rng.choices(words, k=300))) for k in range(20)]
    for k in range(20, 40):
        text = rows[k % 4][1].split()
        text[rng.randrange(len(text))] = "changed"
        rows.append((k, " ".join(text)))
    return rows + [(50, None), (51, ""), (52, "  "), (None, rows[0][1]), (3, rows[3][1]), (60, "x"), (61, "X")]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, fp string, root int")


def wanted(rows):
    of = brute({plain(t) for _, t in rows})
    least = {}
    for d, t in rows:
        if d is not None:
            r = of[plain(t)]
            least[r] = min(d, least.get(r, d))
    return of, least


def test_groups_against_brute_force(spark):
    rows = corpus()
    of, least = wanted(rows)
    got = sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs(spark, rows)).collect())
    assert got == sorted((repr(d), f"{plain(t):016x}", least[of[plain(t)]]) for d, t in rows)


@pytest.mark.parametrize("rows", [corpus(), [r for r in corpus() if r[0] is not None and r[0] != 3], [(5, "a b c d e"), (5, "q r s t u v")]])
def test_dedup_keeps_one_of_each_group(spark, rows):
    of, least = wanted(rows)
    left = simhash.dedup(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "fp", "root"]
    got = sorted(of[plain(r["text"])] for r in left.collect())
    assert got == sorted({of[plain(t)] for _, t in rows})
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(least.values())


def test_empty(spark):
    assert simhash.near_groups(docs(spark, [])).count() == 0 and simhash.dedup(docs(spark, [])).count() == 0
