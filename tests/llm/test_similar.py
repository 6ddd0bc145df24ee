import random

import numpy as np
import pytest

from rollcall.llm import similar


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, hi string, root int")


def prose(rng, n):
    return [f"w{rng.randrange(3_000)}" for _ in range(n)]


def edited(rng, words, places):
    out = list(words)
    for p in rng.sample(range(len(out)), places):
        out[p] = f"e{rng.randrange(10**6)}"
    return out


def corpus():
    rng = random.Random(9)
    base = [prose(rng, 300) for _ in range(20)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    rows += [(20 + k, " ".join(edited(rng, base[k % 4], 1 + k % 4)).upper()) for k in range(60)]
    return rows + [(100, None), (101, ""), (102, "  "), (103, "x"), (104, "X"), (105, "a b c d"), (106, " ".join(prose(rng, 60_000)))]


def of(rows):
    """What stays: the first of each base's copies, of the empty texts and of the equal short ones."""
    return sorted([*range(20), 100, 103, 105, 106])


def plain_margins(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    out = [0] * 128
    for k in range(max(1, len(words) - 4) if words else 0):
        h = int.from_bytes(similar.xxhash.xxh3_128_digest(" ".join(words[k : k + 5]).encode(), similar.SEED), "big")
        for b in range(128):
            out[b] += 1 if h >> (127 - b) & 1 else -1
    return out


def test_margins_and_keys_against_a_plain_version():
    rng = random.Random(2)
    texts = ["", "a", "a b C d e", " ".join(prose(rng, 40)), " ".join(prose(rng, 300))]
    sums = np.stack([similar.margins(t) for t in texts])
    assert sums.tolist() == [plain_margins(t) for t in texts]
    assert [int(a) << 64 | int(b) for a, b in similar.fingerprints(sums).tolist()] == [int("".join("01"[x > 0] for x in row), 2) for row in sums.tolist()]
    codes = similar.codewords().T
    wide = np.random.default_rng(5).integers(-10_000, 10_000, (4, 128))  # without ties
    for row, own in zip(wide, similar.keys(wide)):
        best = [set(sorted(range(4096), key=lambda c: -float(codes[c] @ row[s * 21 : s * 21 + 21]))[:2]) for s in range(6)]
        pairs = [(i, j) for i in range(6) for j in range(i + 1, 6)]
        want = {tag << 24 | a << 12 | b for tag, (i, j) in enumerate(pairs) for a in best[i] for b in best[j]}
        assert set(own.tolist()) == want and len(own) == 60


def test_the_code_keeps_its_distance():
    words = similar.codewords().T
    apart = (similar.WIDTH - words @ words.T) / 2
    np.fill_diagonal(apart, 99)
    assert apart.min() >= 5  # seven, less the two places left out


@pytest.mark.parametrize("jaccard, least", [(0.8, 0.88), (0.85, 0.95), (0.9, 0.98)])
def test_recall(jaccard, least):
    """Pairs of sets of shingles of a given similarity share a key and pass the check of their bits."""
    rng, hit, n = np.random.default_rng(3), 0, 400
    shared, own = int(300 * jaccard), int(300 * (1 - jaccard) / 2)
    a, b = np.empty((n, 128), np.int64), np.empty((n, 128), np.int64)
    for k in range(n):
        both, x, y = (rng.integers(0, 2, (m, 128)).sum(axis=0) * 2 - m for m in (shared, own, own))
        a[k], b[k] = both + x, both + y
    near = np.bitwise_count(similar.fingerprints(a) ^ similar.fingerprints(b)).sum(axis=1) <= similar.most_bits(0.8)
    meet = [bool(set(x) & set(y)) for x, y in zip(similar.keys(a).tolist(), similar.keys(b).tolist())]
    hit = np.mean(near & np.array(meet))
    assert hit >= least, hit


@pytest.mark.parametrize("bucket_rows", [8, 1 << 15])
def test_one_of_each_group_stays(spark, bucket_rows):
    rows = corpus()
    left = similar.dedup(docs(spark, rows).repartition(3), bucket_rows=bucket_rows)
    assert left.columns == ["doc_id", "text", "hi", "root"]
    assert sorted(r["doc_id"] for r in left.collect()) == of(rows)


def test_links_against_all_pairs(spark):
    """No link of different groups, and every kept pair of one group is connected."""
    rows = corpus()
    sums = np.stack([similar.margins(t) for _, t in rows])
    fp = similar.fingerprints(sums)
    got = {(r["doc_id"]): r["root"] for r in similar.grouped(docs(spark, rows)).collect()}
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(fp[i] ^ fp[j]).sum() <= similar.most_bits(0.8):
                up[find(rows[i][0])] = find(rows[j][0])
    split = {}
    for d, root in got.items():
        split.setdefault(root, set()).add(find(d))
    assert all(len(s) == 1 for s in split.values())
    assert len(split) == len({find(d) for d, _ in rows})


def test_repeats_nulls_and_empty(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v"), (None, "z y x w v u")]
    got = sorted(((r["doc_id"], r["text"]) for r in similar.dedup(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(3, "a b c d e f"), (3, "q r s t u v"), (None, "z y x w v u")], key=repr)
    assert similar.dedup(docs(spark, [])).count() == 0
