import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from rollcall.llm import substrings


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def chunks(text):
    """Digests, starts, ends in code points and words of one text's chunks."""
    for _, line, a, b, starts, ends, words in substrings.divided([text or ""]):
        return [xxhash.xxh3_128_digest(line[i:j]) for i, j in zip(a, b)], starts.tolist(), ends.tolist(), words.tolist()
    return [], [], [], []


def runs(text, least):
    return substrings.runs_of(next(substrings.divided([text])), least)


def plain_chunks(text):
    """(start, end, words) of each chunk, by one rolling sum over the bytes of the joined words."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    seen, hashes = [], []
    for k, (a, b) in enumerate(spans):
        seen += (b" " if k else b"") + re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]).encode()
        hashes.append(sum(int(substrings.GEAR[byte]) << j for j, byte in enumerate(seen[: -17 : -1])) & 0xFFFFFFFF)
    out, begin = [], 0
    for k, h in enumerate(hashes):
        least = all(h < x for x in hashes[max(0, k - substrings.AROUND) : k]) and all(h <= x for x in hashes[k + 1 : k + 1 + substrings.AROUND])
        if least or k + 1 - begin == substrings.MOST or k == len(spans) - 1:
            out.append((spans[begin][0], spans[k][1], k + 1 - begin))
            begin = k + 1
    return out


def test_boundaries_against_a_plain_rolling_hash():
    rng = random.Random(8)
    texts = ["", " \n", "one", "a b c", "É ü\tx\n\n y", "w " * 400, "Ünï Cödé\x0b\x1c日本 " * 30] + [prose(rng, rng.randint(1, 90)).replace("a", "Ä").title() for _ in range(60)]
    got = {k: list(zip(starts.tolist(), ends.tolist(), words.tolist())) for k, _, _, _, starts, ends, words in substrings.divided(texts)}
    assert got == {k: c for k, t in enumerate(texts) if (c := plain_chunks(t))}


def test_gear_is_a_rolling_sum():
    data = np.random.default_rng(0).integers(0, 256, 200).astype(np.uint8)
    got = substrings.gear(data)
    for k in (0, 5, 15, 16, 199):
        want = sum(int(substrings.GEAR[data[k - j]]) << j for j in range(min(k + 1, 16))) & 0xFFFFFFFF
        assert int(got[k]) == want


@pytest.mark.parametrize("text", [None, "", "  ", "one", "a b c", "É ü\tx\n\n y", "w " * 400])
def test_chunks_cover_all_words(text):
    digests, starts, ends, words = chunks(text)
    assert sum(words) == len((text or "").split()) and all(1 <= w <= substrings.MOST for w in words) and len(digests) == len(words)
    joined = " ".join((text or "")[a:b] for a, b in zip(starts, ends))
    assert joined.split() == (text or "").split()


def test_long_texts_have_the_chunks_of_one_pass():
    rng = random.Random(1)
    text = prose(rng, 400_000)
    _, starts, ends, words = chunks(text)
    assert len(text) > 2 << 20 and sum(words) == 400_000 and max(words) <= substrings.MOST and starts[0] == 0 and ends[-1] == len(text)


def test_insertions_move_few_chunks():
    rng = random.Random(2)
    text = prose(rng, 3_000)
    a = set(chunks(text)[0])
    b = set(chunks("inserted words here " + text)[0])
    assert len(a - b) <= 3


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, spans string, k int")


def brute(rows):
    """Chunks whose digest an earlier document holds, joined where neighbours."""
    where = defaultdict(set)
    own = {}
    for d, t in rows:
        own[d] = chunks(t)
        for k, x in enumerate(own[d][0]):
            where[x].add((d, k))
    out = {}
    for d, (digests, starts, ends, words) in own.items():
        runs, last = [], None
        for k, x in enumerate(digests):
            if min(where[x])[0] < d:
                if last == k - 1:
                    runs[-1][1:] = [ends[k], runs[-1][2] + words[k]]
                else:
                    runs.append([starts[k], ends[k], words[k]])
                last = k
        if runs := [tuple(r) for r in runs if r[2] >= substrings.LEAST_WORDS]:
            out[d] = runs
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = [(k, prose(rng, 120)) for k in range(30)]
    rows += [(100 + k, f"{prose(rng, 40)} {passage.upper() if k % 2 else passage} {prose(rng, 50)}") for k in range(8)] + [(200, None), (201, ""), (202, "x y z " * 80), (203, rows[0][1]), (204, "é " + passage)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substrings.duplicate_spans(docs(spark, rows)).collect()}
    assert got == brute(rows)
    assert {101, 102, 103, 104, 105, 106, 107, 203, 204} == set(got), "all but the first holder of a passage, and no clean document"
    firsts = {r["doc_id"]: r["first_ids"] for r in substrings.duplicate_spans(docs(spark, rows)).collect()}
    assert 100 in firsts[107] and set(firsts[107]) <= set(range(100, 107)) and firsts[203] == [0], "copies of a span may have first stood in several holders"


def test_within_and_repeats(spark):
    rng = random.Random(4)
    passage = prose(rng, 80)
    rows = [(1, f"{passage} {prose(rng, 30)} {passage}"), (1, f"{passage} {prose(rng, 30)} {passage}")]
    rows[1] = rows[0]
    assert substrings.duplicate_spans(docs(spark, rows)).count() == 0
    (row,) = substrings.duplicate_spans(docs(spark, rows), within=True).collect()
    assert row["first_ids"] == [1] and Counter(s["words"] >= 50 for s in row["spans"])[True] == 1
    assert substrings.duplicate_spans(docs(spark, [])).count() == 0


def test_short_phrases_of_unrelated_documents_make_no_span(spark):
    rng = random.Random(5)
    for _ in range(10_000):
        text = prose(rng, 40)
        digests, starts, ends, words = chunks(text)
        pieces = [text[a:b] for a, b in zip(starts, ends)]
        if max(words) < substrings.LEAST_WORDS and len(pieces) > 2 and all(chunks(p)[0] == [d] for p, d in zip(pieces, digests)):
            break
    rows = [*enumerate(pieces), (100, text)]
    assert substrings.duplicate_spans(docs(spark, rows)).count() == 0, "each chunk is in another document"
    (row,) = substrings.duplicate_spans(docs(spark, [*rows, (50, text)])).filter("doc_id = 100").collect()
    assert [tuple(s) for s in row["spans"]] == [(0, len(text), 40)] and row["first_ids"] == [50], "one earlier document holds all, though not the least of each chunk"


@pytest.mark.parametrize("least", [1, 7, 12, 40])
def test_runs_cover_and_link_any_passage(least):
    rng = random.Random(6)
    text = prose(rng, 500)
    words = chunks(text)[3]
    at = np.concatenate([[0], np.cumsum(words)])
    _, starts, ends, before, held = runs(text, least)
    assert len(starts) == len(set(zip(before.tolist(), held.tolist()))) and held.min() >= least
    for i in range(len(words)):
        for j in range(i, min(len(words), i + 14)):
            a, b = at[i], at[j + 1]
            if b - a >= least:
                inside = sorted((x, x + n) for x, n in zip(before.tolist(), held.tolist()) if a <= x and x + n <= b)
                end = inside[0][1]
                for x, y in inside:
                    assert x < end
                    end = max(end, y)
                assert (inside[0][0], end) == (a, b)


@pytest.mark.parametrize("one", [7, None, -(1 << 63)])
def test_texts_that_repeat_an_id_are_told_apart(spark, one):
    rng = random.Random(7)
    passage = prose(rng, 60)
    rows = [(one, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for _ in range(3)]
    got = substrings.duplicate_spans(docs(spark, rows + rows[:1])).collect()
    assert len(got) == 2 and all(r["doc_id"] == one and r["first_ids"] == [x for x in (one,) if x is not None] and max(s["words"] for s in r["spans"]) >= 40 for r in got)
    got = substrings.duplicate_spans(docs(spark, [rows[0], (-(1 << 63) if one is None else None, rows[1][1])])).collect()
    assert [r["doc_id"] for r in got] == [-(1 << 63) if one is None else one], "a null id comes before any other"


def test_copies_are_taken_out(spark):
    rng = random.Random(9)
    passage, rows = prose(rng, 80), []
    rows = [(k, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for k in range(3)] + [(None, None), (5, ""), (6, "clean words")]
    left = substrings.without_copies(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "spans", "k"]
    spans = {r["doc_id"]: r["spans"] for r in substrings.duplicate_spans(docs(spark, rows)).collect()}
    want = []
    for d, t in rows:
        for s in reversed(spans.get(d, [])):
            t = t[: s["start"]] + t[s["end"] :]
        want.append((d, t))
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and all(len(t.split()) < 90 for d, t in got if d in (1, 2)) and set(spans) == {1, 2}


@pytest.mark.parametrize("words, least", [(51, 0.98), (60, 0.99)])
def test_passages_of_over_fifty_words_are_found(words, least):
    rng, hit = random.Random(10), 0
    for _ in range(400):
        passage = prose(rng, words)
        a, b = (set(runs(f"{prose(rng, 40)} {passage} {prose(rng, 40)}", substrings.LEAST_WORDS)[0]) for _ in range(2))
        hit += bool(a & b)
    assert hit >= least * 400, hit
