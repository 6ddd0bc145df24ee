import hashlib
import random
import time

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm import bpe, token_counts

TEXTS = [None, "", " ", "Hello WORLD's it'LL we'RE", "a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "İΣσ ΟΔΟΣ ǅ ﬁ é é 12345 ½ ٣ x\x1cy\x85z​　q", "aaaaaaaaaaa " * 50, "日本語 テキスト 😀👍🏽", "_under_score__", "x" * 30_000,
         "naïve   café\n\ntest\t'tis 'S", "a" + chr(0x558) + "b", "び", " ".join(f"w{k}ord" for k in range(5_000))]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "i", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_encoding_equals_the_library(spark, library):
    encoded = bpe.encode(docs(spark))
    got, back = {r["doc_id"]: r for r in encoded.collect()}, dict(map(tuple, bpe.decode(encoded).collect()))
    digest = {r["doc_id"]: r for r in bpe.encode_digests(docs(spark)).collect()}
    for k, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids, repr(t)[:60]
        assert back[k] == library.decode(ids, skip_special_tokens=False)
        assert (digest[k]["n_tokens"], digest[k]["ids_sha256"], digest[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(bytes(got[k]["ids"])).hexdigest(), hashlib.sha256(back[k].encode()).hexdigest())
    assert bpe.encode_digests(docs(spark, [])).count() == 0


def test_one_merge_a_round_gives_the_same(library):
    own = bpe.WordBpe(bpe.default_path())
    fast = list(own.encoded(TEXTS))
    own.words, own.ordered = {}, False
    assert fast == list(own.encoded(TEXTS))


def test_long_words_merged_apart_give_the_same(library, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé日 ", k=rng.randint(1, 400))) for _ in range(200)] + ["a" * 1000, "ab" * 700]
    own = bpe.WordBpe(bpe.default_path())
    want = list(own.encoded(words))
    monkeypatch.setattr(bpe, "LONG_BYTES", 0)
    own.words = {}
    assert list(own.encoded(words)) == want == [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


def test_a_very_long_word_is_quick(library):
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    own, began = bpe.WordBpe(bpe.default_path()), time.time()
    ids = next(own.encoded([word]))
    assert time.time() - began < 10 and np.frombuffer(ids, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_every_character_as_the_library_has_it(library):
    """All code points, and strings of marks whose order or composition changed between versions of Unicode."""
    rng, own = random.Random(9), bpe.WordBpe(bpe.default_path())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c % 997 == 0)]
    odd = [0x345, 0x8D2, 0x10EFE, 0x10D25, 0x1C89, 0x1C8A, 0xA7CB, 0xA7D2, 0x301, 0x307, 0x323, 0x1161, 0x11A8, 0x1100, 0xAC00, 0x9C7, 0x9BE, 0x130, 0x3A3, 0x16D63, 0x16D67, 0x1C, 0x85, 0x2028, 0x20, 0x61, 0x41, 0x27, 0x73]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    texts += ["".join(chr(rng.choice(odd if rng.random() < 0.7 else points)) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for ids, found, text in zip(own.encoded(texts), library.encode_batch(texts, add_special_tokens=False), texts):
        assert np.frombuffer(ids, "<u4").tolist() == found.ids, ascii(text)[:80]


def test_decoding_given_ids(spark, library):
    rows = [(1, [0, 49406, 320, 49407]), (2, []), (3, [1 << 20, 320]), (3, [320] * 5)]
    df = spark.createDataFrame([(d, bytearray(np.array(ids, "<u4").tobytes()), "x") for d, ids in rows] + [(None, None, "x")], "doc_id long, ids binary, text string")
    got = sorted(map(tuple, bpe.decode(df).collect()), key=repr)
    assert got == sorted([(d, library.decode(ids, skip_special_tokens=False)) for d, ids in rows] + [(None, "")], key=repr)


def test_few_words_held_gives_the_same(monkeypatch):
    own = bpe.WordBpe(bpe.default_path())
    want = list(own.encoded(TEXTS))
    monkeypatch.setattr(bpe, "WORDS_HELD", 1)
    assert list(own.encoded(TEXTS, step=1)) == want


def plain_counts(files, end):
    out = []
    for name, tokens in files.items():
        ends = [k for k, t in enumerate(tokens) if t == end]
        starts = [0, *(e + 1 for e in ends)]
        out += [(name, k, e - s, True) for k, (s, e) in enumerate(zip(starts, ends))]
        if starts[-1] < len(tokens):
            out.append((name, len(ends), len(tokens) - starts[-1], False))
    return sorted(out)


@pytest.mark.parametrize("block, size", [(1, 60), (64, 100), (7, 1 << 20)])
@pytest.mark.parametrize("content", [False, True])
def test_flat_files(spark, tmp_path, monkeypatch, block, size, content):
    rng = np.random.default_rng(2)
    files = {f"f{k}.bin": rng.choice([0, 1, 2, 9], 500).tolist() for k in range(3)} | {"none.bin": [1, 2, 3], "all.bin": [9, 9, 9], "long.bin": [1] * 700 + [9], "empty.bin": []}
    for name, tokens in files.items():
        np.array(tokens, "<u2").tofile(tmp_path / name)
    if content:  # as in a store that only Spark can open
        monkeypatch.setattr(token_counts, "_reachable", lambda uri: False)
    flat = token_counts.read_flat(spark, str(tmp_path), range_tokens=size)
    got = sorted((r["file"].rsplit("/", 1)[1], r["ordinal"], r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(flat, 9, block_tokens=block).collect())
    assert got == plain_counts(files, 9)


def test_odd_bytes_and_wide_ids_are_errors(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="buffer size"):
        token_counts.count_tokens(token_counts.read_flat(spark, str(tmp_path)), 9).collect()
    with pytest.raises(ValueError):
        token_counts.fits(bpe.tokenizer(None), "<u1")


@pytest.mark.parametrize("block, size", [(7, 5000), (1 << 16, 1 << 23)])
def test_document_counts(spark, library, block, size):
    library.encode_special_tokens = True
    got = sorted(map(tuple, token_counts.document_counts(docs(spark).repartition(3), block_tokens=block, range_tokens=size).collect()))
    assert got == [(k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(TEXTS)]
    library.encode_special_tokens = False
    assert token_counts.document_counts(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [tuple(r) for r in token_counts.document_counts(twice).collect()] == [(None, 2), (None, 2)]
