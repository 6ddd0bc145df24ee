"""BPE encoding and decoding by batched numpy merge rounds.

The tokenizer file is read as data: word pattern and merge table.  Words that a batch of
texts has not met yet are merged together: their symbols lie in one flat array, a binary search over
sorted pair keys ranks all neighbours at once, and each round merges every word's lowest-rank pair.
Words of over ``LONG_BYTES`` are merged apart, one pair after the other from a heap, so that a round
never touches what it doesn't change.  A worker remembers a bounded number of words.

What is a letter, and how marks are ordered and composed, differs between versions of Unicode.  Texts
of characters on which all versions agree are split by Python's own engine; for all others the
installed library's normaliser and character classes are asked, each character once.

Decoding maps ids to tokens and joins them by spaces, as the file names no decoder; unknown ids are
left out, as the library does.

Edge cases: null counts as empty, and empty texts have no ids; special tokens in a text are single
ids, as the library has them; texts are encoded whole, whatever their length; an empty table gives
an empty result; extra columns are ignored; null ids decode to the empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .frames import small, table, text_rows

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers before it starts again.
WORDS_HELD = 150_000
#: Words beyond this many bytes are merged apart.
LONG_BYTES = 512
NONE = np.iinfo(np.int64).max
#: Characters that compose with the letter before them though they are letters themselves.
JAMO = frozenset(map(chr, range(0x1100, 0x1200)))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + more)
            more += 1
    return out


class WordBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        #: The same words in the faster engine's classes.
        short = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^ \t-\r\w]|_)+").replace(r"[\p{L}]+", r"[^\W\d_]+").replace(r"[\p{N}]", r"\d")
        self.fast = re.compile(short)
        #: Characters on which all versions agree, and what stands for the others when words are sought.
        self.plain = {chr(c) for c in range(0x1C)} | {chr(c) for c in range(0x20, 0x7F)}
        self.odd: set[str] = set()
        self.kinds: dict[int, str] = {c: chr(c) for c in (*range(0x1C), *range(0x20, 0x7F))}
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(self.tokens) + 1
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key, first = np.unique(left * self.width + right, return_index=True)  # a repeated pair keeps its lower rank
        self.pair_keys, self.ranks, self.into = key, first, into[first]
        made = np.full(self.width, -1, np.int64)
        np.maximum.at(made, into, np.arange(len(into)))
        #: A merge never outranks the one that made its parts: all equal pairs of a word can merge in one round.
        self.ordered = bool((np.maximum(made[left], made[right]) < np.arange(len(into))).all())
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.end] for s in symbols], np.int64)
        self.pairs: dict[int, tuple[int, int]] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and where each word's begin, by rounds over all words at once."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(length)
        ids[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw)), length)
        done_ids, done_word = [], []
        while len(ids):
            key = np.where(word[1:] == word[:-1], ids[:-1] * self.width + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = self.pair_keys[at] == key
            rank = np.append(np.where(hit, self.ranks[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NONE
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                keep = ~over
                ids, word, rank, least, at = ids[keep], word[keep], rank[keep], least[keep], np.append(at, 0)[keep]
                if not len(ids):
                    break
            take = rank == least
            if self.ordered:  # of a run of overlapping pairs every other one, from the left
                place = np.flatnonzero(take)
                fresh = np.append(True, np.diff(place) > 1)
                run = np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
                place = place[run % 2 == 0]
            else:
                place = np.flatnonzero(take)
                place = place[np.append(True, word[place][1:] != word[place][:-1])]
            ids[place] = self.into[at[place]]
            stay = np.ones(len(ids), bool)
            stay[place + 1] = False
            ids, word = ids[stay], word[stay]
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return ids[order], np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))

    def merged_long(self, word: str) -> np.ndarray:
        """Token ids of one long word: its pairs by rank, then place, each merge changing two neighbours."""
        if not self.pairs:
            self.pairs = {k: (r, i) for k, r, i in zip(self.pair_keys.tolist(), self.ranks.tolist(), self.into.tolist())}
        raw = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
        ids = [*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        n, width, pairs = len(ids), self.width, self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(hit[0], k, hit[1], ids[k], ids[k + 1]) for k in range(n - 1) if (hit := pairs.get(ids[k] * width + ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, into, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j < 0 or ids[j] != right:
                continue  # one of the two has been merged since
            ids[k], ids[j], after[k] = into, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (hit := pairs.get(ids[x] * width + ids[y])):
                    heapq.heappush(heap, (hit[0], x, hit[1], ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def pieces(self, text: str, special: bool = True) -> list[str]:
        """Normalised words, and special tokens as themselves (or else as ordinary text)."""
        out = []
        for part in self.specials.split(text) if special and "<|" in text else (text,):
            if special and part in self.special:
                out.append(part)
            elif part:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        here = set(text)
        if not here <= self.plain:
            self._learn_characters(here - self.plain - self.odd)
        if here <= self.plain:
            if "Σ" in here:
                text = text.replace("Σ", "σ")  # letter by letter, without the final form
            return self.fast.findall(text.lower())
        text = self.normal(text)
        if new := [c for c in set(text) if ord(c) not in self.kinds]:
            self._learn_kinds(new)
        return [text[m.start() : m.end()] for m in self.fast.finditer(text.translate(self.kinds))]

    def _learn_characters(self, new: set[str]) -> None:
        """Letters that stand alone, and become just Python's lower-case letters, are plain; all else is odd."""
        lower = {c: "σ" if c == "Σ" else c.lower() for c in new}
        self._learn_kinds([x for low in lower.values() for x in low if ord(x) not in self.kinds])
        for c, low in lower.items():
            alone = unicodedata.category(c)[0] == "L" and c not in JAMO and unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c)
            fine = alone and all(self.kinds[ord(x)] in ("é", x) and unicodedata.category(x)[0] == "L" for x in low) and self.normal(c) == low
            (self.plain if fine else self.odd).add(c)

    def _learn_kinds(self, new: list[str]) -> None:
        """The library's classes: a letter, a number, a space or none of them."""
        line = "\x01".join(new)
        found = {c: "¤" for c in new}
        for kind, stands in ((r"\p{L}", "é"), (r"\p{N}", "٣"), (r"\s", " ")):
            split = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
            found |= {c: stands for c, _ in split.pre_tokenize_str(line)} if line else {}
        self.kinds |= {ord(c): k for c, k in found.items()}

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.words) > WORDS_HELD:
            self.words = {}
        for special, k in self.special.items():
            self.words[special] = np.array([k], "<u4").tobytes()
        new = set().union(*texts) - self.words.keys()
        long_ = {w for w in new if len(w) > LONG_BYTES // 4 and len(w.encode("utf-8", "surrogatepass")) > LONG_BYTES}
        for w in long_:
            self.words[w] = self.merged_long(w).astype("<u4").tobytes()
        some = list(new - long_)
        ids, starts = self.merged(some)
        raw, starts = ids.astype("<u4").tobytes(), starts.tolist()
        for w, a, b in zip(some, starts, starts[1:]):
            self.words[w] = raw[4 * a : 4 * b]

    def encoded(self, texts: list[str | None], step: int = 256, special: bool = True) -> Iterator[bytes]:
        """For each text its ids, little-endian unsigned 32-bit."""
        for k in range(0, len(texts), step):
            words = [self.pieces(t or "", special) for t in texts[k : k + step]]
            self.learn(words)
            for w in words:
                yield b"".join(map(self.words.__getitem__, w))

    def decoded(self, ids: bytes | None) -> str:
        """The text that ids, little-endian unsigned 32-bit, stand for: tokens of the file joined by spaces."""
        found = np.frombuffer(ids or b"", "<u4").tolist()
        try:
            return " ".join(map(self.tokens.__getitem__, found))
        except KeyError:
            return " ".join(self.tokens[i] for i in found if i in self.tokens)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenizer(path: str | None) -> WordBpe:
    """One for each worker and file: a module of its own keeps it between tasks."""
    held = sys.modules.setdefault("_rollcall_held", ModuleType("_rollcall_held"))
    tables = held.__dict__.setdefault("bpe", {})
    path = path or default_path()
    if path not in tables:
        tables[path] = WordBpe(path)
    return tables[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) for every row of ``docs``.

    ``path`` names the tokenizer file on the executors; none: the installed public one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.encoded(b.column(1).to_pylist()), pa.binary())], names=["doc_id", "ids"])
        bpe.words = {}

    return text_rows(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text for every row of ``encoded`` (doc_id, ids), whoever encoded it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(bpe.decoded, b.column(1).to_pylist()), pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")).mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests made beside the texts, which stay there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in small(batches):
            n, first, second = [], [], []
            for ids in bpe.encoded(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(bpe.decoded(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.words = {}  # the worker lives on; its tables do, its words don't

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
