"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed lexicon and of one learned from labelled rows, second-person
words near lexicon words, capitals, punctuation, obfuscation, length.  Histogram trees are boosted on
the logistic loss on four of five labelled rows, and pool-adjacent-violators on the fifth turns their
sum into a probability.  Learning uses a bounded sample of labelled rows outside the held-out third;
every text is scored whole, in batches, by arrays of tree nodes.

Edge cases: null and empty texts have zero features and a score; without labels of both kinds every
score is the share of toxic labels (0 with none); rows that repeat an id are scored each; an empty
table gives an empty result; extra columns are ignored; labels, lang, source and id are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, small, table, text_rows

#: Labelled rows that the model is fitted on: the first by hash of the id.
LABELLED_ROWS = 20_000
HELD_OUT = (3, 1)
THRESHOLD = 0.7
#: Stems: lengths, least toxic rows, least share of toxic among rows that hold one, most candidates.
STEM_LENGTHS = (3, 4, 5, 6)
LEAST_ROWS = 5
PRECISION = 0.9
MOST_STEMS = 2_000
#: Common insults.
INSULTS = """idiot idiots moron morons stupid dumb loser losers trash scum clown clowns worthless pathetic disgusting filthy ugly fool fools
vermin garbage imbecile jerk freak creep coward liar hate kill die shut useless retard bastard bitch fuck fucking shit asshole crap damn""".split()
SECOND_PERSON = ("you", "your", "you're", "youre", "yourself", "u", "ur", "du", "dich", "dein", "tu", "toi", "vous", "ton", "usted", "eres")
#: Characters that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
#: Tokens of bounded length, so that no place of a text is looked at more than a few times.
HIDDEN = re.compile(r"(?<![^\W_])[a-z0-9@$!|*]{3,15}(?![^\W_])")
MIXED = re.compile(r"(?=.*[a-z]).*[0-9@$!|*]")
SPACED = re.compile(r"(?<![^\W_])(?:[a-z][ .\-_*]){2,11}[a-z](?![^\W_])")
NAMES = ("fixed", "learned", "near_you", "capitals", "marks", "hidden", "fixed_any", "learned_any", "length")


def words_of(text: str | None) -> list[str]:
    return TOKENS.findall((text or "").lower())


@dataclass(frozen=True)
class Lexicon:
    """Whole words, and learned stems: what words of their lengths or more begin with."""

    words: frozenset[str] = frozenset(INSULTS)
    stems: tuple[str, ...] = ()

    @cached_property
    def by_length(self) -> dict[int, frozenset[str]]:
        return {n: frozenset(s for s in self.stems if len(s) == n) for n in sorted({len(s) for s in self.stems})}

    def hits(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Places of words of the lexicon, and of words that begin with a stem."""
        fixed = [] if self.words.isdisjoint(words) else [k for k, w in enumerate(words) if w in self.words]
        learned: set[int] = set()
        for n, own in self.by_length.items():
            if not own.isdisjoint({w[:n] for w in words}):
                learned.update(k for k, w in enumerate(words) if w[:n] in own)
        return fixed, sorted(learned)

    def holds(self, word: str) -> bool:
        return word in self.words or word.startswith(self.stems)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features, in the order of NAMES."""
    text = text or ""
    low = text.lower()
    words = TOKENS.findall(low)
    n = max(1, len(words))
    fixed, learned = lexicon.hits(words)
    a, b = len(fixed), len(learned)
    near = sum(not yours.isdisjoint(words[max(0, k - 5) : k + 6]) for k in {*fixed, *learned})
    hidden = 0
    if any(c in low for c in "@$*!|0134579"):
        hidden += sum(lexicon.holds(m.translate(LOOKALIKES).replace("*", "")) or _starred(m, lexicon.words) for m in HIDDEN.findall(low) if MIXED.match(m))
    hidden += sum(re.sub(r"[^a-z]", "", m) in lexicon.words for m in SPACED.findall(low))
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = text.count("!") + text.count("?")
    return [1000 * a / n, 1000 * b / n, 1000 * near / n, capitals / max(1, len(text)), marks / n, 1000 * hidden / n, float(a), float(b), float(np.log1p(len(words)))]


yours = frozenset(SECOND_PERSON)


def _starred(word: str, lexicon: frozenset[str]) -> bool:
    return "*" in word and any(len(x) == len(word) and all(p in (q, "*") for p, q in zip(word, x)) for x in lexicon)


def stems_of(text: str | None) -> set[str]:
    own = set(words_of(text))
    return {w[:n] for n in STEM_LENGTHS for w in own if len(w) >= n}


def cover(stems: list[str], held: list[list[int]]) -> list[str]:
    """Stems that cover toxic rows greedily: a stem stays only for rows that no earlier one covers,
    so what merely goes along with toxic words (names, copies of one text) isn't learned."""
    by_stem: list[set[int]] = [set() for _ in stems]
    for row, own in enumerate(held):
        for k in own:
            by_stem[k].add(row)
    out, open_ = [], set(range(len(held)))
    while by_stem:
        k = max(range(len(stems)), key=lambda k: (len(by_stem[k] & open_), -k))
        if len(by_stem[k] & open_) < LEAST_ROWS:
            break
        out.append(stems[k])
        open_ -= by_stem[k]
    return out


@dataclass
class Model:
    lexicon: Lexicon = Lexicon()
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, at, value in self.trees:
            out += _fall(x, feature, at, value)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.margin(x), *self.knots), 0.0, 1.0)


def _fall(x: np.ndarray, feature: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Leaf values; trees are complete, children of node k are 2k + 1 and 2k + 2."""
    node = np.zeros(len(x), np.int64)
    for _ in range((len(value) + 1).bit_length() - 2):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > at[node])
    return value[node]


def _tree(x: np.ndarray, bins: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = (1 << depth) - 1
    feature, at, value = np.zeros(2 * inner + 1, np.int64), np.full(2 * inner + 1, np.inf), np.zeros(2 * inner + 1)
    node = np.zeros(len(x), np.int64)
    for k in range(inner):
        here = node == k
        if here.sum() < 2:
            node[here] = 2 * k + 1
            continue
        G, H = g[here].sum(), h[here].sum()
        best = (1e-6, 0, np.inf)
        for f, edges in enumerate(bins):
            if not len(edges):
                continue
            gl = np.cumsum(np.bincount(binned[here, f], g[here], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[here, f], h[here], len(edges) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
            gain[(hl < 1) | (H - hl < 1)] = 0
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (float(gain[j]), f, float(edges[j]))
        feature[k], at[k] = best[1], best[2]
        node[here] = 2 * k + 1 + (x[here, best[1]] > best[2])
    for k in range(inner, 2 * inner + 1):
        here = node == k
        value[k] = -rate * g[here].sum() / (h[here].sum() + ridge)
    return feature, at, value


def isotonic(x: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; each pool's mean is drawn to the base rate by ``prior`` rows."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order], y[order]):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([float(b), 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    base = float(y.mean())
    knots = [(p, (s + prior * base) / (n + prior)) for s, n, a, b in pools for p in ((a, b) if b > a else (a,))]
    return np.array([k[0] for k in knots]), np.maximum.accumulate(np.array([k[1] for k in knots]))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT[0])) == HELD_OUT[1]


def learned(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents that aren't held out."""
    some = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna().filter(~held_out(F.col("_id")))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).join(F.broadcast(some), "_id")  # 16 bytes a row: the bound is the limit above
    return fit_distributed(picked)


def fit_distributed(picked: DataFrame) -> Model:
    """Texts stay on the executors, which send stem counts and then features, not prose."""
    rows = cut(picked.filter("_toxic IN (0, 1)").select("_id", "_toxic", "_text", F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(5)).alias("_fold")))

    def stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64()), pa.array([bad[s] for s in seen], pa.int64())], names=["s", "seen", "n"])

        for b in batches:
            for t, y in zip(b.column("_text").to_pylist(), b.column("_toxic").to_pylist()):
                own = stems_of(t)
                seen.update(own)
                if y:
                    bad.update(own)
                if len(seen) > 300_000:
                    yield batch()
                    seen, bad = Counter(), Counter()
        if seen:
            yield batch()

    train = rows.filter("_fold <> 4")
    sums = train.mapInArrow(stem_counts, "s string, seen long, n long").groupBy("s").agg(F.sum("seen").alias("seen"), F.sum("n").alias("n"))
    sure = sums.filter((F.col("n") >= LEAST_ROWS) & (F.col("n") >= PRECISION * F.col("seen")))
    top = [r["s"] for r in sure.orderBy(F.desc("n"), F.length("s"), "s").limit(MOST_STEMS).collect()]

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {s: k for k, s in enumerate(top)}
        for b in batches:
            own = [sorted(place[s] for s in stems_of(t) & place.keys()) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], names=["k"])

    held = train.filter("_toxic = 1").mapInArrow(holding, "k array<int>").collect() if top else []
    model = Model(Lexicon(stems=tuple(cover(top, [r["k"] for r in held]))))
    lexicon = model.lexicon

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, lexicon) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_toxic"), b.column("_fold"), pa.array(x, pa.list_(pa.float64())), b.column("_id")], names=["y", "fold", "x", "id"])

    found = rows.mapInArrow(feature_rows, "y int, fold long, x array<double>, id long").orderBy(F.xxhash64("id"), "id", "x").collect()
    return boost(model, np.array([r["x"] for r in found], float).reshape(-1, len(NAMES)), np.array([r["y"] for r in found], float), np.array([r["fold"] == 4 for r in found], bool))


def boost(model: Model, x: np.ndarray, toxic: np.ndarray, check: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 2.0) -> Model:
    """Trees from the rows outside ``check``, calibration from those in it."""
    if not len(toxic) or toxic.min() == toxic.max():
        model.base = float(toxic.mean()) if len(toxic) else 0.0
        return model
    if not check.any() or toxic[check].min() == toxic[check].max() or toxic[~check].min() == toxic[~check].max():
        check = np.zeros(len(toxic), bool)
    train, y = x[~check], toxic[~check]
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, 64)))[:-1] for c in train.T]
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bins, train.T)], axis=1)
    margin = np.full(len(train), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        tree = _tree(train, bins, binned, q - y, np.maximum(q * (1 - q), 1e-9), depth, ridge, rate)
        model.trees.append(tree)
        margin += _fall(train, *tree)
    rows = check if check.any() else np.ones(len(toxic), bool)
    model.knots = isotonic(model.margin(x[rows]), toxic[rows])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    lexicon = model.lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            x = np.array([features(t, lexicon) for t in b.column(1).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    rows = text_rows(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learned(docs, table(spark, sf_dir, "labels")))
