"""Quality rules: learned decision lists.

Native column expressions count each text's words, symbols, repeated lines and repeated three-word
windows.  Sequential covering then learns an ordered list of threshold conjunctions from a bounded
sample of labelled rows: a rule grows condition by condition while it gains, is pruned on rows held
back, and is kept only while it is precise there.  The list is emitted as one ordered Spark
conditional expression; no Python runs on executors.

Repeated windows: each window is bits of its 64-bit hash with its position in the low bits (20, or 26
beyond a million words, or 31 beyond 2^26), so that one sort of longs brings equal windows together,
and neighbours count only if their words are equal.  Different windows of equal bits could part equal
ones there, so a text in which such neighbours meet has its windows sorted by their words instead:
counts are exact for every text.

Edge cases: null and empty texts have no word and fail the base rule; documents without a label
teach nothing; with no labelled rows, or too few, the list is empty and the base rule alone decides;
rows that repeat an id are judged each; an empty table gives an empty result; extra columns are
carried by ``keep_good`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import SPACE, packed, table, text_of, unpacked

#: Labelled rows that the rules are learned from: the first by hash of the id.
LABELLED_ROWS = 20_000
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_a_word": "n_dup_lines / greatest(n_words, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}


@dataclass(frozen=True)
class Rule:
    """Reject where every condition (feature, sign, threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & ((F.col(name) >= at) if sign == ">=" else (F.col(name) <= at))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, sign, at in self.conditions:
            column = x[:, names.index(name)]
            out &= column >= at if sign == ">=" else column <= at
        return out


def with_counts(rows: DataFrame, text: Column, hash_mask: int = -1) -> DataFrame:
    """``rows`` with n_words and the counts of the base, and three more that rules may use.

    Tests narrow the hash of a window by ``hash_mask``."""
    carried = rows.columns
    at = rows.select("*", text.alias("_t"))
    at = at.select("*", F.array_remove(F.split("_t", SPACE + "+", -1), "").alias("_w"))
    at = at.select(
        *(F.col(f"`{c}`") for c in carried), "_t", "_w", F.size("_w").alias("_n"),
        F.expr("CASE WHEN size(_w) < 1048576 THEN 20 WHEN size(_w) < 67108864 THEN 26 ELSE 31 END").alias("_bits"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    at = at.select("*", F.expr(
        "CASE WHEN _n < 3 THEN array() ELSE sort_array(transform(sequence(0, _n - 3), i -> "
        f"shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) & {hash_mask}L, _bits) | cast(i AS bigint))) END").alias("_s"))
    bits = "shiftright(x, _bits) = shiftright(get(_s, {0}), _bits)"
    words = " AND ".join(f"get(_w, cast(x & (shiftleft(1L, _bits) - 1) AS int) + {k}) = get(_w, cast(get(_s, {{0}}) & (shiftleft(1L, _bits) - 1) AS int) + {k})" for k in range(3))
    # Against the next window in order: 0 other bits, 1 equal, 2 equal bits of other words.
    at = at.select("*", F.expr(f"transform(_s, (x, k) -> CASE WHEN {bits.format('k + 1')} THEN IF({words.format('k + 1')}, 1, 2) ELSE 0 END)").alias("_q"))
    window = "named_struct('a', get(_w, i), 'b', get(_w, i + 1), 'c', get(_w, i + 2), 'i', cast(i AS bigint))"
    other = lambda k: f"coalesce(x.a = get(_e, {k}).a AND x.b = get(_e, {k}).b AND x.c = get(_e, {k}).c, false)"
    at = at.select("*", F.expr(f"CASE WHEN array_contains(_q, 2) THEN sort_array(transform(sequence(0, _n - 3), i -> {window})) END").alias("_e"))
    at = at.select("*", F.expr(
        f"sort_array(CASE WHEN _e IS NOT NULL THEN transform(filter(_e, (x, k) -> {other('k - 1')} OR {other('k + 1')}), x -> x.i) "
        f"ELSE transform(filter(_s, (x, k) -> get(_q, k) = 1 OR get(_q, k - 1) = 1), x -> x & (shiftleft(1L, _bits) - 1)) END)").alias("_r"))
    counts = {
        "n_words": F.col("_n"),
        "word_chars": F.length("_t") - F.regexp_count("_t", F.lit(SPACE)),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.expr("aggregate(transform(_r, (x, k) -> CASE WHEN k = 0 THEN 3L ELSE least(3L, x - get(_r, k - 1)) END), 0L, (a, x) -> a + x)"),
        "n_capitals": F.regexp_count("_t", F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count("_t", F.lit(r"[!?]")),
        "n_digits": F.regexp_count("_t", F.lit(r"[0-9]")),
    }
    # A generator of one row: a filter on a count isn't pushed below it, where it would count everything anew.
    return at.select(*(F.col(f"`{c}`") for c in carried), F.inline(F.array(F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))))


def with_features(counts: DataFrame) -> DataFrame:
    return counts.withColumns({k: F.expr(v).cast("double") for k, v in FEATURES.items()})


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int = 3, steps: int = 48) -> list[tuple[str, str, float]]:
    """Adds the condition of the highest information gain until the rule is pure or gains nothing."""
    rule: list[tuple[str, str, float]] = []
    rows = np.ones(len(x), bool)
    while len(rule) < most and not bad[rows].all():
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None, None)
        for k, name in enumerate(names):
            for at in np.unique(np.quantile(x[rows & bad, k], np.linspace(0, 1, steps))):
                for sign in (">=", "<="):
                    hit = rows & (x[:, k] >= at if sign == ">=" else x[:, k] <= at)
                    q, m = bad[hit].sum(), (~bad[hit]).sum()
                    if q and (gain := q * (np.log2(q / (q + m)) - base)) > best[0]:
                        best = (gain, (name, sign, float(at)), hit)
        if best[1] is None:
            break
        name, sign, at = best[1]
        column = x[rows, names.index(name)]
        beyond = column[column < at] if sign == ">=" else column[column > at]
        if len(beyond):  # half-way to the nearest row that the condition leaves out
            at = float(at + (beyond.max() if sign == ">=" else beyond.min())) / 2
        rule.append((name, sign, at))
        rows = best[2]
    return rule


def learn(x: np.ndarray, good: np.ndarray, names: list[str], most_rules: int = 16, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """An ordered decision list for rows whose label is not good.

    Every third row is held back: a grown rule loses conditions from its end while that raises
    (bad - good) / covered there, and the list ends with the first rule that is not precise there
    or covers fewer than ``least`` bad rows."""
    rules: list[Rule] = []
    held = np.arange(len(x)) % 3 == 2
    left, bad = np.ones(len(x), bool), ~good.astype(bool)
    while len(rules) < most_rules:
        fit, test = left & ~held, left & held
        if bad[fit].sum() < least or bad[test].sum() < least:
            break
        grown = _grow(x[fit], bad[fit], names)

        def worth(n: int) -> float:
            hit = Rule(tuple(grown[:n])).holds(x, names) & test
            return (bad[hit].sum() - (~bad[hit]).sum()) / max(1, hit.sum())

        if not grown:
            break
        rule = Rule(tuple(grown[: max(range(len(grown), 0, -1), key=worth)]))
        hit = rule.holds(x, names)
        if bad[hit & test].sum() < least or bad[hit & test].mean() < precision or bad[hit & fit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learned(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents that pass the base rule."""
    some = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_good")).dropna()
    some = some.orderBy(F.xxhash64("_id"), "_id", "_good").limit(rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("_text")).join(F.broadcast(some), "_id")  # 16 bytes a row: the bound is the limit above
    names = list(FEATURES)
    found = with_features(with_counts(picked, F.col("_text")).drop("_text")).filter(~base_failed()).select("_id", "_good", *names).orderBy(F.xxhash64("_id"), "_id", *names).collect()
    x = np.array([[r[n] for n in names] for r in found], float).reshape(-1, len(names))
    return learn(x, np.array([r["_good"] for r in found], int), names)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the first rule that holds rejects."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    at = with_features(with_counts(rows, F.col("_text")).drop("_text"))
    return at.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that neither the base nor a rule rejects."""
    rows = packed(docs)
    return unpacked(with_features(with_counts(rows, text_of("_row.text"))).filter(verdict(rules)), docs)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learned(docs, table(spark, sf_dir, "labels")))
