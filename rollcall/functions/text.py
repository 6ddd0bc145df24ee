"""Text and field normalizers as column expressions.

Everything is native except accent folding of non-ASCII values and the Ratcliff-Obershelp ratio,
which have no built-in: both are Arrow UDFs that get null wherever the native answer suffices.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import taxonomy as tx

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

def blank(c: Column) -> Column:
    """Null as the empty string: the one spelling of absence in records."""
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.trim(F.regexp_replace(blank(c), _SPACE, " "))


def notes_text(c: Column) -> Column:
    """Collapsed line by line; inner blank lines stay, outer ones go."""
    lines = F.transform(F.split(blank(c), _LINE_BREAKS, -1), collapse)
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def folded(value: str) -> str:
    """Compatibility decomposition without combining marks, casefolded."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", value) if not unicodedata.combining(ch)).casefold()


@F.pandas_udf(T.StringType())
def _fold_rest(values: pd.Series) -> pd.Series:
    return values.map(folded, na_action="ignore")


def fold(c: Column) -> Column:
    """Accent- and case-folded: natively where a value is ASCII."""
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, F.lower(c)).otherwise(_fold_rest(F.when(~ascii_only, c)))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of an ordered pair; null where either side is null."""
    held: dict[tuple[str, str], float] = {}

    def one(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in held:
            held[x, y] = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        return held[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(blank(a), blank(b)), F.lit(0.0))


def similar_where(need: Column, a: Column, b: Column, least: float = 0.0) -> Column:
    """The ratio where it is needed and can reach ``least`` (2 min / (a + b) bounds it), else null."""
    reach = 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1)) >= least
    asked = F.coalesce(need & reach, F.lit(False))
    return ratio(F.when(asked, a), F.when(asked, b))


def status(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for s in tx.STATUSES for x in (s.lower(), s)))
    return F.try_element_at(known, fold(collapse(c)))


def country(c: Column) -> Column:
    word = lambda w: F.when((w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) <= 4), w).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    known = F.create_map(*(F.lit(x) for kv in tx.COUNTRY_ACRONYMS.items() for x in kv))
    clean = collapse(c)
    return F.coalesce(F.try_element_at(known, F.lower(clean)), F.array_join(F.transform(F.split(clean, " ", -1), word), " "))


def email(c: Column) -> Column:
    return F.lower(collapse(c))


def email_valid(c: Column) -> Column:
    return blank(c).rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$")


def email_domain(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.substring_index(c, "@", -1)).otherwise("")


def email_local(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.substring(c, F.lit(1), F.length(c) - F.length(F.substring_index(c, "@", -1)) - 1)).otherwise("")


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(blank(c), r"(?U)\D", ""), "^00", "")


def phone_last9(digits: Column) -> Column:
    return F.when(F.length(digits) >= 9, F.right(digits, F.lit(9))).otherwise("")


def company_norm(c: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(fold(collapse(c)), r"(?U)[^\w\s]+", " "), _SPACE, " "))
    words = F.split(clean, " ", -1)
    kept = F.filter(words, lambda w: ~w.isin(*tx.LEGAL_TOKENS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(clean)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two blank-separated word sets."""
    x, y = (F.array_distinct(F.filter(F.split(blank(v), " ", -1), lambda w: w != "")) for v in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def name_key(c: Column) -> Column:
    return fold(F.regexp_replace(collapse(c), r"\.+$", ""))


def is_initial(c: Column) -> Column:
    return F.trim(blank(c)).rlike(r"(?U)^[^\W\d_]\.?$")


def split_name(full: Column) -> tuple[Column, Column]:
    """(given, family): the last word is the family name."""
    words = F.split(collapse(full), " ", -1)
    return F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.element_at(words, -1)


def resolve_name(first: Column, last: Column, full: Column) -> tuple[Column, Column, Column]:
    """(given, family, display): first and last win over the full name if either is there."""
    first, last, full = collapse(first), collapse(last), collapse(full)
    given, family = split_name(full)
    apart = (first != "") | (last != "")
    return F.when(apart, first).otherwise(given), F.when(apart, last).otherwise(family), F.when(apart, F.trim(F.concat(first, F.lit(" "), last))).otherwise(full)


def _blank_or_equal(x: Column, y: Column) -> Column:
    return F.when((x == "") | (y == ""), "unknown").when(x == y, "exact")


def given_relation(x: Column, y: Column) -> Column:
    """exact, initial, prefix, conflict or unknown, of two given-name keys."""
    by_length = F.array_sort(F.array(*(F.struct(F.length(k).alias("n"), k.alias("k")) for k in (x, y))))
    least, most = by_length[0], by_length[1]
    parts = F.array_sort(F.transform(F.array(x, y), lambda k: F.struct(F.size(t := F.split(F.trim(F.regexp_replace(k, r"(?U)[-\s]+", " ")), " ", -1)).alias("n"), t.alias("t"))))
    fewer, more = parts[0], parts[1]
    begins = (fewer["n"] < more["n"]) & (F.slice(more["t"], F.lit(1), fewer["n"]) == fewer["t"])
    cut_short = (least["n"] >= tx.GIVEN_PREFIX_LENGTH) & (most["n"] - least["n"] >= tx.GIVEN_PREFIX_GAP)
    known = _blank_or_equal(x, y).when(
        is_initial(x) | is_initial(y), F.when(F.substring(x, 1, 1) == F.substring(y, 1, 1), "initial").otherwise("conflict")).when(
        begins, "prefix").when(F.startswith(most["k"], least["k"]), F.when(cut_short, "prefix").otherwise("unknown"))
    unlike = similar_where(known.isNull(), x, y) < tx.GIVEN_CONFLICT_BELOW
    return F.coalesce(known, F.when(unlike, "conflict"), F.lit("unknown"))


def family_relation(x: Column, y: Column) -> Column:
    """exact, similar, conflict or unknown, of two family-name keys."""
    known = _blank_or_equal(x, y)
    long_enough = F.least(F.length(x), F.length(y)) >= tx.FAMILY_FUZZY_LENGTH
    alike = similar_where(known.isNull() & long_enough, x, y, tx.FAMILY_SIMILAR_FROM) >= tx.FAMILY_SIMILAR_FROM
    return F.coalesce(known, F.when(alike, "similar"), F.lit("conflict"))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(blank(c)), " ", ""), r"[._\-+]+", "")


def local_from_name(local: Column, given: Column, family: Column) -> Column:
    """Whether a compacted local part is a rendering of compacted names."""
    g1, f1 = F.substring(given, 1, 1), F.substring(family, 1, 1)
    both = (given != "") & (family != "")
    pairs = [F.concat(a, b) for x, y in (((given, g1), (family, f1)), ((family, f1), (given, g1))) for a in x for b in y]
    single = ((given != "") & (local == given)) | ((family != "") & (local == family))
    return (both & local.isin(*pairs)) | single


def parse_date(c: Column) -> Column:
    clean = collapse(c)
    tries = [F.when(clean.rlike(shape), F.try_to_date(clean, pattern)) for shape, pattern in (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$", "yyyy-M-d'T'H:m:s'Z'"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"))]
    return F.coalesce(*tries)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def whole_number(c: Column) -> Column:
    return F.when(collapse(c).rlike(r"^[+-]?\d+$"), collapse(c).try_cast("int"))


def summary(display: Column, company: Column, mail: Column, phone: Column) -> Column:
    named = lambda c, none: F.when(blank(c) == "", none).otherwise(c)
    return F.array_join(F.filter(F.array(named(display, "(no name)"), named(company, "(no company)"), blank(mail), blank(phone)), lambda x: x != ""), " | ")


def band(score: Column) -> Column:
    return F.when(score >= tx.HIGH_FROM, "high").when(score >= tx.MEDIUM_FROM, "medium").otherwise("low")
