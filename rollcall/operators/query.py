"""Filtered, ordered, paged and aggregated views of records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx

ESCAPE = "\u0001"


def canonical_status(value: str | None) -> str | None:
    """A status of the taxonomy, None for blank; an unknown one is an error that lists them all."""
    clean = " ".join((value or "").split()).casefold()
    if not clean:
        return None
    for s in tx.STATUSES:
        if s.casefold() == clean:
            return s
    raise ValueError(f"status must be one of {list(tx.STATUSES)}")


@dataclass(frozen=True)
class LeadFilters:
    """Present filters hold together; none is no constraint."""

    status: str | None = None
    owner: str | None = None
    country: str | None = None
    q: str | None = None

    def clauses(self) -> list[Column]:
        out = []
        if s := canonical_status(self.status):
            out.append(F.col("status") == s)  # reaches the Parquet scan as it is
        for column, value in (("owner", self.owner), ("country", self.country)):
            if value and value.strip():
                out.append(F.lower(column) == " ".join(value.lower().split()))
        if self.q and self.q.strip():
            # % and _ in it are wild; an escape of its own leaves backslashes and quotes as they are.
            sample = F.lit(f"%{' '.join(self.q.lower().split())}%".replace(ESCAPE, 2 * ESCAPE))
            out.append(reduce(lambda a, b: a | b, (F.like(F.lower(c), sample, F.lit(ESCAPE)) for c in ("display_name", "company", "email"))))
        return out

    def apply(self, leads: DataFrame) -> DataFrame:
        return reduce(lambda df, c: df.filter(c), self.clauses(), leads)


def ordered(leads: DataFrame) -> DataFrame:
    """Newest first, records without a date last, then by id."""
    return leads.orderBy(F.desc_nulls_last("created_at"), F.asc("id"))


def page(leads: DataFrame, limit: int = tx.PAGE_SIZE, offset: int = 0) -> DataFrame:
    """A page of the canonical order: one top-k, not a full sort."""
    if not 1 <= limit <= tx.PAGE_MOST or offset < 0:
        raise ValueError(f"limit is 1 to {tx.PAGE_MOST}, offset at least 0")
    return ordered(leads).offset(offset).limit(limit)


def page_after(leads: DataFrame, created_at: str | None, id_: str, limit: int = tx.PAGE_SIZE) -> DataFrame:
    """The page that follows a row, by its key: deep pages cost no more than the first."""
    after = F.col("id") > id_ if created_at is None else F.lit(False)
    rest = (F.col("created_at").isNull() & after) if created_at is None else (
        F.col("created_at").isNull() | (F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("id") > id_)))
    return page(leads.filter(rest), limit)


def lookup(leads: DataFrame, id_: str) -> DataFrame:
    return leads.filter(F.col("id") == id_).limit(1)


def count(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count("*").alias("total"))


def dashboard(leads: DataFrame) -> DataFrame:
    """(kind, value, n): all counts in one pass by grouping sets, partially aggregated."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    at = leads.select(named("status").alias("status"), named("source_channel").alias("channel"), F.coalesce("source_needs_review", F.lit(False)).alias("review"))
    sets = at.groupingSets([["status"], ["channel"], []], "status", "channel").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("review").alias("review"))
    rows = F.when(F.col("g") == 1, F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("value"), "n")))
    rows = rows.when(F.col("g") == 2, F.array(F.struct(F.lit("channel").alias("kind"), F.col("channel").alias("value"), "n")))
    rows = rows.otherwise(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("all").alias("value"), "n"), F.struct(F.lit("needs_review").alias("kind"), F.lit("all").alias("value"), F.col("review").alias("n"))))
    return sets.select(F.inline(rows))


def next_id(leads: DataFrame) -> DataFrame:
    """(next_id): one more than the largest numeric prefix of an id, or than 100000000."""
    number = F.coalesce(F.regexp_extract("id", r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))
    return leads.agg((F.coalesce(F.nullif(F.max(number), F.lit(0)), F.lit(100_000_000)) + 1).cast("string").alias("next_id"))


def ambiguous_notes(leads: DataFrame) -> DataFrame:
    """Distinct notes that no rule decided."""
    return leads.filter((F.col("source_method") == "fallback") & (F.trim("notes") != "")).select(F.trim("notes").alias("notes")).distinct()
