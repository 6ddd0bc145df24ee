"""The engine's entry points over a table of records, with their limits and errors; no HTTP here.

Each returns a DataFrame, or raises: KeyError for an unknown id, ValueError for a bad argument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import source as src
from .functions import taxonomy as tx
from .operators import dedupe, ingest, query
from .sources import leads as io


@dataclass(frozen=True)
class Engine:
    """Records as a DataFrame of ``taxonomy.LEAD_COLUMNS``; calls that change them return new ones."""

    leads: DataFrame

    def health(self) -> DataFrame:
        """(status, leads): one row."""
        return query.count(self.leads).select(F.lit("ok").alias("status"), F.col("total").alias("leads"))

    def list(self, filters: query.LeadFilters = query.LeadFilters(), limit: int = tx.PAGE_SIZE, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """(a page in canonical order, one row with the total of all pages)."""
        found = filters.apply(self.leads)
        return query.page(found, limit, offset), query.count(found)

    def export(self, path: str, filters: query.LeadFilters = query.LeadFilters(), **how) -> None:
        io.write_export(query.ordered(filters.apply(self.leads)), path, **how)

    def detail(self, id_: str) -> DataFrame:
        found = query.lookup(self.leads, id_)
        if found.isEmpty():
            raise KeyError(f"no record {id_!r}")
        return found

    def patch(self, id_: str, changes: dict[str, str | None]) -> Engine:
        """After an edit of one record's status, owner or notes."""
        given = ingest.validated_patch(changes)
        self.detail(id_)
        row = self.leads.sparkSession.createDataFrame([(id_, *(given.get(c) for c in ingest.PATCHABLE))], "id string, " + ", ".join(f"{c} string" for c in ingest.PATCHABLE))
        return Engine(ingest.patch(self.leads, row))

    def extract(self, texts: DataFrame) -> DataFrame:
        """``texts`` (text and others) with channel, detail, confidence, method, evidence, needs_review."""
        return src.with_extraction(texts, F.col("text"), "_s").select(*texts.columns, "_s.*")

    def ingest(self, submissions: DataFrame, now: str) -> tuple[Engine, DataFrame, DataFrame]:
        """(the engine after them, outcomes, rejected) of raw submissions with their arrival number ``sub``."""
        accepted, rejected = io.valid_submissions(submissions)
        done = ingest.ingest(self.leads, io.project_submissions(accepted), now)
        return Engine(done.leads), done.outcomes, rejected

    def duplicates(self, limit: int = tx.GROUPS_SIZE, min_score: int | None = None, include_review: bool = True, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(groups by rank, review pairs, one row of statistics)."""
        found = dedupe.find_duplicates(self.leads, min_score, include_review, verdicts)
        return dedupe.top_groups(found.groups, limit), dedupe.top_review(found.review, limit), found.stats

    def dashboard(self) -> DataFrame:
        return query.dashboard(self.leads)
