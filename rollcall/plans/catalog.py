"""One query for each operator over the fixture's records, beside its DuckDB oracle."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import source as src
from ..functions import taxonomy as tx
from ..functions import text as nz
from ..operators import dedupe, ingest, query, verdicts
from ..operators.components import checkpoint_folder, connected, cut
from ..sources import leads as io
from . import fixture, oracle

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2026-11-01T00:00:00+00:00"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_PLAIN = [c for c in tx.LEAD_COLUMNS if c != "raw_record"]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.raw_leads(spark, sf_dir)


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.project_leads(_raw(spark, sf_dir))


def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.project_submissions(io.valid_submissions(fixture.raw_submissions(spark, sf_dir))[0])


def query_of(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def on_leads(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(_leads(spark, sf_dir))
    ORACLES[name] = sql


on_leads("lead_projection", oracle.leads(f"SELECT {', '.join(_PLAIN)} FROM lead"), lambda d: d.select(*_PLAIN))
on_leads("normalize_names", oracle.leads("SELECT id, display_name, given_name, family_name, family_key FROM lead"), lambda d: d.select("id", "display_name", "given_name", "family_name", "family_key"))
on_leads("normalize_contacts", oracle.leads("SELECT id, email, email_local, email_domain, phone_digits, phone_last9 FROM lead"), lambda d: d.select("id", "email", "email_local", "email_domain", "phone_digits", "phone_last9"))
on_leads("normalize_fields", oracle.leads("SELECT id, status, country, company_norm, lead_score, created_at, last_modified_at FROM lead"), lambda d: d.select("id", "status", "country", "company_norm", "lead_score", "created_at", "last_modified_at"))
on_leads("export_view", oracle.leads("SELECT " + ", ".join(f"coalesce({'upper(substr(CAST(' + c + ' AS VARCHAR), 1, 1)) || substr(CAST(' + c + ' AS VARCHAR), 2)' if c == 'source_needs_review' else f'CAST({c} AS VARCHAR)'}, '') AS {c}" for c in tx.EXPORT_COLUMNS) + " FROM lead"), io.export_view)
on_leads("lead_summary", oracle.leads("SELECT id, array_to_string(list_filter([CASE WHEN display_name = '' THEN '(no name)' ELSE display_name END, CASE WHEN company = '' THEN '(no company)' ELSE company END, email, phone], lambda x: x <> ''), ' | ') AS summary FROM lead"), lambda d: d.select("id", nz.summary(F.col("display_name"), F.col("company"), F.col("email"), F.col("phone")).alias("summary")))

on_leads("filter_status", oracle.leads("SELECT id, status FROM lead WHERE status = 'Closed Won'"), lambda d: query.LeadFilters(status=" closed  WON").apply(d).select("id", "status"))
on_leads("filter_owner", oracle.leads("SELECT id, owner FROM lead WHERE lower(owner) = 'marcus wong'"), lambda d: query.LeadFilters(owner="Marcus  WONG ").apply(d).select("id", "owner"))
on_leads("filter_country", oracle.leads("SELECT id, country FROM lead WHERE lower(country) = 'south korea'"), lambda d: query.LeadFilters(country="south korea").apply(d).select("id", "country"))
on_leads("filter_q", oracle.leads("SELECT id FROM lead WHERE lower(display_name) LIKE '%ike f_ster%' OR lower(company) LIKE '%ike f_ster%' OR lower(email) LIKE '%ike f_ster%'"), lambda d: query.LeadFilters(q="ike F_ster").apply(d).select("id"))
_ODD = "replace(replace(display_name, 'Osei', 'O''Sei'), 'Lim', 'L_m')", "replace(company, 'Labs', 'Labs\\100%')"


def _odd(d: DataFrame) -> DataFrame:
    """Names and companies with quotes, wild cards and backslashes."""
    name = F.replace(F.replace("display_name", F.lit("Osei"), F.lit("O'Sei")), F.lit("Lim"), F.lit("L_m"))
    return d.withColumns({"display_name": name, "company": F.replace("company", F.lit("Labs"), F.lit("Labs\\100%"))})


for _name, _q in (("quote", "o'sei"), ("backslash", "labs\\1"), ("wild", "l_m"), ("percent", "labs%100"), ("quotes", "''")):
    on_leads(f"filter_q_{_name}", oracle.leads(f"SELECT id, n AS display_name, c AS company FROM (SELECT id, email, {_ODD[0]} AS n, {_ODD[1]} AS c FROM lead) WHERE " + " OR ".join(f"lower({x}) LIKE '%{_q.replace(chr(39), chr(39) * 2)}%'" for x in ("n", "c", "email"))), lambda d, q=_q: query.LeadFilters(q=q.upper()).apply(_odd(d)).select("id", "display_name", "company"))
on_leads("filter_combined", oracle.leads("SELECT id FROM lead WHERE status = 'New' AND lower(country) = 'singapore' AND (lower(display_name) LIKE '%a%' OR lower(company) LIKE '%a%' OR lower(email) LIKE '%a%')"), lambda d: query.LeadFilters(status="new", country="SINGAPORE", q="a").apply(d).select("id"))
on_leads("page_first", oracle.leads("SELECT id, created_at FROM lead ORDER BY created_at IS NULL, created_at DESC, id LIMIT 50"), lambda d: query.page(d).select("id", "created_at"))
on_leads("page_deep", oracle.leads("SELECT id, created_at FROM lead ORDER BY created_at IS NULL, created_at DESC, id LIMIT 25 OFFSET 100"), lambda d: query.page(d, 25, 100).select("id", "created_at"))
on_leads("page_after_key", oracle.leads("SELECT id, created_at FROM lead WHERE created_at IS NULL OR created_at < '1995-06-01' OR (created_at = '1995-06-01' AND id > '100000100') ORDER BY created_at IS NULL, created_at DESC, id LIMIT 50"), lambda d: query.page_after(d, "1995-06-01", "100000100").select("id", "created_at"))
on_leads("point_lookup", oracle.leads("SELECT id, display_name, email FROM lead WHERE id = '100000042'"), lambda d: query.lookup(d, "100000042").select("id", "display_name", "email"))

on_leads("count_leads", oracle.leads("SELECT count(*) AS total FROM lead"), query.count)
on_leads("dashboard", oracle.leads("""SELECT 'status' AS kind, coalesce(status, 'Unknown') AS value, count(*) AS n FROM lead GROUP BY ALL
UNION ALL SELECT 'channel', coalesce(source_channel, 'Unknown'), count(*) FROM lead GROUP BY ALL
UNION ALL SELECT 'total', 'all', count(*) FROM lead UNION ALL SELECT 'needs_review', 'all', count(*) FILTER (source_needs_review) FROM lead"""), query.dashboard)
on_leads("next_id", oracle.leads("SELECT CAST(max(CAST(id AS BIGINT)) + 1 AS VARCHAR) AS next_id FROM lead"), query.next_id)
on_leads("ambiguous_notes", oracle.leads("SELECT DISTINCT notes FROM lead WHERE source_method = 'fallback' AND notes <> ''"), query.ambiguous_notes)

on_leads("source_extraction", oracle.leads("SELECT id, source_channel AS channel, source_detail AS detail, source_confidence AS confidence, source_method AS method, evidence, source_needs_review AS needs_review FROM lead"), lambda d: src.with_extraction(d.select("id", "notes"), F.col("notes"), "s").select("id", "s.*"))


def _first_touch(d: DataFrame) -> DataFrame:
    held = d.select("id", src.stored(*(F.col(f"source_{c}") for c in ("channel", "detail", "confidence", "method", "needs_review"))).alias("held"))
    new = src.with_extraction(d.select((F.col("id").cast("long") - 1).cast("string").alias("id"), "notes"), F.col("notes"), "incoming")
    return held.join(new.drop("notes"), "id").select("id", src.first_touch(F.col("held"), F.col("incoming")).alias("s")).select("id", "s.channel", "s.method")


on_leads("first_touch", oracle.leads("""SELECT a.id, CASE WHEN a.source_needs_review AND NOT b.source_needs_review THEN b.source_channel ELSE a.source_channel END AS channel,
CASE WHEN a.source_needs_review AND NOT b.source_needs_review THEN b.source_method ELSE a.source_method END AS method FROM lead a JOIN lead b ON CAST(b.id AS BIGINT) = CAST(a.id AS BIGINT) + 1"""), _first_touch)

on_leads("blocking_keys", oracle.keys("SELECT id, kind, value FROM keyed"), dedupe.keyed)
on_leads("block_sizes", oracle.keys("SELECT kind, value, n FROM sizes"), dedupe.block_sizes)
on_leads("candidate_pairs", oracle.keys("SELECT left_id, right_id FROM cand"), dedupe.candidate_pairs)
on_leads("blocking_stats", oracle.keys("""SELECT (SELECT count(*) FROM lead) AS lead_count, (SELECT CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) FROM lead) AS brute_force_pairs, (SELECT count(*) FROM cand) AS candidate_pairs,
round((SELECT count(*) * (count(*) - 1) / 2 FROM lead) / (SELECT count(*) FROM cand), 1) AS reduction_factor, (SELECT count(*) FROM sizes) AS blocks, (SELECT count(*) FROM sizes WHERE n > 30) AS oversized_blocks"""), lambda d: dedupe.blocking_stats(d, dedupe.candidate_pairs(d)))


def _scores(d: DataFrame) -> DataFrame:
    return dedupe.scored_candidates(d)


on_leads("pair_scores", oracle.pairs("SELECT left_id, right_id, score, confidence, identity_conflict, contact_evidence FROM scored"), lambda d: _scores(d).select("left_id", "right_id", "score", "confidence", "identity_conflict", "contact_evidence"))
on_leads("band_histogram", oracle.pairs("SELECT confidence, count(*) AS n, min(score) AS least, max(score) AS most FROM scored GROUP BY ALL"), lambda d: dedupe.band_histogram(_scores(d)))
on_leads("review_pairs", oracle.pairs("SELECT left_id, right_id, score FROM scored WHERE confidence = 'medium'"), lambda d: dedupe.find_duplicates(d).review.select("left_id", "right_id", "score"))
on_leads("components", oracle.pairs("SELECT id, component FROM comp", oracle.COMPONENTS.rstrip(", "), True), lambda d: connected(_scores(d).filter("confidence = 'high'")))
on_leads("duplicate_groups", oracle.pairs("SELECT lead_ids, score, CASE WHEN internal_conflict THEN 'medium' ELSE weakest END AS confidence, internal_conflict FROM grp JOIN ids USING (component)", oracle.GROUPS, True), lambda d: dedupe.find_duplicates(d).groups.select(F.array_join("lead_ids", ",").alias("lead_ids"), "score", "confidence", "internal_conflict"))
on_leads("top_groups", oracle.pairs("SELECT lead_ids, score FROM grp JOIN ids USING (component) ORDER BY score DESC, lead_ids LIMIT 50", oracle.GROUPS, True), lambda d: dedupe.top_groups(dedupe.find_duplicates(d).groups).select(F.array_join("lead_ids", ",").alias("lead_ids"), "score"))
on_leads("dedupe_stats", oracle.pairs("SELECT count(*) FILTER (confidence = 'high') AS high_confidence_pairs, count(*) FILTER (confidence = 'medium') AS review_pairs, (SELECT count(*) FROM ids) AS groups, (SELECT CAST(sum(n) AS BIGINT) FROM ids) AS leads_in_groups FROM scored", oracle.GROUPS, True), lambda d: dedupe.find_duplicates(d).stats.select("high_confidence_pairs", "review_pairs", "groups", "leads_in_groups"))
_REFERENCE = "SELECT a.id AS left_id, b.id AS right_id FROM lead a JOIN lead b USING (phone_digits, email_domain) WHERE a.id < b.id AND phone_digits <> '' AND email_domain <> ''"
on_leads("reference_pairs", oracle.leads(_REFERENCE), dedupe.reference_pairs)
on_leads("lookalike_pairs", oracle.leads("SELECT a.id AS left_id, b.id AS right_id FROM lead a JOIN lead b USING (email_domain, family_key) WHERE a.id < b.id AND email_domain <> '' AND family_key <> '' AND a.phone_digits <> b.phone_digits"), dedupe.lookalike_pairs)
on_leads("reference_recovered", oracle.keys(f"SELECT count(*) AS expected, count(c.left_id) AS recovered FROM ({_REFERENCE}) e LEFT JOIN cand c USING (left_id, right_id)"), lambda d: dedupe.recovered(dedupe.reference_pairs(d), dedupe.candidate_pairs(d)))
on_leads("flagged_recall", oracle.pairs("SELECT count(*) AS flagged, count(*) FILTER (id IN (SELECT left_id FROM scored WHERE confidence <> 'low' UNION SELECT right_id FROM scored WHERE confidence <> 'low')) AS surfaced FROM lead WHERE contains(lower(notes), 'possible duplicate')"), lambda d: dedupe.flagged_recall(d, _scores(d)))


def _patched(d: DataFrame) -> DataFrame:
    k = F.col("id").cast("long")
    changes = d.filter(k % 10 == 0).select("id", F.when(k % 20 == 0, " closed won ").alias("status"), F.when(k % 30 == 0, "  New   Owner").alias("owner"), F.when(k % 40 == 0, F.lit("Referred by Lee Park")).alias("notes"))
    return ingest.patch(d, changes).select("id", "status", "owner", "notes", "source_channel", "source_detail", "source_method")


on_leads("patch", oracle.leads("""SELECT id, CASE WHEN CAST(id AS BIGINT) % 20 = 0 THEN 'Closed Won' ELSE status END AS status, CASE WHEN CAST(id AS BIGINT) % 30 = 0 THEN 'New Owner' ELSE owner END AS owner,
CASE WHEN CAST(id AS BIGINT) % 40 = 0 THEN 'Referred by Lee Park' ELSE notes END AS notes, CASE WHEN CAST(id AS BIGINT) % 40 = 0 AND source_needs_review THEN 'Referral' ELSE source_channel END AS source_channel,
CASE WHEN CAST(id AS BIGINT) % 40 = 0 AND source_needs_review THEN 'Referred by Lee Park' ELSE source_detail END AS source_detail, CASE WHEN CAST(id AS BIGINT) % 40 = 0 AND source_needs_review THEN 'rule:referral' ELSE source_method END AS source_method FROM lead"""), _patched)
on_leads("update_fields", oracle.leads("SELECT id, CASE WHEN lead_score > 50 THEN 'top' ELSE owner END AS owner, job_title FROM lead"), lambda d: io.update_fields(d, d.filter("lead_score > 50").select("id", F.lit("top").alias("owner"))).select("id", "owner", "job_title"))
on_leads("prompt_fence", oracle.leads("SELECT id, '<note>' || chr(10) || notes || chr(10) || '</note>' AS fenced FROM lead"), lambda d: d.select("id", verdicts.fence("note", F.concat(F.lit("</ note >"), F.col("notes"), F.lit("<NOTE/> "))).alias("fenced")))
on_leads("cache_key", oracle.leads("SELECT id, substr(sha256('m' || chr(0) || 's' || chr(0) || 'sys' || chr(0) || notes), 1, 32) AS key FROM lead"), lambda d: d.select("id", verdicts.cache_key(F.lit("sys"), F.col("notes"), F.lit("m"), F.lit("s")).alias("key")))


def _verdicts(d: DataFrame) -> DataFrame:
    k = F.col("id").cast("long") % 5
    text = F.when(k == 0, '{"channel": "Referral", "detail": null, "confident": true, "more": 1}').when(k == 1, '{"channel": "Referral", "detail": "x", "confident": "false"}')
    text = text.when(k == 2, '```json\n{"channel": "Event", "detail": "Expo", "confident": false}\n```').when(k == 3, '{"channel": "Radio", "detail": null, "confident": true}').otherwise("no answer")
    return d.select("id", verdicts.source_verdict(text).alias("v")).select("id", "v.channel", "v.detail", "v.confident")


on_leads("verdict_contract", oracle.leads("SELECT id, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'Referral' WHEN 2 THEN 'Event' END AS channel, CASE CAST(id AS BIGINT) % 5 WHEN 2 THEN 'Expo' END AS detail, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN true WHEN 2 THEN false END AS confident FROM lead"), _verdicts)


_COVERED = (("rid", "Record ID"), ("first", "First Name"), ("last", "Last Name"), ("fullname", "Full Name"), ("title", "Job Title"), ("company", "Company Name"), ("email", "Email"), ("phone", "Phone Number"), ("country", "Country/Region"),
            ("status", "Lead Status"), ("lifecycle", "Lifecycle Stage"), ("owner", "Contact Owner"), ("created", "Create Date"), ("modified", "Last Modified Date"), ("notes", "Notes"), ("score", "Lead Score"))


@query_of("WITH raw AS (" + fixture.RAW_SQL + "), c AS (" + " UNION ALL ".join(f"SELECT '{name}' AS column_name, count(*) FILTER ({oracle.ws(c)} <> '') AS n, count(*) AS total FROM raw" for c, name in _COVERED) + ") SELECT column_name, n, CASE WHEN n = 0 THEN 'empty' WHEN n < 0.6 * total THEN 'sparse' ELSE 'filled' END AS state FROM c")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.coverage(_raw(spark, sf_dir))


_SUB = ("display_name", "given_name", "family_name", "family_key", "company", "company_norm", "email", "email_local", "email_domain", "phone", "phone_digits", "phone_last9", "country", "created_at")


@query_of(f"WITH {oracle._note_table()}, {oracle.SUBS} SELECT sub, {', '.join(_SUB)}, source_channel, source_method FROM sub")
def submission_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subs(spark, sf_dir).select("sub", *(F.col(f"lead.{c}") for c in _SUB), F.col("source.channel").alias("source_channel"), F.col("source.method").alias("source_method"))


@query_of(f"WITH form AS ({fixture.FORM_SQL}) SELECT CAST(sub AS BIGINT) AS sub, email FROM form WHERE NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')")
def submission_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.valid_submissions(fixture.raw_submissions(spark, sf_dir))[1].select("sub", "email")


@query_of(oracle.match("SELECT sub, id, probe FROM probed"))
def ingest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.candidates(_leads(spark, sf_dir), _subs(spark, sf_dir))


@query_of(oracle.match("SELECT sub, matched_id, matched_by, score, confidence, coalesce(dups, '') AS duplicates FROM sub LEFT JOIN picked USING (sub) LEFT JOIN dups USING (sub)"))
def ingest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.match(_leads(spark, sf_dir), _subs(spark, sf_dir))
    return found.select("sub", "matched_id", "matched_by", "score", "confidence", F.array_join(F.transform("possible_duplicates", lambda d: d["id"]), ",").alias("duplicates"))


@query_of(oracle.match("""SELECT sub, matched_id, CASE WHEN e.company = '' THEN i.company ELSE e.company END AS company, CASE WHEN e.country = '' THEN i.country ELSE e.country END AS country,
CASE WHEN e.phone = '' THEN i.phone ELSE e.phone END AS phone, e.email, least(e.created_at, i.created_at) AS created_at, coalesce(i.created_at, e.last_modified_at) AS last_modified_at,
CASE WHEN e.source_needs_review AND NOT i.source_needs_review THEN i.source_channel ELSE e.source_channel END AS source_channel
FROM picked JOIN sub i USING (sub) JOIN lead e ON e.id = matched_id"""))
def ingest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads, subs = _leads(spark, sf_dir), _subs(spark, sf_dir)
    found = subs.join(ingest.matched(leads, subs).filter("matched_id IS NOT NULL"), "sub")
    rows = leads.select(F.col("id").alias("matched_id"), F.struct(*tx.LEAD_COLUMNS).alias("held"))
    kept = ("company", "country", "phone", "email", "created_at", "last_modified_at", "source_channel")
    return ingest.merged(found.join(rows, "matched_id"), NOW).select("sub", "matched_id", *(F.col(f"record.{c}") for c in kept))


@query_of(oracle.match("""SELECT sub, display_name, email, 'New' AS status, 'Lead' AS lifecycle_stage, coalesce(created_at, '2026-11-01') AS created_at, source_channel,
'[' || CASE WHEN submitted_at = '' THEN '2026-11-01' ELSE substr(submitted_at, 1, 10) END || ' · web form' || CASE WHEN form_name <> '' THEN ' · "' || form_name || '"' ELSE '' END || CASE WHEN page_url <> '' THEN ' · ' || page_url ELSE '' END || '] ' || CASE WHEN message = '' THEN '(no message)' ELSE message END AS notes
FROM sub WHERE sub NOT IN (SELECT sub FROM picked)"""))
def ingest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads, subs = _leads(spark, sf_dir), _subs(spark, sf_dir)
    found = subs.join(ingest.matched(leads, subs).filter("matched_id IS NULL").select("sub"), "sub").withColumn("new_id", F.lit("x"))
    return ingest.created(found, NOW).select("sub", *(F.col(f"record.{c}") for c in ("display_name", "email", "status", "lifecycle_stage", "created_at", "source_channel", "notes")))


@query_of()
def ingest_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All submissions in order; no SQL form, held against a sequential fold in the tests."""
    return ingest.ingest(_leads(spark, sf_dir), _subs(spark, sf_dir), NOW).outcomes.select("sub", "action", "lead_id", "matched_by", "score", "confidence")


@query_of(oracle.pairs("SELECT left_id, right_id, score, array_to_string(told, '; ') AS reasons FROM said", oracle.REASONS))
def pair_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained scores: the texts in the order shown."""
    return _scores(_leads(spark, sf_dir)).select("left_id", "right_id", "score", F.array_join("reasons", "; ").alias("reasons"))


def _shared(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query_of(ORACLES["lead_projection"])
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows written as a CSV export, read by the scan and projected."""
    raw, folder = _raw(spark, sf_dir), _shared(spark, "csv")
    raw.write.csv(folder, header=True, quote='"', escape='"', emptyValue="")
    columns = [c for c in tx.RAW_COLUMNS if c in raw.columns]
    kept = spark.read.csv(folder, schema=raw.select(*raw.columns).schema, header=True, multiLine=True, quote='"', escape='"')
    return io.project_leads(kept.select(*(F.col(f"`{c}`") for c in columns))).select(*_PLAIN)


@query_of(ORACLES["lead_projection"])
def load_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV export bulk-loaded into a table of records, and the table's rows."""
    raw, folder, target = _raw(spark, sf_dir), _shared(spark, "export"), _shared(spark, "table")
    raw.select(*((F.col(f"`{c}`") if c in raw.columns else F.lit("")).alias(c) for c in tx.RAW_COLUMNS)).write.csv(folder, header=True, quote='"', escape='"', emptyValue="")
    io.load(spark, folder, target)
    return spark.read.parquet(target).select(*_PLAIN)


@query_of(ORACLES["submission_rejects"].replace("CAST(sub AS BIGINT) AS sub, email", "name, email, form_id"))
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions written as JSON lines, read by the scan and validated: those rejected."""
    folder = _shared(spark, "json")
    fixture.raw_submissions(spark, sf_dir).drop("sub").write.json(folder)
    return io.valid_submissions(io.read_submissions(spark, folder, lines=True))[1].select("name", "email", "form_id")


@query_of(oracle.leads("SELECT id, email FROM lead UNION ALL SELECT 'n' || id, 'new@' || id || '.example' FROM lead WHERE CAST(id AS BIGINT) % 50 = 0"))
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _leads(spark, sf_dir)
    more = d.filter(F.col("id").cast("long") % 50 == 0).withColumns({"email": F.concat(F.lit("new@"), "id", F.lit(".example")), "id": F.concat(F.lit("n"), "id")})
    return io.insert(d, more).select("id", "email")


class _Judge:
    """A client without a model: the same person where the two fenced e-mails are of one domain."""

    def complete(self, system: str, user: str, schema: str) -> str | None:
        domains = re.findall(r"email: \S*@(\S+)", user)
        same = len(domains) == 2 and domains[0] == domains[1]
        return json.dumps({"same_person": same, "confident": same, "reason": "domains"})


@query_of(oracle.pairs("SELECT left_id, right_id, 'llm: ' || CASE WHEN a.email_domain <> '' AND a.email_domain = b.email_domain THEN 'same person (confident)' ELSE 'different people (uncertain)' END || ' — domains' AS adjudication FROM scored JOIN lead a ON a.id = left_id JOIN lead b ON b.id = right_id WHERE confidence = 'medium'"))
def adjudicated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review pairs with the verdicts of an injected client."""
    leads = _leads(spark, sf_dir)
    review = cut(dedupe.find_duplicates(leads).review)
    return dedupe.annotate(review.drop("adjudication"), verdicts.adjudicate_pairs(leads, review, _Judge)).select("left_id", "right_id", "adjudication")
