"""Record-shaped rows made from the driver's star-schema tables.  Not engine code.

One text of SQL that Spark and DuckDB read alike makes raw export rows from customers and form
submissions from suppliers, by arithmetic on keys and small literal word lists.  A third of the rows
shares identity keys with a neighbour, spellings and formats vary, and notes come from templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ("Ama", "Priya", "Rania", "Brina", "Jamal", "Jun", "Michael", "Mike", "Chris", "Christopher")
FAMILY = ("Asante", "Nair", "Foster", "Diallo", "Chen", "Smith", "Osei", "Rasmussen", "Rasmusen", "Lim", "Koh")
COUNTRIES = ("Singapore", "united kingdom", "UAE", "germany", "GHANA", "usa", "South  Korea", "uk")
STATUSES = ("New", "contacted", " CONNECTED ", "qualified", "Opportunity", "closed won", "CLOSED  LOST", "bogus")
SUFFIXES = ("Trading Pte Ltd", "Trading Co.", "Trading & Co", "Labs", "GmbH")

#: Note, rule, channel, evidence, detail: the last four are what the rules must say, written by hand.
NOTES = (
    ("Referred by Dana Ortiz, very keen", "referral", "Referral", "Referred by", "Referred by Dana Ortiz"),
    ("Warm intro from the board", "referral", "Referral", "Warm intro", "Warm introduction"),
    ("Met at our Web Summit 2026 booth, scanned the QR", "event", "Event", "Summit", "Web Summit 2026 — Booth QR Code"),
    ("Spoke at the Retail Expo, no QR scan logged", "event", "Event", "Expo", "Retail — Booth conversation (no QR scan)"),
    ("Came in by clicking a google ad on the pricing page", "paid_ad", "Other", "clicking a google ad", "Paid search (Google Ads) → Pricing page"),
    ("Google Ads click, landed on the homepage", "paid_ad", "Other", "Google Ads", "Paid search (Google Ads) → Homepage"),
    ("Sponsored post on Facebook", "paid_ad", "Other", "Sponsored", "Paid social (Facebook)"),
    ("Googled us and ended up on the book-a-demo page", "organic_search", "Organic Search", "Googled us", "Google search → Book-a-demo page"),
    ("Found us through an organic Bing search", "organic_search", "Organic Search", "Found us through an organic Bing search", "Bing search"),
    ("Sent a LinkedIn DM last week", "linkedin", "LinkedIn", "LinkedIn", "Inbound LinkedIn DM"),
    ("LinkedIn comment on launch news", "linkedin", "LinkedIn", "LinkedIn", "Comment on our LinkedIn post"),
    ("Added by sales from a cold list", "manual_sales", "Manual/Sales", "Added by sales", "Added by sales from a cold outreach list"),
    ("inbound phone call, wants pricing", "manual_sales", "Manual/Sales", "inbound phone call", "Added by sales after an inbound phone call"),
    ("Walked into our office on Monday", "other_explicit", "Other", "Walked into our office", "Walk-in at our office"),
    ("Other - Trade press Mention. Thanks", "other_explicit", "Other", "Other -", "Trade press mention"),
    ("Filled out the form on the pricing page", "website_form", "Website", "Filled out the form", "Pricing page — form submission"),
    ("Submitted the form", "website_form", "Website", "Submitted the form", "Website form submission"),
    ("Liked our post and left a comment", None, "Other", "our post and left a comment", None),
    ("possible duplicate, please check", None, "Other", None, None),
    ("", None, "Other", None, None),
)


def _pick(words, index: str, by: str = "|") -> str:
    return f"split_part('{by.join(w.replace(chr(39), chr(39) * 2) for w in words)}', '{by}', cast(({index}) % {len(words)} + 1 AS int))"


def _identity(k: str) -> str:
    return f"""
  SELECT {k} AS k, {k} - CASE WHEN {k} % 3 = 2 THEN 1 ELSE 0 END AS base"""


def _person(rows: str) -> str:
    return f"""
  SELECT {rows}.*, {_pick(GIVEN, 'base * 7')} AS g, {_pick(FAMILY, 'base')} AS f, 'corp' || cast(base % 1009 AS string) || '.example' AS domain,
         lpad(cast(base % 9999991 AS string), 7, '0') AS num FROM {rows}"""


#: Views customer and orders; a row for each customer.
RAW_SQL = f"""
WITH ids AS ({_identity('c_custkey')}, c_custkey FROM customer),
days AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY o_custkey),
who AS ({_person('ids')}),
shaped AS (
  SELECT who.*, year(d) AS y, month(d) AS m, day(d) AS dd,
         CASE k % 3 WHEN 0 THEN lower(g) || '.' || lower(f) WHEN 1 THEN lower(substr(g, 1, 1)) || '.' || lower(f) ELSE lower(g) || lower(substr(f, 1, 1)) END AS local
  FROM who LEFT JOIN days ON o_custkey = who.k)
SELECT cast(100000000 + k AS string) AS rid,
  CASE WHEN k % 10 = 9 THEN '' WHEN k % 9 = 2 THEN substr(g, 1, 1) || '.' ELSE g END AS first,
  CASE WHEN k % 10 = 9 THEN '' ELSE f END AS last,
  CASE WHEN k % 10 = 9 THEN g || '  ' || f ELSE '' END AS fullname,
  CASE WHEN k % 5 < 3 THEN 'Buyer' ELSE '' END AS title,
  f || ' ' || {_pick(SUFFIXES, 'k')} AS company,
  CASE WHEN k % 4 = 0 THEN upper(local || '@' || domain) || ' ' WHEN k % 31 = 7 THEN '' ELSE local || '@' || domain END AS email,
  CASE k % 4 WHEN 0 THEN '+65 8' || substr(num, 1, 3) || ' ' || substr(num, 4) WHEN 1 THEN '65-8' || num WHEN 2 THEN '0065 8' || num ELSE '(12)65 8' || num END AS phone,
  {_pick(COUNTRIES, 'base')} AS country, {_pick(STATUSES, 'k')} AS status,
  CASE WHEN k % 2 = 0 THEN 'Lead' ELSE '' END AS lifecycle, {_pick(('Marcus Wong ', 'Ada Bell', ''), 'k')} AS owner,
  CASE WHEN y IS NULL THEN '' WHEN k % 3 = 0 THEN cast(y AS string) || '-' || lpad(cast(m AS string), 2, '0') || '-' || lpad(cast(dd AS string), 2, '0')
       WHEN k % 3 = 1 THEN cast(y AS string) || '-' || lpad(cast(m AS string), 2, '0') || '-' || lpad(cast(dd AS string), 2, '0') || 'T00:00:00Z'
       ELSE cast(m AS string) || '/' || cast(dd AS string) || '/' || cast(y AS string) END AS created,
  CASE WHEN k % 6 = 0 THEN '2026-02-30' WHEN k % 6 = 1 THEN '6/4/2026' ELSE '' END AS modified,
  {_pick([n[0] for n in NOTES], 'k')} AS notes,
  CASE WHEN k % 7 = 0 THEN cast(k % 100 AS string) WHEN k % 7 = 1 THEN '7.0' ELSE '' END AS score
FROM shaped
"""

#: View supplier; a submission for each, that shares e-mail, phone, name or nothing with a customer.
FORM_SQL = f"""
WITH ids AS ({_identity('s_suppkey * 5')}, s_suppkey AS s FROM supplier),
who AS ({_person('ids')})
SELECT s AS sub, g || ' ' || f AS name,
  CASE WHEN s % 4 = 0 THEN CASE base % 3 WHEN 0 THEN lower(g) || '.' || lower(f) WHEN 1 THEN lower(substr(g, 1, 1)) || '.' || lower(f) ELSE lower(g) || lower(substr(f, 1, 1)) END || '@' || domain
       WHEN s % 17 = 3 THEN 'not-an-email' ELSE lower(g) || cast(s AS string) || '@new' || cast(s AS string) || '.example' END AS email,
  CASE WHEN s % 4 = 1 THEN '+65 8' || num ELSE '' END AS phone,
  CASE WHEN s % 3 = 0 THEN f || ' Trading Inc' ELSE '' END AS company,
  {_pick(COUNTRIES, 'base')} AS country,
  {_pick([n[0] for n in NOTES], 's')} AS message, 'f' || cast(s AS string) AS form_id,
  CASE WHEN s % 2 = 0 THEN 'Demo' ELSE '' END AS form_name, CASE WHEN s % 5 = 0 THEN '/pricing' ELSE '' END AS page_url,
  CASE WHEN s % 6 = 5 THEN '' ELSE '2026-0' || cast(s % 9 + 1 AS string) || '-15T10:00:00Z' END AS submitted_at
FROM who
"""

RAW_NAMES = {
    "rid": "Record ID", "first": "First Name", "last": "Last Name", "fullname": "Full Name", "title": "Job Title", "company": "Company Name", "email": "Email",
    "phone": "Phone Number", "country": "Country/Region", "status": "Lead Status", "lifecycle": "Lifecycle Stage", "owner": "Contact Owner", "created": "Create Date",
    "modified": "Last Modified Date", "notes": "Notes", "score": "Lead Score"}


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """The text over temporary views of its own names, so concurrent callers don't share views."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        text = text.replace(f" {t} ", f" {{{t}}} ").replace(f" {t})", f" {{{t}}})")
    return spark.sql(text, **frames)


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RAW_SQL.replace("FROM customer)", "FROM customer )"), "customer", "orders").withColumnsRenamed(RAW_NAMES)


def raw_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, FORM_SQL.replace("FROM supplier)", "FROM supplier )"), "supplier").withColumn("sub", F.col("sub").cast("long"))
