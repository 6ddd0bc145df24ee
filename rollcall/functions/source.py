"""Lead sources from free-text notes: an ordered rule table as one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import taxonomy as tx
from .text import blank

#: Unicode classes and case folding, and only \n ends a line: the meaning the patterns were written for.
ANY_CASE, EXACT_CASE = "(?iUd)", "(?Ud)"

# The patterns that results depend on.
RULES = (
    ("referral", "Referral", r"\breferred by\b|\bwarm intro\b|\bintroduced (?:to us )?by\b|\breferral from\b"),
    ("event", "Event", r"\bbooth\b|\bexpo\b|\bsummit\b|\bconference\b|\bcongress\b|\btrade\s?show\b|\bfestival\b|\bmeetup\b|\bwe met (?:them|him|her) at\b"),
    ("paid_ad", "Other", r"\bgoogle ads?\b|\badwords\b|\bpaid (?:ad|ads|search)\b|\bppc\b|\bsponsored\b|\bretarget\w*\b|clicking (?:an?|our|the)\s+\w*\s*ad\b"),
    ("organic_search", "Organic Search", r"\borganic\b[^.]{0,20}\bsearch\b|\bgoogled us\b|\bgoogle search\b|\bfound us\b[^.]{0,30}\b(?:google|search)\b|\bsearch engine\b|\bseo\b"),
    ("linkedin", "LinkedIn", r"\blinked-?in\b"),
    ("manual_sales", "Manual/Sales", r"\bmanual(?:ly)?\b|\badded by sales\b|\bcold (?:outreach|call|list)\b|\binbound phone call\b|\bphone call from\b"),
    ("other_explicit", "Other", r"\bwalked into our office\b|\bwalk-in\b|\binfo@\b|\bgeneral inbox\b|^\s*other\s*[-–—:]"),
    ("website_form", "Website", r"\bfilled (?:out|in) the form\b|\bform on the\b|\bsubmitted the form\b|\bcontact form\b|\bweb form\b|\brequested a demo on\b|\bbook-?a-?demo page\b"),
    ("unattributed_social", None, r"(?:our|the)\s+post\b[^.]{0,60}\bcomment|\bcomment\w*\b[^.]{0,60}(?:our|the)\s+post\b"),
)
PAGES = (
    r"\b(?:on|via|to)\s+(?:the\s+)?(blog post on [\w\- ]+?)(?=[.,]|\s+(?:before|after|then)\b|$)",
    r"\b(?:on|via|to)\s+(?:the\s+)?([\w\-]+(?:\s+[\w\-]+){0,2})\s+page\b",
    r"\b(?:on|via|to)\s+(?:the\s+)?(homepage)\b",
)
EVENTS = (
    r"\bat\s+(?:our|the)\s+(.+?)\s+booth\b",
    r"\bbooth\s+(?:at|during)\s+(?:the\s+)?([^,.]+)",
    r"\bat\s+(?:the\s+)?([^,.]+?)\s+(?:expo|summit|conference|congress|festival)\b",
)
REFERRER = r"\b(?:referred by|introduced (?:to us )?by|referral from)\s+([^,.;]+)"
GOOGLE_ADS = r"\bgoogle\s+ads?\b|\badwords\b|\bgoogle\s+adwords\b"
PAID_SEARCH = r"\bpaid search\b|\bppc\b|\bsem\b|\bsearch ads?\b"
PLATFORMS = (
    (r"\blinked-?in\b", "LinkedIn"), (r"\bfacebook\b|\bmeta ads?\b", "Facebook"), (r"\binstagram\b", "Instagram"),
    (r"\btiktok\b", "TikTok"), (r"\byoutube\b", "YouTube"), (r"\breddit\b", "Reddit"), (r"\btwitter\b|\bx\.com\b", "Twitter/X"))
ENGINES = (
    (r"\bgoogle\w*\b", "Google search"), (r"\bbing\b", "Bing search"), (r"\bduck\s?duck\s?go\b", "DuckDuckGo search"),
    (r"\byahoo\b", "Yahoo search"), (r"\byandex\b", "Yandex search"), (r"\bbaidu\b", "Baidu search"))
NO_QR = r"no qr\b|without (?:a |an )?qr|qr[^.]{0,20}not\b"
LINKEDIN_DM = r"\bdm\b|direct message|inmail"
OTHER_NAMED = r"\bother\s*[-–—:]\s*([^.]+)"

EXTRACTION = "struct<channel:string,detail:string,confidence:string,method:string,evidence:string,needs_review:boolean>"


def _has(text: Column, pattern: str, flags: str = ANY_CASE) -> Column:
    return text.rlike(flags + pattern)


def _group(text: Column, pattern: str) -> Column:
    """Group 1 as a clean fragment, null where the pattern doesn't match."""
    return F.when(_has(text, pattern), fragment(F.regexp_extract(text, ANY_CASE + pattern, 1)))


def fragment(c: Column) -> Column:
    """White space collapsed, and blanks and .,- gone at both ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "), F.lit(" .,-"))


def _first(text: Column, table, otherwise: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in table:
        out = out.when(_has(text, pattern), name)
    return out if otherwise is None else out.otherwise(otherwise)


def _named(text: Column, patterns, fits=lambda x: x != "") -> Column:
    """The first pattern's group 1 that is not blank and fits, null without one."""
    found = F.array(*(fragment(F.regexp_extract(text, ANY_CASE + p, 1)) for p in patterns))
    return F.get(F.filter(found, fits), F.lit(0))


def event(text: Column) -> Column:
    """The event a note names, of at most six words; null without one."""
    return _named(text, EVENTS, lambda x: (x != "") & (F.size(F.split(x, " ", -1)) <= 6))


def page_label(raw: Column) -> Column:
    """How a page is told, from the words that name it."""
    name = F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, F.lit(2), F.length(raw)))
    own = F.lower(raw).rlike(r"^(homepage$|blog post)")
    return F.when(own, name).otherwise(F.concat(name, F.lit(" page")))


def _with_page(base: Column, page: Column) -> Column:
    return F.coalesce(F.concat(base, F.lit(" → "), page), base)


def details(text: Column, page: Column, event: Column) -> dict[str, Column]:
    """The detail that each rule reports, given the page and the event that the note names."""
    low = F.lower(text)
    says = lambda *parts: F.greatest(*(F.contains(low, F.lit(p)) for p in parts)) if len(parts) > 1 else F.contains(low, F.lit(parts[0]))
    platform = _first(text, PLATFORMS)
    paid = F.when(_has(text, GOOGLE_ADS), "Paid search (Google Ads)").when(platform.isNotNull(), F.concat(F.lit("Paid social ("), platform, F.lit(")")))
    paid = paid.when(_has(text, PAID_SEARCH), "Paid search").otherwise("Paid advertising")
    talk = F.when(_has(low, NO_QR, EXACT_CASE), "Booth conversation (no QR scan)").when(says("qr"), "Booth QR Code").otherwise("Booth conversation")
    named = F.substring(_group(text, OTHER_NAMED), 1, tx.DETAIL_MOST)
    quoted = F.concat(F.upper(F.substring(named, 1, 1)), F.lower(F.substring(named, F.lit(2), F.length(named))))
    return {
        "referral": F.coalesce(F.concat(F.lit("Referred by "), _group(text, REFERRER)), F.lit("Warm introduction")),
        "event": F.coalesce(F.concat(event, F.lit(" — "), talk), talk),
        "paid_ad": _with_page(paid, page),
        "organic_search": _with_page(_first(text, ENGINES, F.lit("Organic search")), page),
        "linkedin": F.when(_has(low, LINKEDIN_DM, EXACT_CASE), "Inbound LinkedIn DM").when(says("comment"), "Comment on our LinkedIn post").when(says("connect"), "LinkedIn connection").otherwise("LinkedIn"),
        "manual_sales": F.when(says("cold"), "Added by sales from a cold outreach list").when(says("phone", "call"), "Added by sales after an inbound phone call").otherwise("Added manually by sales"),
        "other_explicit": F.when(says("walked into", "walk-in"), "Walk-in at our office").when(says("info@", "general inbox"), "General info@ inbox").otherwise(F.coalesce(quoted, F.lit("Other"))),
        "website_form": F.coalesce(F.concat(page, F.lit(" — form submission")), F.lit("Website form submission")),
    }


def stripped(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fallback(evidence: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(F.lit("Other").alias("channel"), nothing.alias("detail"), F.lit("low").alias("confidence"), F.lit("fallback").alias("method"), (nothing if evidence is None else evidence).alias("evidence"), F.lit(True).alias("needs_review"))


def with_extraction(df: DataFrame, notes: Column, out: str) -> DataFrame:
    """``df`` with the extraction of a note by rules alone: the first that matches wins, ambiguous ones
    fall back.  Steps are columns of their own, so no pattern is searched twice for one value."""
    text, rule = F.col("_text"), F.col("_rule")
    first = F.when(text == "", F.lit(None).cast("string"))
    for name, _, pattern in RULES:
        first = first.when(_has(text, pattern), name)
    df = df.withColumn("_text", stripped(notes)).withColumn("_rule", first)
    evidence, channel = (F.when(F.lit(False), F.lit("")) for _ in range(2))
    for name, own, pattern in RULES:
        evidence = evidence.when(rule == name, F.regexp_extract(text, ANY_CASE + pattern, 0))
        channel = channel.when(rule == name, F.lit(own).cast("string"))
    df = df.withColumns({
        "_evidence": evidence, "_channel": channel, "_raw": F.when(rule.isin("paid_ad", "organic_search", "website_form"), _named(text, PAGES)),
        "_event": F.when(rule == "event", event(text))}).withColumn("_page", page_label(F.col("_raw")))
    detail = F.when(F.lit(False), F.lit(""))
    for name, told in details(text, F.col("_page"), F.col("_event")).items():
        detail = detail.when(rule == name, told)
    sure = F.struct(F.col("_channel").alias("channel"), F.nullif(F.col("_detail"), F.lit("")).alias("detail"), F.lit("high").alias("confidence"),
                    F.concat(F.lit("rule:"), rule).alias("method"), F.col("_evidence").alias("evidence"), F.lit(False).alias("needs_review"))
    df = df.withColumn("_detail", detail).withColumn(out, F.when(F.col("_channel").isNotNull(), sure).otherwise(fallback(F.col("_evidence"))))
    return df.drop("_text", "_rule", "_evidence", "_channel", "_raw", "_event", "_page", "_detail")


def from_verdict(verdict: Column, evidence: Column, method: Column) -> Column:
    """An extraction from a validated verdict struct (channel, detail, confident); null off contract."""
    detail = F.substring(fragment(verdict["detail"]), 1, tx.DETAIL_MOST)
    sure = verdict["confident"]
    return F.when(verdict["channel"].isin(*tx.CHANNELS) & sure.isNotNull(), F.struct(
        verdict["channel"].alias("channel"), F.when(detail != "", detail).alias("detail"), F.when(sure, "medium").otherwise("low").alias("confidence"),
        method.alias("method"), evidence.alias("evidence"), (~sure).alias("needs_review")))


def stored(channel: Column, detail: Column, confidence: Column, method: Column, needs_review: Column) -> Column:
    """The extraction that a record holds, null without a channel."""
    return F.when(channel.isNotNull(), F.struct(
        channel.alias("channel"), detail.alias("detail"), F.coalesce(confidence, F.lit("low")).alias("confidence"),
        F.coalesce(method, F.lit("unknown")).alias("method"), F.lit(None).cast("string").alias("evidence"), F.coalesce(needs_review, F.lit(False)).alias("needs_review")))


def takes_over(held: Column, incoming: Column) -> Column:
    """Whether an incoming extraction replaces the held one: first touch stays once it is known."""
    weak = (held["confidence"] == "low") | held["needs_review"]
    return held.isNull() | (weak & (incoming["confidence"] != "low"))


def first_touch(held: Column, incoming: Column) -> Column:
    return F.when(takes_over(held, incoming), incoming).otherwise(held)
