import pytest
from pyspark.sql import functions as F

from rollcall.functions import source as src

NOTES = [
    ("Referred by Dana Ortiz, very keen", "Referral", "Referred by Dana Ortiz"), ("Warm intro from the board", "Referral", "Warm introduction"),
    ("Introduced to us by Lee.", "Referral", "Referred by Lee"),
    ("Spoke with them at our Web Summit 2026 booth, no QR scan logged", "Event", "Web Summit 2026 — Booth conversation (no QR scan)"),
    ("Scanned the QR at the SaaS Expo", "Event", "SaaS — Booth QR Code"), ("we met her at lunch, a meetup", "Event", "Booth conversation"),
    ("Came in by clicking a google ad", "Other", "Paid search (Google Ads)"), ("Sponsored LinkedIn post", "Other", "Paid social (LinkedIn)"), ("ppc visit", "Other", "Paid search"), ("retargeting banner", "Other", "Paid advertising"),
    ("Googled us and ended up on the book-a-demo page", "Organic Search", "Google search → Book-a-demo page"), ("organic search via the homepage", "Organic Search", "Organic search → Homepage"),
    ("found us by search, DuckDuckGo, on the blog post on lead scoring before signup", "Organic Search", "DuckDuckGo search → Blog post on lead scoring"),
    ("LinkedIn InMail", "LinkedIn", "Inbound LinkedIn DM"), ("Linked-In connect request", "LinkedIn", "LinkedIn connection"),
    ("manually added", "Manual/Sales", "Added manually by sales"), ("cold call", "Manual/Sales", "Added by sales from a cold outreach list"),
    ("Other — Trade Press MENTION. Thanks", "Other", "Trade press mention"), ("wrote to info@acme.com", "Other", "General info@ inbox"),
    ("requested a demo on the pricing page", "Website", "Pricing page — form submission"), ("web form", "Website", "Website form submission"),
]


def extract(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["s"] for r in src.with_extraction(df, F.col("t"), "s").orderBy("k").collect()]


def test_rules(spark):
    for (text, channel, detail), got in zip(NOTES, extract(spark, [n[0] for n in NOTES])):
        assert (got["channel"], got["detail"], got["confidence"], got["needs_review"]) == (channel, detail, "high", False), text


def test_restraint(spark):
    blank, none, social, unicode_word = extract(spark, [None, "just called", "They left a comment on our post", "ébooth"])
    assert blank["method"] == none["method"] == social["method"] == unicode_word["method"] == "fallback"
    assert social["evidence"] == "comment on our post" and blank["evidence"] is None and social["needs_review"]


@pytest.mark.parametrize("held, incoming, wins", [("low", "high", True), ("high", "high", False), ("low", "low", False), (None, "low", True)])
def test_first_touch(spark, held, incoming, wins):
    df = spark.createDataFrame([(held, incoming)], "h string, i string")
    old = src.stored(F.when(F.col("h").isNotNull(), "Event"), F.lit("x"), F.col("h"), F.lit("m"), F.lit(False))
    new = F.struct(F.lit("Website").alias("channel"), F.lit("y").alias("detail"), F.col("i").alias("confidence"), F.lit("n").alias("method"), F.lit(None).cast("string").alias("evidence"), F.lit(False).alias("needs_review"))
    assert df.select(src.first_touch(old, new).alias("s")).first()["s"]["channel"] == ("Website" if wins else "Event")
