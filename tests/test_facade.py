import json

import pytest
from pyspark.sql import functions as F

from rollcall.facade import Engine
from rollcall.operators import dedupe, query, verdicts
from tests.test_ingest import AMA, NOW, leads_of

ROWS = [AMA, {**AMA, "First Name": "A.", "Email": "a.asante@acme.com"}, {**AMA, "First Name": "Kofi", "Last Name": "O'Neil", "Email": "k@o.com", "Phone Number": "+44 20 1234 5678", "Company Name": "A\\B 50%_x"}]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(leads_of(spark, *ROWS).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else leads_of(spark, *ROWS))


def test_views(engine):
    assert engine.health().first()["leads"] == 3
    page, total = engine.list(query.LeadFilters(owner="ADA"), 2)
    assert page.count() == 2 and total.first()["total"] == 3
    assert engine.detail("101").first()["given_name"] == "A." and engine.dashboard().count() > 2
    for bad in (lambda: engine.detail("nope"), lambda: engine.patch("nope", {"owner": "x"})):
        with pytest.raises(KeyError):
            bad()
    for bad in (lambda: engine.list(limit=0), lambda: engine.list(limit=201), lambda: engine.list(offset=-1), lambda: engine.list(query.LeadFilters(status="x")), lambda: engine.patch("100", {"id": "x"}), lambda: engine.duplicates(501)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("q, ids", [("o'neil", ["102"]), ("O'", ["102"]), ("a\\b", ["102"]), ("\\", ["102"]), ("50%_X", ["102"]), ("k_fi", ["102"]), ("ofi o%l", ["102"]), ("\u0001", []), ("''", []), ("_", ["100", "101", "102"])])
def test_free_text_takes_any_character(engine, q, ids):
    assert sorted(r["id"] for r in query.LeadFilters(q=q).apply(engine.leads).collect()) == ids


def test_changes(spark, engine, tmp_path):
    after = engine.patch("100", {"status": "closed won", "owner": " New  One "})
    row = after.detail("100").first()
    assert (row["status"], row["owner"]) == ("Closed Won", "New One") and engine.detail("100").first()["owner"] == "Ada"
    forms = spark.createDataFrame([(0, "Ama Asante", "ama@acme.com", "hello"), (1, "", "x", "")], "sub long, name string, email string, message string")
    new, outcomes, rejected = engine.ingest(forms, NOW)
    assert outcomes.first()["lead_id"] == "100" and rejected.count() == 1 and "hello" in new.detail("100").first()["notes"]
    engine.export(str(tmp_path / "out"), query.LeadFilters(q="kofi"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    got = engine.extract(spark.createDataFrame([("Referred by Dana Ortiz", 1)], "text string, id int")).first()
    assert (got["channel"], got["id"]) == ("Referral", 1)


def test_duplicates_and_adjudication(spark, engine, tmp_path):
    groups, review, stats = engine.duplicates()
    assert groups.first()["lead_ids"] == ["100", "101"] and stats.first()["groups"] == 1 and review.count() == 0

    class Client:
        def complete(self, system, user, schema):
            return json.dumps({"same_person": "O'Neil" in user, "confident": True, "reason": "r"}) if "Ama" in user else "no"

    pairs = spark.createDataFrame([("100", "102", ["why"]), ("101", "102", [])], "left_id string, right_id string, reasons array<string>")
    cache = str(tmp_path / "cache")
    told = {(r["left_id"], r["cached"]): r["verdict"] for r in verdicts.adjudicate_pairs(engine.leads, pairs, Client, cache).collect()}
    assert json.loads(told["100", False])["same_person"] is True and told["101", False] is None
    again = {(r["left_id"], r["cached"]) for r in verdicts.adjudicate_pairs(engine.leads, pairs, None, cache).collect()}
    assert again == {("100", True), ("101", True)}
    (tmp_path / "cache" / "part-bad.parquet").write_bytes(b"not parquet")
    assert {r["cached"] for r in verdicts.adjudicate_pairs(engine.leads, pairs, None, cache).collect()} == {True}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"not parquet")
    assert {r["verdict"] for r in verdicts.adjudicate_pairs(engine.leads, pairs, None, str(tmp_path / "broken")).collect()} == {None}
    noted = dedupe.annotate(pairs.withColumn("n", F.lit(1)), verdicts.adjudicate_pairs(engine.leads, pairs, Client))
    assert sorted(str(r["adjudication"]) for r in noted.collect()) == ["None", "llm: same person (confident) — r"]
