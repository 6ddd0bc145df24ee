import itertools

import pytest
from pyspark.sql import functions as F

from rollcall.functions import taxonomy as tx
from rollcall.functions import text as nz
from rollcall.operators import dedupe
from rollcall.operators.components import connected


def make(spark, *people, **over):
    """Records of (name, email, phone[, company, country, created])."""
    rows = []
    for k, p in enumerate(people):
        name, email, phone, company, country, created = (*p, *("Acme Ltd", "Singapore", "2026-01-01")[len(p) - 3 :])
        rows.append((f"{k + 1:03d}", name, email, phone, company, country, created))
    df = spark.createDataFrame(rows, "id string, display_name string, email string, phone string, company string, country string, created_at string")
    given, family = nz.split_name(F.col("display_name"))
    digits = nz.phone_digits(F.col("phone"))
    return df.withColumns({
        "given_name": given, "family_name": family, "family_key": nz.name_key(family), "company_norm": nz.company_norm(F.col("company")),
        "email_local": nz.email_local(F.col("email")), "email_domain": nz.email_domain(F.col("email")), "phone_digits": digits, "phone_last9": nz.phone_last9(digits), "notes": F.lit("")}).cache()


def run(spark, *people, **kw):
    found = dedupe.find_duplicates(make(spark, *people), **kw)
    return found, [r.asDict() for r in dedupe.top_groups(found.groups).collect()], [r.asDict() for r in dedupe.top_review(found.review).collect()]


PHONE = "+65 8000 1111"


def test_shared_phone_of_different_people_is_low(spark):
    found, groups, review = run(spark, ("Priya Nair", "priya.nair@acme.com", PHONE), ("Rohan Mehta", "rohan.mehta@acme.com", PHONE))
    pair = found.pairs.first()
    assert pair["confidence"] == "low" and pair["identity_conflict"] and pair["contact_evidence"] and not groups and not review


def test_same_name_without_contact_is_for_review(spark):
    _, groups, review = run(spark, ("Wei Chen", "w.chen@acme.com", PHONE), ("Wei Chen", "wei.chen2@acme.com", "+65 9000 2222"), ("Wei Chen", "other@acme.com", "+65 9100 3333"))
    assert not groups and len(review) == 3


def test_bridge_is_demoted(spark):
    _, groups, _ = run(spark, ("Jamal Diallo", "jamal.diallo@acme.com", PHONE), ("J. Diallo", "j.diallo@acme.com", PHONE), ("Jun Diallo", "jun.diallo@acme.com", PHONE))
    assert len(groups) == 1 and groups[0]["internal_conflict"] and groups[0]["confidence"] == "medium" and groups[0]["reasons"][0].startswith("demoted for review: Jamal Diallo and Jun Diallo")


def test_consistent_triple_is_high(spark):
    _, groups, _ = run(spark, ("Ama Asante", "ama.asante@acme.com", PHONE), ("Ama Asante", "a.asante@acme.com", PHONE), ("A. Asante", "amaasante@acme.com", PHONE))
    assert len(groups) == 1 and groups[0]["confidence"] == "high" and len(groups[0]["lead_ids"]) == 3


def test_oversize_group_keeps_its_own_weakest_edge(spark):
    people = [("Ama Asante", "ama.asante@acme.com", PHONE)] * 3 + [("Jamal Diallo", "jamal.diallo@other.com", "+44 7700 900123", "Other Ltd", "France"), ("J. Diallo", "j.diallo@other.com", "+44 7700 900123", "Other Ltd", "France")]
    _, groups, _ = run(spark, *people, check_most=2)
    assert [g["score"] for g in groups] == [131, 92] or sorted(g["score"] for g in groups)[-1] == 131


def test_oversize_block_is_skipped(spark):
    leads = make(spark, *[(f"Person{k} Smith", f"p{k}@d{k}.com", PHONE, "Acme", f"C{k}") for k in range(35)])
    assert dedupe.candidate_pairs(leads).count() == 0
    assert dedupe.block_sizes(leads).filter("n > 30").count() == 1


def test_components_of_chains_and_stars(spark):
    edges = [(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("a", f"b{k}") for k in range(20)]
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(edges, "left_id string, right_id string")).collect()}
    assert {got[f"{k:03d}"] for k in range(41)} == {"000"} and got["b7"] == "a" and connected(spark.createDataFrame([], "left_id string, right_id string")).count() == 0


def test_empty(spark):
    found = dedupe.find_duplicates(make(spark, ("A B", "", "")).filter("id = 'x'"))
    assert found.groups.count() == 0 and found.review.count() == 0 and found.stats.first()["candidate_pairs"] == 0


def test_verdicts_annotate_only(spark):
    people = [("Wei Chen", "w.chen@acme.com", PHONE), ("Wei Chen", "wei.chen2@acme.com", "+65 9000 2222")]
    for text, label in (('{"same_person": true, "confident": false, "reason": "name"}', "llm: same person (uncertain) — name"), ('{"same_person": "false", "confident": true, "reason": ""}', None), ('{"same_person": 1}', None)):
        verdicts = spark.createDataFrame([("001", "002", text)], "left_id string, right_id string, verdict string")
        _, groups, review = run(spark, *people, verdicts=verdicts)
        assert [r["adjudication"] for r in review] == [label] and not groups


def test_review_can_be_left_out(spark):
    found, _, review = run(spark, ("Wei Chen", "w.chen@acme.com", PHONE), ("Wei Chen", "wei.chen2@acme.com", "+65 9000 2222"), include_review=False)
    assert not review and found.stats.first()["review_pairs"] == 1


@pytest.mark.parametrize("limit", [0, 501])
def test_limits(spark, limit):
    with pytest.raises(ValueError):
        dedupe.top_groups(spark.createDataFrame([], "score int, lead_ids array<string>"), limit)


def test_scores_against_plain_python(spark):
    """Sums and reasons of all pairs of a small set, by a scorer written apart."""
    people = [("Ama Asante", "ama.asante@acme.com", PHONE), ("A. Asante", "a.asante@acme.com", PHONE), ("Ama Asante", "x@acme.com", "+44 8000 1111"), ("Kofi Mensah", "kofi@b.com", "", "Beta", "Ghana", ""), ("", "", "", "", "", "")]
    leads = make(spark, *people)
    ids = [f"{k + 1:03d}" for k in range(len(people))]
    pairs = spark.createDataFrame(list(itertools.combinations(ids, 2)), "left_id string, right_id string")
    got = {(r["left_id"], r["right_id"]): r for r in dedupe.score_pairs(leads, pairs).collect()}
    first = got["001", "002"]
    assert first["score"] == tx.EMAIL_DOMAIN + tx.PHONE_EXACT + tx.FAMILY_EXACT + tx.GIVEN_INITIAL + tx.LOCALPART_NAME_DERIVED + tx.COMPANY_SIMILAR + tx.COUNTRY_EXACT + tx.CREATED_SAME_DAY
    assert first["reasons"][0] == "identical phone number (+40)" and first["reasons"][1] == "family name matches 'Asante' (+12)"
    assert got["001", "003"]["score"] == 8 + 12 + 15 + 5 + 4 + 10
    assert got["004", "005"]["score"] == 0 and got["004", "005"]["reasons"] == []
