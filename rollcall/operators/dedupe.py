"""Likely duplicates: blocking on several keys, additive explainable scores, groups and review pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..functions import text as nz
from .components import connected, cut
from .verdicts import pair_verdict

SCORED = (
    "id", "display_name", "given_name", "family_name", "family_key", "company", "company_norm", "email", "email_local", "email_domain",
    "phone", "phone_digits", "phone_last9", "country", "created_at")
SIGNAL = "struct<ord:int,name:string,points:int,reason:string>"


FOLDED = ("given_key", "_local", "_given", "_family")


def scoring_view(leads: DataFrame, *carried: str) -> DataFrame:
    """The columns that blocking and scoring read, with folded keys made once for each record; a view
    of a view is the same."""
    if set(FOLDED) <= set(leads.columns):
        return leads.select(*SCORED, *FOLDED, *carried)
    at = leads.select(*SCORED, *carried)
    return at.withColumns({
        "given_key": nz.name_key(F.col("given_name")), "_local": nz.compact(F.col("email_local")),
        "_given": nz.compact(F.col("given_name")), "_family": nz.compact(F.col("family_name"))})


def blocking_keys() -> Column:
    """Keys of a record, in order; the family key stays even where initial or country is blank."""
    key = lambda kind, when, value: F.struct(F.lit(kind).alias("kind"), F.when(when, value).alias("value"))
    join = lambda *c: F.concat_ws("|", *c)
    has = lambda c: F.col(c) != ""
    return F.filter(F.array(
        key("email", has("email"), F.col("email")), key("phone", has("phone_last9"), F.col("phone_last9")),
        key("domain_family", has("email_domain") & has("family_key"), join("email_domain", "family_key")),
        key("family_initial_country", has("family_key"), join("family_key", F.lower(F.substring("given_name", 1, 1)), F.lower("country"))),
    ), lambda k: k["value"].isNotNull())


def keyed(leads: DataFrame) -> DataFrame:
    """(id, kind, value): a row for each record and blocking key."""
    return leads.select("id", F.explode(blocking_keys()).alias("k")).select("id", "k.kind", "k.value")


def block_sizes(leads: DataFrame) -> DataFrame:
    """(kind, value, n): counted before anything is joined, with partial aggregation."""
    return keyed(leads).groupBy("kind", "value").agg(F.count("*").alias("n"))


def candidate_pairs(leads: DataFrame, most: int = tx.BLOCK_MOST) -> DataFrame:
    """(left_id, right_id), left before right: pairs that share a block of 2 to ``most`` records.

    Larger blocks are bad keys and skipped, by definition of the operator; ``block_sizes`` tells
    which.  Their rows go with an anti-skew join against the thin table of usable blocks."""
    keys = keyed(leads)
    usable = block_sizes(leads).filter((F.col("n") >= 2) & (F.col("n") <= most)).select("kind", "value")
    blocked = keys.join(usable, ["kind", "value"])
    right = blocked.withColumnRenamed("id", "right_id")
    pairs = blocked.withColumnRenamed("id", "left_id").join(right, ["kind", "value"]).filter("left_id < right_id")
    return pairs.select("left_id", "right_id").distinct()


def blocking_stats(leads: DataFrame, pairs: DataFrame, most: int = tx.BLOCK_MOST) -> DataFrame:
    """One row: lead_count, brute_force_pairs, candidate_pairs, reduction_factor, blocks, oversized_blocks."""
    n = leads.agg(F.count("*").alias("lead_count"))
    blocks = block_sizes(leads).agg(F.count("*").alias("blocks"), F.count_if(F.col("n") > most).alias("oversized_blocks"))
    found = pairs.agg(F.count("*").alias("candidate_pairs"))
    one = n.join(blocks, F.lit(True)).join(found, F.lit(True))  # single rows
    brute = (F.col("lead_count") * (F.col("lead_count") - 1) / 2).cast("long")
    return one.select("lead_count", brute.alias("brute_force_pairs"), "candidate_pairs", F.when(F.col("candidate_pairs") > 0, F.bround(brute / F.col("candidate_pairs"), 1)).alias("reduction_factor"), "blocks", "oversized_blocks")


def _quote(c: Column) -> Column:
    return F.when(nz.blank(c) == "", "(blank)").otherwise(F.concat(F.lit("'"), c, F.lit("'")))


def signals(l: Column, r: Column, given: Column, family: Column, local_ratio: Column) -> Column:
    """What speaks for or against one person, in order of emission, of two scoring rows."""
    same = lambda c: (l[c] != "") & (l[c] == r[c])
    none = F.lit(None).cast(SIGNAL)

    def signal(order: int, *cases: tuple[str, Column, int, Column]) -> Column:
        out = F.when(F.lit(False), none)
        for name, when, points, reason in cases:
            out = out.when(when, F.struct(F.lit(order).alias("ord"), F.lit(name).alias("name"), F.lit(points).alias("points"), reason.alias("reason")))
        return out

    said = lambda words, *cs: F.concat(F.lit(words), *cs)
    both = lambda c: F.concat(F.lit(" ("), _quote(l[c]), F.lit(" / "), _quote(r[c]), F.lit(")"))
    longer = lambda raw, key: F.when(F.length(r[raw]) > F.length(l[raw]), r[key]).otherwise(l[key])
    g, f = longer("given_name", "_given"), longer("family_name", "_family")
    locals_ = ~same("email") & (l["email_local"] != "") & (r["email_local"] != "")
    derived = locals_ & nz.local_from_name(l["_local"], g, f) & nz.local_from_name(r["_local"], g, f)
    every = F.array(
        signal(1, ("email_exact", same("email"), tx.EMAIL_EXACT, said("identical email ", _quote(l["email"]))),
               ("email_domain", same("email_domain"), tx.EMAIL_DOMAIN, said("same email domain ", _quote(l["email_domain"])))),
        signal(2, ("phone_exact", same("phone_digits"), tx.PHONE_EXACT, F.lit("identical phone number")),
               ("phone_last9", same("phone_last9"), tx.PHONE_LAST9, F.lit("phone numbers agree apart from country-code formatting"))),
        signal(3, ("family_exact", family == "exact", tx.FAMILY_EXACT, said("family name matches ", _quote(l["family_name"]))),
               ("family_similar", family == "similar", tx.FAMILY_SIMILAR, said("family names differ by a likely typo", both("family_name"))),
               ("family_conflict", family == "conflict", tx.FAMILY_CONFLICT, said("family names differ", both("family_name")))),
        signal(4, ("given_exact", given == "exact", tx.GIVEN_EXACT, said("given name matches ", _quote(l["given_name"]))),
               ("given_prefix", given == "prefix", tx.GIVEN_PREFIX, said("one given name is a shortening of the other", both("given_name"))),
               ("given_initial", given == "initial", tx.GIVEN_INITIAL, said("given name initial is compatible", both("given_name"))),
               ("given_conflict", given == "conflict", tx.GIVEN_CONFLICT, said("given names differ", both("given_name")))),
        signal(5, ("localpart_name_derived", derived, tx.LOCALPART_NAME_DERIVED, said("both email local parts spell the same person", both("email_local"))),
               ("localpart_similar", locals_ & (local_ratio >= tx.LOCALPART_SIMILAR_FROM), tx.LOCALPART_SIMILAR, F.lit("email local parts are similar"))),
        signal(6, ("company_similar", (l["company_norm"] != "") & (r["company_norm"] != "") & (nz.overlap(l["company_norm"], r["company_norm"]) >= tx.COMPANY_SIMILAR_FROM), tx.COMPANY_SIMILAR, said("same company ", _quote(l["company"])))),
        signal(7, ("country_exact", same("country"), tx.COUNTRY_EXACT, said("same country ", _quote(l["country"])))),
        signal(8, ("created_same_day", same("created_at"), tx.CREATED_SAME_DAY, said("both created on ", l["created_at"]))))
    return F.filter(every, lambda s: s.isNotNull())


def scored(pairs: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """``pairs`` of scoring rows with given, family, signals, score, confidence, identity_conflict,
    contact_evidence and reasons.  Ratios run in Python only where names or local parts need them."""
    l, r = F.col(left), F.col(right)
    need = (l["email"] != r["email"]) & (l["email_local"] != "") & (r["email_local"] != "")
    at = pairs.withColumns({
        "given": nz.given_relation(l["given_key"], r["given_key"]), "family": nz.family_relation(l["family_key"], r["family_key"]),
        "_ratio": nz.similar_where(need, l["email_local"], r["email_local"], tx.LOCALPART_SIMILAR_FROM)})
    at = at.withColumn("signals", signals(l, r, F.col("given"), F.col("family"), F.coalesce("_ratio", F.lit(0.0)))).drop("_ratio")
    at = at.withColumn("score", F.aggregate("signals", F.lit(0), lambda a, s: a + s["points"]))
    ranked = F.array_sort(F.transform("signals", lambda s: F.struct((-F.abs(s["points"])).alias("p"), s["ord"].alias("o"), F.format_string("%s (%+d)", s["reason"], s["points"]).alias("t"))))
    names = F.transform("signals", lambda s: s["name"])
    return at.withColumns({
        "confidence": nz.band(F.col("score")), "identity_conflict": (F.col("given") == "conflict") | (F.col("family") == "conflict"),
        "contact_evidence": F.arrays_overlap(names, F.array(F.lit("email_exact"), F.lit("phone_exact"), F.lit("phone_last9"))),
        "reasons": F.transform(ranked, lambda s: s["t"])})


def score_pairs(leads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id) pairs with their scores; the smaller id is always the left side."""
    view = scoring_view(leads)
    rows = view.select("id", F.struct(*view.columns).alias("row"))
    at = pairs.select("left_id", "right_id").join(rows.select(F.col("id").alias("left_id"), F.col("row").alias("l")), "left_id")
    at = at.join(rows.select(F.col("id").alias("right_id"), F.col("row").alias("r")), "right_id")
    return scored(at)


def scored_candidates(leads: DataFrame, most: int = tx.BLOCK_MOST) -> DataFrame:
    """Candidate pairs with their scores; records are projected once for blocking and scoring."""
    view = cut(scoring_view(leads))
    return score_pairs(view, candidate_pairs(view, most))


@dataclass
class Duplicates:
    """Groups, review pairs and one row of statistics."""

    groups: DataFrame
    review: DataFrame
    stats: DataFrame
    pairs: DataFrame


def build_groups(leads: DataFrame, pairs: DataFrame, check_most: int = tx.GROUP_CHECK_MOST) -> DataFrame:
    """(lead_ids, score, confidence, reasons, internal_conflict) for components of high pairs.

    Groups of up to ``check_most`` records are as strong as their weakest pair, edge or not, and a pair
    that conflicts on identity demotes them; larger ones are as strong as their weakest edge."""
    high = pairs.filter("confidence = 'high'")
    members = cut(connected(high))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    small = members.join(sizes.filter(F.col("n") <= check_most), "component")
    inside = small.select("component", F.col("id").alias("left_id")).join(small.select("component", F.col("id").alias("right_id")), "component").filter("left_id < right_id")
    checked = score_pairs(leads, inside.select("left_id", "right_id")).join(inside, ["left_id", "right_id"])
    named = lambda s: F.coalesce(F.nullif(F.col(s)["display_name"], F.lit("")), F.col(s)["id"])
    checked = checked.select("component", "left_id", "right_id", "score", "confidence", "reasons", "identity_conflict", F.concat(named("l"), F.lit(" and "), named("r"), F.lit(" conflict on identity")).alias("why"))
    large = members.join(sizes.filter(F.col("n") > check_most), "component").select("component", F.col("id").alias("left_id"))
    edges = high.join(large, "left_id").select("component", "left_id", "right_id", "score", "confidence", "reasons", F.lit(False).alias("identity_conflict"), F.lit("").alias("why"))
    order = F.struct("score", "left_id", "right_id")
    best = checked.union(edges).groupBy("component").agg(
        F.min_by(F.struct("score", "confidence", "reasons"), order).alias("weakest"), F.bool_or("identity_conflict").alias("internal_conflict"),
        F.max(F.when(F.col("identity_conflict"), F.struct("left_id", "right_id", "why"))).alias("last"))
    ids = members.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("lead_ids"))
    demoted = F.concat(F.array(F.concat(F.lit("demoted for review: "), F.col("last.why"))), F.col("weakest.reasons"))
    return best.join(ids, "component").select(
        "lead_ids", F.col("weakest.score").alias("score"), F.when(F.col("internal_conflict"), "medium").otherwise(F.col("weakest.confidence")).alias("confidence"),
        F.when(F.col("internal_conflict"), demoted).otherwise(F.col("weakest.reasons")).alias("reasons"), "internal_conflict")


def find_duplicates(leads: DataFrame, min_score: int | None = None, include_review: bool = True, verdicts: DataFrame | None = None, block_most: int = tx.BLOCK_MOST, check_most: int = tx.GROUP_CHECK_MOST) -> Duplicates:
    """The whole pass.  ``verdicts`` (left_id, right_id, verdict JSON) annotate review pairs only."""
    leads = cut(scoring_view(leads))
    candidates = cut(candidate_pairs(leads, block_most))
    pairs = cut(score_pairs(leads, candidates).drop("l", "r"))
    review = pairs.filter((F.col("confidence") == "medium") & (F.col("score") >= (tx.MEDIUM_FROM if min_score is None else min_score)))
    review = annotate(review, verdicts if include_review else None)
    groups = build_groups(leads, pairs, check_most)
    groups = cut(groups if min_score is None else groups.filter(F.col("score") >= min_score))
    counts = pairs.agg(F.count_if(F.col("confidence") == "high").alias("high_confidence_pairs"))
    told = review.agg(F.count("*").alias("review_pairs"), F.count("adjudication").alias("llm_adjudicated_pairs"))
    sums = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.size("lead_ids")), F.lit(0)).alias("leads_in_groups"))
    stats = blocking_stats(leads, candidates, block_most).join(counts, F.lit(True)).join(told, F.lit(True)).join(sums, F.lit(True)).withColumn("llm_available", F.lit(verdicts is not None))
    return Duplicates(groups, review if include_review else review.limit(0), stats, pairs)


def annotate(review: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Review pairs with an adjudication where a verdict holds to its contract; none is dropped."""
    if verdicts is None:
        return review.withColumn("adjudication", F.lit(None).cast("string"))
    v = pair_verdict(F.col("verdict"))
    label = F.concat(F.lit("llm: "), F.when(v["same_person"], "same person").otherwise("different people"), F.when(v["confident"], " (confident)").otherwise(" (uncertain)"), F.when(v["reason"] != "", F.concat(F.lit(" — "), v["reason"])).otherwise(""))
    own = verdicts.select("left_id", "right_id", F.when(v.isNotNull(), label).alias("adjudication"))
    return review.join(own, ["left_id", "right_id"], "left")


def top_groups(groups: DataFrame, limit: int = tx.GROUPS_SIZE) -> DataFrame:
    if not 1 <= limit <= tx.GROUPS_MOST:
        raise ValueError(f"limit is 1 to {tx.GROUPS_MOST}")
    return groups.orderBy(F.desc("score"), F.col("lead_ids")[0]).limit(limit)


def top_review(review: DataFrame, limit: int = tx.GROUPS_SIZE) -> DataFrame:
    return review.orderBy("left_id", "right_id").limit(limit)


def reference_pairs(leads: DataFrame) -> DataFrame:
    """Pairs with equal phone digits and e-mail domain: the strict join that blocking must recover."""
    return _pairs_on(leads, ["phone_digits", "email_domain"])


def lookalike_pairs(leads: DataFrame) -> DataFrame:
    """Pairs with equal domain and family name but another phone: colleagues, not duplicates."""
    return _pairs_on(leads, ["email_domain", "family_key"], "phone_digits")


def _pairs_on(leads: DataFrame, equal: list[str], differ: str | None = None) -> DataFrame:
    keep = leads.select("id", *equal, *([differ] if differ else []))
    for c in equal:
        keep = keep.filter(F.col(c) != "")
    other = keep.select(*equal, F.col("id").alias("right_id"), *([F.col(differ).alias("_other")] if differ else []))
    at = keep.withColumnRenamed("id", "left_id").join(other, equal).filter("left_id < right_id")
    return (at.filter(F.col(differ) != F.col("_other")) if differ else at).select("left_id", "right_id")


def recovered(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row: expected pairs, and how many of them ``found`` has."""
    hit = expected.join(found.select("left_id", "right_id").withColumn("_hit", F.lit(1)), ["left_id", "right_id"], "left")
    return hit.agg(F.count("*").alias("expected"), F.count("_hit").alias("recovered"))


def band_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("confidence").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


def flagged_recall(leads: DataFrame, pairs: DataFrame, phrase: str = "possible duplicate") -> DataFrame:
    """One row: records whose notes hold the phrase, and how many of them a high or medium pair surfaces."""
    surfaced = pairs.filter("confidence <> 'low'").select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().withColumn("_hit", F.lit(1))
    return leads.filter(F.contains(F.lower("notes"), F.lit(phrase))).join(surfaced, "id", "left").agg(F.count("*").alias("flagged"), F.count("_hit").alias("surfaced"))


