"""The search for a company's own website as a fold over its candidates.

What a candidate brings depends on those before it: a domain that another one
led to is not fetched again, only so many hosts are fetched, and the first
proven one ends the search.  Each company's candidates, a short list, are put
in order once, and one ``aggregate`` carries the state through them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators import identity

HOSTS = 4
_ATTEMPT = "struct<domain: string, source: string, outcome: string, url: string, final_domain: string>"
_STATE = f"struct<seen: array<string>, fetched: int, ended: boolean, published: struct<{{0}}>, fallback: struct<{{0}}>, challenged: array<string>, attempts: array<{_ATTEMPT}>>".format(
    "url: string, domain: string, source: string, status: string, proofs: array<string>"
)


def judged(c: Column) -> Column:
    """``status, publishable, proofs`` of a fetched candidate, after what its destination says about others."""
    relation = F.when(c["final_entities"] >= identity.SHARED_FROM, F.lit("administrator_or_group")).otherwise(c["relation"])
    first = identity.assessed(c["proofs"], relation, c["declared"], c["on_site"], c["full_domain"], c["unique"], c["masthead"])
    strong = F.arrays_overlap(c["proofs"], F.array(*map(F.lit, identity.STRONG)))
    numbered = F.arrays_overlap(c["proofs"], F.array(F.lit("organisation_number"), F.lit("subunit_organisation_number")))
    foreign = (F.size(c["foreign"]) > 0) & ~strong  # the site names another operator, and nothing of ours
    led_away = first["publishable"] & ~c["final_domain"].eqNullSafe(c["domain"]) & ~c["on_site"] & ~numbered  # a parent's, owner's or reseller's site
    related = foreign | led_away
    return F.struct(F.when(related, "related").otherwise(first["status"]).alias("status"), (first["publishable"] & ~related).alias("publishable"), first["proofs"].alias("proofs"))


def _step(hosts: int):
    def step(s: Column, c: Column) -> Column:
        over = s["ended"] | (s["fetched"] >= hosts)
        passed = over | F.array_contains(s["seen"], c["domain"])
        unfetched = F.when(~c["resolved"], "no_dns").when(c["allowed"].isNull(), "unreachable").when(~c["allowed"], "blocked_robots")
        tried = ~passed & unfetched.isNull()
        outcome = F.coalesce(unfetched, F.when(c["fetch_error"], "fetch_failed").when(c["challenge"], "bot_challenge").when(c["parked"], "parked"), c["judged"]["status"])
        answered = tried & ~c["fetch_error"]
        read = answered & ~c["challenge"] & ~c["parked"]
        found = F.struct(c["url"].alias("url"), c["final_domain"].alias("domain"), c["source"].alias("source"), c["judged"]["status"].alias("status"), c["judged"]["proofs"].alias("proofs"))
        told = F.struct(c["domain"].alias("domain"), c["source"].alias("source"), outcome.alias("outcome"), F.when(c["resolved"], c["url"]).alias("url"), F.when(answered, c["final_domain"]).alias("final_domain"))
        return F.struct(
            F.when(answered, F.array_union(s["seen"], F.array(c["domain"], c["final_domain"]))).otherwise(s["seen"]).alias("seen"),
            (s["fetched"] + tried.cast("int")).alias("fetched"),
            (s["ended"] | (read & c["judged"]["publishable"])).alias("ended"),
            F.coalesce(s["published"], F.when(read & c["judged"]["publishable"], found)).alias("published"),
            F.coalesce(s["fallback"], F.when(read & ~c["judged"]["publishable"] & c["judged"]["status"].isin("related", "weak"), found)).alias("fallback"),
            F.when(answered & c["challenge"], F.array_append(s["challenged"], c["final_domain"])).otherwise(s["challenged"]).alias("challenged"),
            F.when(passed, s["attempts"]).otherwise(F.array_append(s["attempts"], told)).alias("attempts"),
        ).cast(_STATE)

    return step


def searched_sites(candidates: DataFrame, key: str = "organisation_number", hosts: int = HOSTS) -> DataFrame:
    """One row per company: ``key, state, url, domain, source, status, proofs, note, fetched, attempts``.

    Candidates are ``priority, domain, source, relation`` with what was seen of them: ``resolved, allowed`` (null: not
    reached) ``, fetch_error, url, final_domain`` (after redirects) ``, final_entities`` (companies on it) ``, challenge, parked,
    proofs, declared, on_site, full_domain, unique, masthead, foreign`` (other operators' numbers).  They are tried by
    priority, ties by domain; null flags are false.

    The first publishable one makes the site ``available``; else the first related or weak one leaves it ``ambiguous``;
    else a bot check makes the search ``failed``; else it is ``not_available``.  A domain seen before is passed over, and
    the search ends after ``hosts`` fetches."""
    flags = ("resolved", "fetch_error", "challenge", "parked", "declared", "on_site", "full_domain", "unique", "masthead")
    none = F.array().cast("array<string>")
    rows = candidates.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags} | {a: F.coalesce(F.col(a), none) for a in ("proofs", "foreign")} | {"final_entities": F.coalesce("final_entities", F.lit(0))})
    wanted = ("domain", "source", "relation", "resolved", "allowed", "fetch_error", "url", "final_domain", "final_entities", "challenge", "parked", "proofs", "declared", "on_site", "full_domain", "unique", "masthead", "foreign")
    each = rows.select(key, "priority", F.struct(*wanted).alias("c")).select(key, F.struct("priority", F.col("c.domain").alias("domain"), F.struct("c.*", judged(F.col("c")).alias("judged")).alias("c")).alias("x"))
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list("x"), _by_priority).alias("x"))
    start = F.from_json(F.lit('{"seen": [], "fetched": 0, "ended": false, "challenged": [], "attempts": []}'), _STATE)
    folded = listed.select(key, F.aggregate(F.col("x.c"), start, _step(hosts)).alias("s"))
    barred = F.array_sort(F.array_distinct("s.challenged"))
    state = F.when(F.col("s.published").isNotNull(), "available").when(F.col("s.fallback").isNotNull(), "ambiguous").when(F.size(barred) > 0, "failed").otherwise("not_available")
    # fixed texts
    note = (
        F.when(F.col("state") == "ambiguous", "Reachable site is not proven to be this exact entity; not published")
        .when(F.col("state") == "failed", F.concat(F.array_join(barred, ", "), F.lit(" served a bot-protection check instead of its pages; identity could not be checked")))
        .when(F.col("state") == "not_available", "No candidate website carried an official tie to this entity")
    )
    shown = folded.withColumns({"state": state, "best": F.coalesce("s.published", "s.fallback")})
    return shown.select(key, "state", "best.*", note.alias("note"), F.col("s.fetched").alias("fetched"), F.col("s.attempts").alias("attempts"))


def _by_priority(a: Column, b: Column) -> Column:
    order = lambda x, y, then: F.when(x < y, -1).when(x > y, 1).otherwise(then)
    return order(a["priority"], b["priority"], order(a["domain"], b["domain"], F.lit(0)))
