import random

from skerry.operators import identity, site_search

STRONG = set(identity.STRONG)
KIND = (
    "organisation_number string, priority int, domain string, source string, relation string, resolved boolean, allowed boolean, fetch_error boolean, url string, final_domain string, final_entities int, "
    "challenge boolean, parked boolean, proofs array<string>, declared boolean, on_site boolean, full_domain boolean, unique boolean, masthead boolean, foreign array<string>"
)
NAMES = [c.strip().split()[0] for c in KIND.split(", ")]


def loop(rows, hosts=4):
    """The search as plain steps."""
    seen, fetched, fallback, challenged, attempts = set(), 0, None, [], []

    def ended(state, best, note):
        return (state, *(best or (None,) * 4), note, fetched, attempts)

    for c in sorted(rows, key=lambda c: (c["priority"], c["domain"])):
        if fetched >= hosts:
            break
        if c["domain"] in seen:
            continue
        early = "no_dns" if not c["resolved"] else "unreachable" if c["allowed"] is None else "blocked_robots" if not c["allowed"] else None
        if early:
            attempts.append((c["domain"], early))
            continue
        fetched += 1
        if c["fetch_error"]:
            attempts.append((c["domain"], "fetch_failed"))
            continue
        seen |= {c["domain"], c["final_domain"]}
        if c["challenge"] or c["parked"]:
            attempts.append((c["domain"], "bot_challenge" if c["challenge"] else "parked"))
            challenged += [c["final_domain"]] * c["challenge"]
            continue
        relation = "administrator_or_group" if c["final_entities"] >= 5 else c["relation"]
        proofs, strong = set(c["proofs"]), bool(set(c["proofs"]) & STRONG)
        told, named = c["declared"] and c["on_site"], c["unique"] and c["full_domain"] and c["on_site"]
        proofs |= {p for p, on in (("legal_name_on_site", c["on_site"]), ("registry_declared_website", told), ("unique_legal_name_domain", named), ("legal_name_masthead", c["masthead"])) if on}
        if relation == "administrator_or_group" and not (c["full_domain"] and (strong or told)):
            status = "related"
        elif strong or told or named or c["masthead"]:
            status = "exact"
        else:
            status = "weak" if proofs else "unverified"
        own = set(c["proofs"]) & {"organisation_number", "subunit_organisation_number"}
        if (c["foreign"] and not strong) or (status == "exact" and c["final_domain"] != c["domain"] and not c["on_site"] and not own):
            status = "related"
        attempts.append((c["domain"], status))
        best = (c["url"], c["final_domain"], status, sorted(proofs))
        if status == "exact":
            return ended("available", best, None)
        if status in ("related", "weak") and fallback is None:
            fallback = best
    if fallback:
        return ended("ambiguous", fallback, "Reachable site is not proven to be this exact entity; not published")
    if challenged:
        return ended("failed", None, ", ".join(sorted(set(challenged))) + " served a bot-protection check instead of its pages; identity could not be checked")
    return ended("not_available", None, "No candidate website carried an official tie to this entity")


def test_fold_equals_the_plain_loop(spark):
    r = random.Random(3)
    rows = []
    for company in range(600):
        for k in range(r.randint(1, 9)):
            chance = lambda p: r.random() < p
            domain = f"d{r.randint(0, 6)}.no"
            rows.append((
                str(company), r.randint(0, 30) * 10 + k, domain, r.choice(["registry_website", "name_guess"]), r.choice(["candidate", "candidate", "administrator_or_group"]), chance(0.8), r.choice([True, True, True, False, None]), chance(0.15),
                f"https://{domain}/{k}", domain if chance(0.6) else f"d{r.randint(0, 6)}.no", r.choice([0, 1, 4, 5, 9]), chance(0.15), chance(0.15), [p for p in (*identity.STRONG, "registry_address") if chance(0.08)],
                chance(0.2), chance(0.3), chance(0.3), chance(0.4), chance(0.07), ["999888777"] if chance(0.15) else [],
            ))
    got = {}
    for x in site_search.searched_sites(spark.createDataFrame(rows, KIND).repartition(5)).collect():
        got[x["organisation_number"]] = (x["state"], x["url"], x["domain"], x["status"], x["proofs"], x["note"], x["fetched"], [(a["domain"], a["outcome"]) for a in x["attempts"]])
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(dict(zip(NAMES, row)))
    wanted = {c: loop(own) for c, own in by.items()}
    assert got == wanted
    assert {w[0] for w in wanted.values()} == {"available", "ambiguous", "failed", "not_available"} and max(w[6] for w in wanted.values()) == 4


def test_null_flags_and_an_empty_table(spark):
    row = ("1", 1, "a.no", None, "candidate", True, True, None, "u", "a.no", None, None, None, None, None, None, None, None, None, None)
    df = spark.createDataFrame([row], KIND)
    got = site_search.searched_sites(df).first()
    assert (got["state"], got["fetched"], got["attempts"][0]["outcome"]) == ("not_available", 1, "unverified")
    assert site_search.searched_sites(df.limit(0)).collect() == []
