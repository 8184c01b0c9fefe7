"""Re-checking contact data: findings, verdicts per domain, and the report."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .skew import ROWS_PER_TASK, join_by_key


def addresses(leads: DataFrame) -> DataFrame:
    """Every listed address with its shape verdict and domain."""
    all_of = F.concat(F.array("email"), F.coalesce("email_alt", F.array().cast("array<string>")))
    one = leads.select("ord", "place_id", "name", "address", F.explode(all_of).alias("raw"))
    email = F.trim("email")
    return (
        one.filter(K.present(F.col("raw")))
        .withColumn("email", F.trim("raw"))
        .select(
            "ord", "place_id", "name", "address", "email",
            K.email_shaped(email).alias("shaped"),
            F.when(
                K.email_shaped(email), F.lower(F.substring_index(email, "@", -1))
            ).alias("domain"),
        )
    )


def scan_mx(mx_results: DataFrame) -> DataFrame:
    """Captured DNS answers as one verdict per domain."""
    verdict = K.mx_verdict(F.col("http_ok"), F.col("status"), F.col("answers"))
    return mx_results.select("domain", verdict.alias("verdict"))


def join_mx(
    address_rows: DataFrame, verdicts: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The verdict of each address's domain; a domain without one is unknown.

    Large mail providers are hot keys here, so their rows are salted.
    """
    spread = F.coalesce("domain", F.concat(F.lit("\u0000"), F.col("place_id")))
    keyed = address_rows.withColumn("_domain", spread)
    dim = verdicts.select(F.col("domain").alias("_domain"), "verdict")
    joined = join_by_key(keyed, dim, ["_domain"], "place_id", rows_per_task=rows_per_task)
    return joined.drop("_domain").withColumn(
        "verdict", F.when(F.col("shaped"), F.coalesce("verdict", F.lit("unknown")))
    )


def join_probe(leads: DataFrame, probes: DataFrame) -> DataFrame:
    """Leads with a site beside their probe; no probe, no verdict."""
    with_site = leads.filter(K.present(F.col("website")))
    facts = probes.select(
        "place_id",
        F.col("robots_blocked"),
        F.col("reachable").alias("probe_reachable"),
        F.col("http_status").alias("probe_status"),
        F.col("error").alias("probe_error"),
    )
    blocked = F.col("robots_blocked")
    status = F.when(
        F.coalesce("probe_status", F.lit(0)) != 0, F.format_string(" (HTTP %s)", "probe_status")
    ).otherwise(F.lit(""))
    return with_site.join(facts, "place_id", "left").select(
        "ord", "place_id", "name", "address",
        F.when(blocked, F.lit("blocked_site"))
        .when(F.col("probe_reachable") == "no", F.lit("broken_site"))
        .alias("kind"),
        F.when(blocked, F.lit("robots.txt disallows us, so its status is unknown by choice"))
        .when(
            F.col("probe_reachable") == "no",
            F.concat(F.coalesce("probe_error", F.lit("did not load")), status),
        )
        .alias("detail"),
    )


def email_findings(checked: DataFrame) -> DataFrame:
    email, domain = F.col("email"), F.col("domain")
    malformed, dead = ~F.col("shaped"), F.col("verdict") == "no"
    return checked.select(
        "ord", "place_id", "name", "address",
        F.when(malformed | dead, F.lit("bad_email"))
        .when(F.col("verdict") == "unknown", F.lit("unchecked_email"))
        .alias("kind"),
        F.when(malformed, F.concat(email, F.lit(" — malformed address")))
        .when(dead, F.concat(email, F.lit(" — "), domain, F.lit(" has no mail server, so nothing can be delivered")))
        .otherwise(F.concat(email, F.lit(" — "), domain, F.lit(" could not be checked")))
        .alias("detail"),
    )


def phone_findings(leads: DataFrame) -> DataFrame:
    problem = K.phone_problem(F.col("phone"), K.is_ph(F.col("address")))
    return leads.filter(K.present(F.col("phone"))).select(
        "ord", "place_id", "name", "address",
        F.when(problem.isNotNull(), F.lit("bad_phone")).alias("kind"),
        F.concat(F.col("phone"), F.lit(" — "), problem).alias("detail"),
    )


def contact_checks(leads: DataFrame, probes: DataFrame, mx_results: DataFrame) -> DataFrame:
    """Every check made, `kind` NULL where nothing is wrong, tagged by channel."""
    checked = join_mx(addresses(leads), scan_mx(mx_results))
    parts = {
        "site": join_probe(leads, probes),
        "email": email_findings(checked),
        "phone": phone_findings(leads),
    }
    tagged = [df.withColumn("channel", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def contact_findings(leads: DataFrame, probes: DataFrame, mx_results: DataFrame) -> DataFrame:
    return contact_checks(leads, probes, mx_results).filter("kind IS NOT NULL").drop("channel")


def contact_report(checks: DataFrame) -> DataFrame:
    """Tested and failed per channel, with unchecked and blocked apart."""

    def of(kind):
        return F.count_if(F.col("kind") == kind)

    return checks.agg(
        F.count_if(F.col("channel") == "site").alias("sites_tested"),
        F.count_if(F.col("channel") == "email").alias("emails_tested"),
        F.count_if(F.col("channel") == "phone").alias("phones_tested"),
        of("broken_site").alias("broken_sites"),
        of("blocked_site").alias("blocked_sites"),
        of("bad_email").alias("bad_emails"),
        of("unchecked_email").alias("unchecked_emails"),
        of("bad_phone").alias("bad_phones"),
    )


# Report sections in print order with their notes.
SECTIONS = [
    ("broken_site", "Websites that did not load",
     "Not a data problem — these are prospects, and a dead site is the strongest hook the audit produces."),
    ("bad_email", "Email addresses that cannot receive mail",
     "Remove these before the first send. Bounces cost sender reputation for every later campaign."),
    ("bad_phone", "Phone numbers that cannot be dialled as written", None),
    ("unchecked_email", "Email domains that could not be checked",
     "Not a fault. The lookup itself failed, so nothing is known either way — re-run to resolve."),
    ("blocked_site", "Sites that block us in robots.txt", None),
]


def contact_markdown(findings: DataFrame) -> DataFrame:
    """Findings as report lines, with their section's place in the report."""
    order = F.array(*[F.lit(k) for k, _, _ in SECTIONS])
    titles = F.create_map(*[F.lit(x) for k, t, _ in SECTIONS for x in (k, t)])
    region = F.when(K.is_ph(F.col("address")), F.lit("PH")).otherwise(F.lit("US"))
    line = F.concat(F.lit("- ["), region, F.lit("] **"), F.col("name"), F.lit("** — "), F.col("detail"))
    return findings.select(
        F.array_position(order, F.col("kind")).cast("int").alias("section_no"),
        F.element_at(titles, F.col("kind")).alias("section"),
        "ord",
        line.alias("line"),
    )


# The checks of the report, how certain each is, and its two counts.
CHECKS = [
    ("Website loads", "Actually fetched", "sites_tested", "broken_sites"),
    ("Email domain accepts mail", "MX looked up", "emails_tested", "bad_emails"),
    ("Phone is dialable", "Format only", "phones_tested", "bad_phones"),
]


def contact_table(checks: DataFrame, leads: DataFrame, today: Column) -> DataFrame:
    """The head of the report, line by line: title with the number of leads, date, and the check table."""
    total = leads.agg(F.count(F.lit(1))).scalar().cast("string")
    rows = [F.concat(F.lit(f"| {name} | {sure} | "), F.col(tested).cast("string"), F.lit(" | **"), F.col(failed).cast("string"), F.lit("** |")) for name, sure, tested, failed in CHECKS]
    lines = [
        F.concat(F.lit("# Contact verification — "), total, F.lit(" leads")),
        F.concat(F.lit("Run "), today, F.lit(". No Places quota was spent: this is direct HTTP and DNS only.")),
        F.lit("| Check | How certain | Tested | Failed |"), F.lit("|---|---|---|---|"), *rows,
    ]
    return contact_report(checks).select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def contact_headings(checks: DataFrame) -> DataFrame:
    """One heading per section with its count, empty sections included."""
    counts = contact_report(checks)
    plural = {"broken_site": "broken_sites", "bad_email": "bad_emails", "bad_phone": "bad_phones",
              "unchecked_email": "unchecked_emails", "blocked_site": "blocked_sites"}
    rows = [
        F.struct(
            F.lit(i).alias("section_no"),
            F.concat(F.lit(f"## {title} — "), F.col(plural[kind]).cast("string")).alias("heading"),
            F.lit(note or "").alias("note"),
            F.when(F.col(plural[kind]) == 0, F.lit("_Nothing found._")).otherwise(F.lit("")).alias("empty"),
        )
        for i, (kind, title, note) in enumerate(SECTIONS, 1)
    ]
    return counts.select(F.inline(F.array(*rows)))
