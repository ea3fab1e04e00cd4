"""Contacts, mailbox correlation and the outreach plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import compile_template, domain_label, first_name, is_no_reply, normalize_company_name, split_emails, valid_email
from feedloom.operators.lifecycle import first_per_key


def group_by_company(postings: DataFrame) -> DataFrame:
    """Postings (company, job_title, job_url, severity, llm_confidence, pos) by normalised company: company, first_pos, roles (how many), first_title, top.

    The roles themselves are not gathered, as a staffing firm may have very many; they stay rows (roles_of).
    """
    role = F.struct(F.col("job_title").alias("title"), F.col("job_url").alias("jobUrl"), "severity", F.col("llm_confidence").alias("score"))
    best = F.struct(F.when(F.col("severity") == "green", 0).otherwise(1), -F.coalesce("llm_confidence", F.lit(float("-inf"))), "pos")
    return postings.groupBy(normalize_company_name(F.col("company")).alias("company_norm")).agg(F.min_by("company", "pos").alias("company"), F.min("pos").alias("first_pos"), F.count("*").alias("roles"), F.min_by("job_title", "pos").alias("first_title"), F.min_by(role, best).alias("top"))


def roles_of(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """The roles of companies (company_norm and others), a row each, in the order of pos."""
    named = postings.withColumn("company_norm", normalize_company_name(F.col("company"))).drop("company")
    return named.select("company_norm", "pos", F.struct(F.col("job_title").alias("title"), F.col("job_url").alias("jobUrl"), "severity", F.col("llm_confidence").alias("score")).alias("role")).join(companies, "company_norm")


def top_role(roles: Column) -> Column:
    """Green over yellow, then the higher score, none being less than any, the first on ties."""
    ranked = F.transform(roles, lambda r, i: F.struct(F.when(r["severity"] == "green", 0).otherwise(1).alias("a"), (-F.coalesce(r["score"], F.lit(float("-inf")))).alias("b"), i.alias("c"), r.alias("role")))
    return F.array_min(ranked)["role"]


def match_contacts(groups: DataFrame, recruiters: DataFrame) -> DataFrame:
    """groups with contacts by exact name, else by alternative name, else by the label of the mail domain."""
    name = groups.select("company_norm", F.replace(F.col("company_norm"), F.lit(" "), F.lit("")).alias("flat"))
    people = recruiters.select("email", "status", F.col("company_norm").alias("own"), "alt_names_norm")
    exact = name.join(people, name["company_norm"] == people["own"]).select(name["company_norm"], "email", "status", F.lit(1).alias("tier"))
    other = people.select("email", "status", F.explode("alt_names_norm").alias("alt"))
    alt = name.join(other, name["company_norm"] == other["alt"]).select("company_norm", "email", "status", F.lit(2).alias("tier"))
    label = people.select("email", "status", domain_label(F.col("email")).alias("label")).where(F.length("label") >= 4)
    domain = name.join(label, name["flat"] == label["label"]).select("company_norm", "email", "status", F.lit(3).alias("tier"))
    found = exact.union(alt).union(domain).dropDuplicates(["company_norm", "email", "tier"])
    return found.withColumn("__best", F.min("tier").over(Window.partitionBy("company_norm"))).where(F.col("tier") == F.col("__best")).drop("__best")


def split_cooldown(matches: DataFrame, last_drafted: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """I16: matches with last_drafted_at and state: bounced_contact, cooldown or eligible."""
    last = last_drafted.groupBy(F.col("recruiter_email").alias("email")).agg(F.max("last_drafted_at").alias("last_drafted_at"))
    joined = matches.join(last, "email", "left")
    hot = F.col("last_drafted_at") > now - F.expr(f"INTERVAL {days} DAYS")
    return joined.withColumn("state", F.when(F.col("status") == "bounced", "bounced_contact").when(hot, "cooldown").otherwise("eligible"))


def rank_contacts(eligible: DataFrame) -> DataFrame:
    """H5: within a company verified first, then never drafted, then the oldest draft."""
    order = Window.partitionBy("company_norm").orderBy(F.when(F.col("status") == "verified", 0).otherwise(1), F.col("last_drafted_at").asc_nulls_first(), "email")
    return eligible.withColumn("rank", F.row_number().over(order))


def one_draft_per_contact(plan: DataFrame) -> DataFrame:
    """H6: a contact of several companies goes to the first."""
    return first_per_key(plan, ["email"], "first_pos", "company_norm")


def undrafted_reason(matches: DataFrame) -> DataFrame:
    """Per company the strongest reason that nobody was eligible."""
    flags = matches.groupBy("company_norm").agg(F.bool_or(F.col("state") == "eligible").alias("__ok"), F.bool_or(F.col("state") == "cooldown").alias("__cool"))
    return flags.where("NOT __ok").select("company_norm", F.when(F.col("__cool"), "cooldown").otherwise("bounced_contact").alias("reason"))


def draftable(postings: DataFrame, severities: tuple[str, ...] = ("green", "yellow")) -> DataFrame:
    """Postings whose severity calls for a draft."""
    return postings.where(F.col("severity").isin(*severities))


def plan_outreach(postings: DataFrame, recruiters: DataFrame, last_drafted: DataFrame, template: str, now: Column, severities: tuple[str, ...] = ("green", "yellow")) -> tuple[DataFrame, DataFrame]:
    """(drafts: one per contact, with the message; undrafted: a row per role with a reason)."""
    wanted = draftable(postings, severities)
    groups = group_by_company(wanted)
    matches = split_cooldown(match_contacts(groups, recruiters), last_drafted, now)
    ranked = rank_contacts(matches.where("state = 'eligible'")).join(groups, "company_norm")
    plan = one_draft_per_contact(ranked)
    roles = F.when(F.col("roles") == 1, F.col("first_title")).otherwise(F.concat("first_title", F.lit(" and "), (F.col("roles") - 1).cast("string"), F.lit(" more")))
    body = compile_template(template, company=F.col("company"), roles=roles, name=first_name(F.split("email", "@")[0]))
    plan = plan.select("email", "company", "company_norm", "rank", "roles", "top", body.alias("body"))
    reasons = groups.select("company_norm", "company").join(matches.where("state = 'eligible'").select("company_norm").distinct(), "company_norm", "left_anti")
    reasons = reasons.join(undrafted_reason(matches), "company_norm", "left").withColumn("reason", F.coalesce("reason", F.lit("no_contact")))
    return plan, roles_of(wanted, reasons).select("company", F.col("role.title").alias("job_title"), F.col("role.jobUrl").alias("job_url"), F.col("role.severity").alias("severity"), "reason")


def latest_message(mail: DataFrame) -> DataFrame:
    """The newest message of each address."""
    return mail.groupBy("address").agg(F.max_by("message_id", "internal_date").alias("message_id"), F.max("internal_date").alias("internal_date"))


def correlate_mail(outreach: DataFrame, mailbox: DataFrame) -> DataFrame:
    """per outreach row the latest message sent to its address after it was drafted, and the first bounce after it was sent.

    The latest of all messages to an address is the latest after any time before it, so one row per address answers the
    first question. The first bounce after a time is found by a running minimum over bounces and sendings of an address, so
    no row meets every message of its address.
    """
    last = mailbox.where("folder = 'sent'").groupBy(F.col("address").alias("__to")).agg(F.max("internal_date").alias("__at"), F.max_by("message_id", "internal_date").alias("__message"))
    hit = F.col("__at") > F.col("drafted_at")
    found = outreach.join(last, F.col("recruiter_email") == F.col("__to"), "left").withColumns({"found_sent_at": F.when(hit, F.col("__at")), "found_message_id": F.when(hit, F.col("__message"))}).drop("__to", "__at", "__message")
    bounce = mailbox.where("folder = 'bounce'").select(F.col("address").alias("to"), F.col("internal_date").alias("at"), F.lit(None).cast(outreach.schema["id"].dataType).alias("id"), F.struct(F.col("internal_date").alias("at"), "snippet").alias("b"))
    asked = outreach.where("sent_at IS NOT NULL").select(F.col("recruiter_email").alias("to"), F.col("sent_at").alias("at"), "id", F.lit(None).cast(bounce.schema["b"].dataType).alias("b"))
    # Later rows first; of one time the sendings come before the bounces, which are not after them.
    ahead = Window.partitionBy("to").orderBy(F.col("at").desc(), F.col("id").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    first = bounce.unionByName(asked).withColumn("n", F.min("b").over(ahead)).where("id IS NOT NULL").select("id", F.col("n.at").alias("bounced_at"), F.col("n.snippet").alias("snippet"))
    return found.join(first, "id", "left")


def advance_outreach(outreach: DataFrame, mailbox: DataFrame, drafts_gone: DataFrame, now: Column, recheck_days: int = 14, verify_hours: int = 24) -> DataFrame:
    """One pass of the status machine. drafts_gone: ids of drafts that no longer exist.

    A draft that is gone was sent if a message is found, else discarded; a discarded one is looked for again for a while;
    what is sent by then bounces, or is verified after a day. Nothing known is overwritten by null.
    """
    gone = drafts_gone.select("id").distinct().withColumn("__gone", F.lit(True))
    seen = correlate_mail(outreach, mailbox).join(gone, "id", "left")
    young = F.col("drafted_at") >= now - F.expr(f"INTERVAL {recheck_days} DAYS")
    late = (F.col("status") == "draft") & F.col("__gone") & F.col("found_sent_at").isNull()
    found = F.col("found_sent_at").isNotNull() & (((F.col("status") == "draft") & F.col("__gone")) | ((F.col("status") == "discarded") & young))
    first = seen.withColumns({
        "status": F.when(found, "sent").when(late, "discarded").otherwise(F.col("status")),
        "sent_at": F.when(found, F.col("found_sent_at")).otherwise(F.col("sent_at")),
        "message_id": F.when(found, F.col("found_message_id")).otherwise(F.col("message_id")),
        "last_checked_at": now,
    }).select(*outreach.columns)
    again = correlate_mail(first, mailbox)
    is_sent = (F.col("status") == "sent") & F.col("sent_at").isNotNull()
    bounced, old = is_sent & F.col("bounced_at").isNotNull(), is_sent & (F.col("sent_at") <= now - F.expr(f"INTERVAL {verify_hours} HOURS"))
    return again.withColumns({
        "status": F.when(bounced, "bounced").when(old, "verified").otherwise(F.col("status")),
        "failure_detail": F.when(bounced, F.col("snippet")).otherwise(F.col("failure_detail")),
        "verified_at": F.when(old & ~bounced, now).otherwise(F.col("verified_at")),
    }).select(*outreach.columns)


def discarded_roles(outreach: DataFrame) -> DataFrame:
    """A row per role of discarded drafts."""
    return outreach.where("status = 'discarded'").select("profile_id", "run_id", "run_date", F.col("company_name").alias("company"), F.explode("roles").alias("r")).select(
        "profile_id", "run_id", "run_date", "company", F.col("r.title").alias("job_title"), F.lit(None).cast("string").alias("location"), F.col("r.jobUrl").alias("job_url"), F.col("r.severity").alias("severity"), F.col("r.score").alias("score"), F.lit("draft_discarded").alias("reason")
    )


def lookup_contacts(rows: DataFrame, recruiters: DataFrame, existing: DataFrame) -> DataFrame:
    """the contacts that rows (recruiter_email) are about, each once, without those of the existing list."""
    return rows.select(F.lower("recruiter_email").alias("email")).distinct().join(recruiters, "email").join(existing.select("email"), "email", "left_anti")


def promote_contacts(verified: DataFrame, recruiters: DataFrame, existing: DataFrame) -> DataFrame:
    """Contacts of newly verified rows that came from raw files and are not in the existing list."""
    return lookup_contacts(verified, recruiters.where("source = 'raw-csv' AND status = 'verified'"), existing)


def read_contacts(raw: DataFrame, manual: DataFrame) -> DataFrame:
    """A5: contacts of both tabs by address; manual rows are verified and win over raw ones."""

    def spread(df: DataFrame, source: str, status: str, rank: int) -> DataFrame:
        alt = F.filter(F.transform(F.split(F.coalesce(F.col("alt_names"), F.lit("")), ";"), normalize_company_name), lambda x: x != "") if "alt_names" in df.columns else F.array().cast("array<string>")
        return df.select(F.explode(split_emails(F.col("emails"))).alias("email"), "company", normalize_company_name(F.col("company")).alias("company_norm"), alt.alias("alt_names_norm"), F.col("contact_name"), F.lit(source).alias("source"), F.lit(status).alias("status"), F.lit(rank).alias("__rank"))

    return first_per_key(spread(raw, "raw-csv", "unverified", 1).unionByName(spread(manual, "manual", "verified", 0)), ["email"], "__rank", "company").drop("__rank")


def campaign_pool(contacts: DataFrame, records: DataFrame, profile_id: str) -> DataFrame:
    """Valid addresses that are not no-reply, each once, not yet written to.

    A cell may hold several addresses; of rows with the same address the first by pos counts, where there is one, else by company.
    """
    each = contacts.select("*", F.posexplode(split_emails(F.col("email"))).alias("__at", "__email"))
    fresh = each.drop("email").withColumnRenamed("__email", "email").where(~is_no_reply(F.col("email")))
    order = ["pos", "__at"] if "pos" in contacts.columns else ["company", "__at"]
    first = first_per_key(fresh, ["email"], *order).select(*contacts.columns)
    return first.join(records.where(F.col("profile_id") == profile_id).select(F.lower("email").alias("email")), "email", "left_anti")


def deliverable(pool: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pool with deliverable, false where the domain has no verdict."""
    # Where a domain has several verdicts one good one is enough.
    known = verdicts.groupBy(F.lower("domain").alias("domain")).agg(F.bool_or("ok").alias("ok"))
    return pool.withColumn("domain", F.lower(F.regexp_extract("email", "@([^@]+)$", 1))).join(known, "domain", "left").withColumn("deliverable", F.coalesce("ok", F.lit(False))).drop("ok")


def sweep_bounces(records: DataFrame, mailbox: DataFrame, now: Column, days: int = 21) -> DataFrame:
    """Drafted records of the window whose address bounced afterwards."""
    bounce = mailbox.where("folder = 'bounce'").groupBy(F.col("address").alias("email")).agg(F.max("internal_date").alias("__at"))
    hit = (F.col("status") == "drafted") & (F.col("at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("__at") > F.col("at"))
    return records.join(bounce, "email", "left").withColumn("status", F.when(hit, "bounced").otherwise(F.col("status"))).select(*records.columns)


def append_records(records: DataFrame, pool: DataFrame, profile_id: str, batch: int, now: Column) -> DataFrame:
    """Records with one more batch: a drafted row per address of the pool."""
    new = pool.select("email").distinct().withColumns({"profile_id": F.lit(profile_id), "batch": F.lit(batch).cast("long"), "status": F.lit("drafted"), "at": now})
    return records.unionByName(new, allowMissingColumns=True)


def project_drafts(outreach: DataFrame) -> DataFrame:
    """A10: drafts as a flat table: roles as lines, the top role's severity and score."""
    lines = F.array_join(F.transform("roles", lambda r: F.concat(r["title"], F.lit(" — "), r["jobUrl"])), "\n")
    top = top_role(F.col("roles"))
    return outreach.where("status = 'draft'").select("id", "profile_id", "recruiter_email", lines.alias("roles_text"), top["severity"].alias("severity"), top["score"].alias("score"), "drafted_at")


def project_sent(outreach: DataFrame) -> DataFrame:
    """A10: sent rows, newest first, with the time of the next check."""
    return outreach.where("sent_at IS NOT NULL").withColumn("check_after", F.col("sent_at") + F.expr("INTERVAL 24 HOURS")).orderBy(F.col("sent_at").desc(), "id")
