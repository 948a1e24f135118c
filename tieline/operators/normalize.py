"""Raw dataset rows to canonical records: one projection per dataset.

Input rows are (ws, import_id, source_file, row_no, row map). Arrival order is explicit: `ord` is
(dataset rank, file, row number), so results never depend on how Spark schedules the rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import dates, fixed_values as fv, text as t
from tieline.operators import identity
from tieline.sources.catalogue import dataset_rank

SCOPE = ["ws", "import_id"]
TRACE = [*SCOPE, "source_file", "ord"]


def pick(*headers: str) -> Column:
    """First non-empty cell among alias headers, else ''."""
    return F.coalesce(*[t.nullif_blank(F.try_element_at("row", F.lit(h))) for h in headers], F.lit(""))


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


@dataclass
class Canonical:
    """Canonical tables of a batch of imports, and one judgement per input row."""

    tables: dict[str, list[DataFrame]] = field(default_factory=dict)
    judged: list[DataFrame] = field(default_factory=list)
    # May store a table and return it as read back.
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df

    def add(self, table: str, rows: DataFrame) -> None:
        self.tables.setdefault(table, []).append(rows)

    def union(self, table: str) -> DataFrame | None:
        parts = self.tables.get(table)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def outcomes(self) -> DataFrame:
        """(ws, import_id, dataset, source_file, accepted, rejected)."""
        every = reduce(lambda a, b: a.unionByName(b), self.judged)
        return every.groupBy(*SCOPE, "dataset", "source_file").agg(
            F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")
        )


def dataset_rows(raw: DataFrame, dataset: str) -> DataFrame:
    order = F.struct(F.lit(fv.DATASET_ORDER.index(dataset)).alias("rank"), "source_file", "row_no")
    return raw.filter(F.col("dataset") == dataset).withColumn("ord", order)


def owners(raw: DataFrame) -> DataFrame:
    """(ws, import_id, owner_key, owner_name, owner_slug); later profile files overlay earlier ones."""
    usable = first_profiles(raw)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    return usable.groupBy(*SCOPE).agg(
        latest("name").alias("owner_name"), latest("profile_url").alias("owner_url")
    ).select(*SCOPE, identity.owner_key(F.col("owner_url")).alias("owner_key"), t.comparison_key(F.col("owner_name")).alias("owner_name"),
             t.profile_slug(F.col("owner_url")).alias("owner_slug"))


def profile_names(raw: DataFrame) -> DataFrame:
    first, last = t.clean(pick("first name", "firstname")), t.clean(pick("last name", "lastname"))
    name = F.coalesce(t.nullif_blank(t.full_name(first, last)), t.clean(pick("full name", "name")))
    return dataset_rows(raw, "profile").withColumns({"first": first, "last": last, "name": name})


def first_profiles(raw: DataFrame) -> DataFrame:
    """The first usable row of every profile file: a file describes one person."""
    usable = profile_names(raw).filter("name <> ''")
    best = usable.groupBy(*SCOPE, "source_file").agg(F.min("row_no").alias("row_no"))
    rows = usable.join(best, [*SCOPE, "source_file", "row_no"], "left_semi")
    return rows.select(
        *TRACE, "row", "name", t.nullif_blank(F.col("first")).alias("first_name"), t.nullif_blank(F.col("last")).alias("last_name"),
        t.optional(pick("headline")).alias("headline"), t.location(pick("geo location", "location", "address")).alias("location"),
        t.optional(pick("industry")).alias("industry"), t.profile_url(pick("public profile url", "profile url", "url")).alias("profile_url"),
    )


def _owned(rows: DataFrame, owner: DataFrame) -> DataFrame:
    """Adds the owner's person key; imports without a profile use the reserved key."""
    keys = owner.select(*SCOPE, F.col("owner_key").alias("person_key"))
    return rows.join(keys, SCOPE, "left").withColumn("person_key", F.coalesce("person_key", F.lit(identity.OWNER_KEY)))


def _judge(out: Canonical, rows: DataFrame, dataset: str, accepted: Column) -> None:
    out.judged.append(rows.select(*SCOPE, F.lit(dataset).alias("dataset"), "source_file", F.coalesce(accepted, F.lit(False)).alias("accepted")))


def _companies(out: Canonical, rows: DataFrame, name: Column) -> None:
    out.add("companies", rows.filter(name.isNotNull()).select(
        *SCOPE, "ord", name.alias("name"), t.company_key(name).alias("company_key"), _null().alias("linkedin_url"), _null().alias("industry")))


def _person(rows: DataFrame, **fields: Column) -> DataFrame:
    """Candidate person rows; fields not given are null."""
    typed = {c: _null("timestamp_ntz" if c == "connected_at" else "string") for c in identity.PERSON_FIELDS}
    given = {c: v.cast("timestamp_ntz" if c == "connected_at" else "string") for c, v in fields.items() if c in typed}
    columns = {**typed, **given}
    return rows.select(
        *TRACE, "person_key", *[v.alias(c) for c, v in columns.items()],
        fields.get("is_self", F.lit(False)).alias("is_self"), fields["confidence"].cast("int").alias("confidence"),
    )


# --- owner datasets ---------------------------------------------------------------------------


def normalize_profile(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    named = profile_names(raw)
    rows = _owned(first_profiles(raw), owner)
    columns = {c: F.col(c) for c in ("name", "first_name", "last_name", "headline", "location", "industry", "profile_url")}
    out.add("people", _person(rows, **columns, is_self=F.lit(True), confidence=F.lit(100)))
    values = F.array(*[
        F.struct(F.lit(f).alias("field_name"), t.optional(pick(h)).alias("field_value"))
        for f, h in (("summary", "summary"), ("websites", "websites"), ("twitter_handles", "twitter handles"), ("maiden_name", "maiden name"))
    ])
    fields = rows.select(*TRACE, "person_key", F.explode(values).alias("f")).select(*TRACE, "person_key", "f.*")
    out.add("profile_fields", fields.filter(F.col("field_value").isNotNull()))
    # Rows after the first usable one are not looked at.
    first = named.filter("name <> ''").groupBy(*SCOPE, "source_file").agg(F.min("row_no").alias("_first"))
    seen = named.join(first, [*SCOPE, "source_file"], "left").filter(F.col("_first").isNull() | (F.col("row_no") <= F.col("_first")))
    _judge(out, seen, "profile", F.col("name") != "")


def _employment(rows: DataFrame, company: Column, title: Column, description: Column, start: Column, end: Column) -> DataFrame:
    return rows.select(
        *TRACE, "person_key", company.alias("company_name"), title.alias("title"), description.alias("description"),
        start.alias("start_date"), end.alias("end_date"), dates.date_only(dates.parse_date(start)).alias("started_on"),
        dates.date_only(dates.parse_date(end)).alias("ended_on"), end.isNull().alias("is_current"),
    )


def normalize_positions(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    rows = dataset_rows(raw, "positions").withColumns({
        "company": t.company_name(pick("company name", "company")), "position": t.title(pick("title", "position"))})
    usable = F.col("company").isNotNull() | F.col("position").isNotNull()
    _judge(out, rows, "positions", usable)
    kept = _owned(rows.filter(usable), owner)
    out.add("employment", _employment(kept, F.col("company"), F.col("position"), t.optional(pick("description")),
                                      t.optional(pick("started on", "start date")), t.optional(pick("finished on", "end date"))))
    _companies(out, kept, F.col("company"))


def normalize_volunteering(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    rows = dataset_rows(raw, "volunteering").withColumns({
        "company": t.company_name(pick("company name", "organization")), "position": t.title(pick("role", "title"))})
    usable = F.col("company").isNotNull() | F.col("position").isNotNull()
    _judge(out, rows, "volunteering", usable)
    kept = _owned(rows.filter(usable), owner)
    title = F.coalesce(F.concat("position", F.lit(" (volunteer)")), F.lit("Volunteer"))
    out.add("employment", _employment(kept, F.col("company"), title, t.optional(pick("description", "cause")),
                                      t.optional(pick("started on", "start date")), t.optional(pick("finished on", "end date"))))
    _companies(out, kept, F.col("company"))


def normalize_education(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    rows = dataset_rows(raw, "education").withColumn("school", t.school(pick("school name", "school")))
    _judge(out, rows, "education", F.col("school").isNotNull())
    out.add("education", _owned(rows.filter(F.col("school").isNotNull()), owner).select(
        *TRACE, "person_key", "school", t.optional(pick("degree name", "degree")).alias("degree"),
        t.optional(pick("field of study", "notes")).alias("field_of_study"), t.optional(pick("start date", "started on")).alias("start_date"),
        t.optional(pick("end date", "finished on")).alias("end_date")))


def normalize_skills(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    rows = dataset_rows(raw, "skills").withColumn("skill", t.optional(pick("name", "skill", "skill name")))
    _judge(out, rows, "skills", F.col("skill").isNotNull())
    out.add("skills", _owned(rows.filter(F.col("skill").isNotNull()), owner).select(
        *TRACE, "person_key", "skill", t.parse_count(pick("endorsements", "endorsement count")).alias("points")))


def normalize_contacts(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    mails = dataset_rows(raw, "email_addresses").withColumn("value", t.email(pick("email address", "email")))
    _judge(out, mails, "email_addresses", F.col("value").isNotNull())
    # The pattern starts with "yes" or ends with "true"; it is kept as the exports are read today.
    out.add("emails", _owned(mails.filter(F.col("value").isNotNull()), owner).select(
        *TRACE, "person_key", F.col("value").alias("email"), t.clean(pick("primary")).rlike("(?i)^yes|true$").alias("is_primary")))
    phones = dataset_rows(raw, "phone_numbers").withColumn("value", t.phone(pick("number", "phone number", "phone")))
    _judge(out, phones, "phone_numbers", F.col("value").isNotNull())
    out.add("phone_numbers", _owned(phones.filter(F.col("value").isNotNull()), owner).select(
        *TRACE, "person_key", F.col("value").alias("phone_number"), t.optional(pick("type")).alias("type")))


PROFILE_LISTS = {
    "certifications": (("name", "title"), ("authority",), " — ", ""),
    "languages": (("name", "language"), ("proficiency",), " (", ")"),
    "projects": (("title", "name"), (), "", ""),
    "honors": (("title", "name"), (), "", ""),
    "courses": (("name", "title"), (), "", ""),
}


def normalize_profile_lists(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    """One joined field per file and dataset, cut at 8,000 characters. Only as many leading entries
    as can reach that length are gathered, however long the file is."""
    for dataset, (main, extra, opening, closing) in PROFILE_LISTS.items():
        named = t.optional(pick(*main))
        rows = dataset_rows(raw, dataset)
        _judge(out, rows, dataset, named.isNotNull())
        value = named
        if extra:
            detailed = lambda v: t.let(t.optional(pick(*extra)), lambda d: F.when(d.isNotNull(), F.concat(v, F.lit(opening), d, F.lit(closing))).otherwise(v))  # noqa: B023
            value = t.let(named, detailed)
        # A generator makes a value once; a filter on it would make it a second time.
        held = rows.select(*TRACE, "row_no", F.explode(F.array_compact(F.array(value))).alias("value"))
        head = held.groupBy(*SCOPE, "source_file").agg(
            F.sort_array(F.collect_list(F.struct("row_no", "value"))).alias("v"), F.min("ord").alias("ord"))
        joined = F.array_join(F.transform("v", lambda x: x["value"]), "; ")
        out.add("profile_fields", _owned(head, owner).select(*TRACE, "person_key", F.lit(dataset).alias("field_name"), joined.alias("field_value")))


# --- network datasets ----------------------------------------------------------------------------


def _headline(title: Column, company: Column) -> Column:
    return F.when(title.isNotNull() & company.isNotNull(), F.concat(title, F.lit(" at "), company)).otherwise(title)


def connection_rows(raw: DataFrame) -> DataFrame:
    first, last = t.clean(pick("first name", "firstname")), t.clean(pick("last name", "lastname"))
    rows = dataset_rows(raw, "connections").withColumns({
        "first": first, "last": last, "name": t.full_name(first, last),
        "profile_url": t.profile_url(pick("url", "profile url", "public profile url", "profileurl")),
        "email": t.email(pick("email address", "emailaddress", "email")), "company": t.company_name(pick("company", "company name")),
        "position": t.title(pick("position", "title", "job title")),
        "connected_at": dates.parse_date(pick("connected on", "connectedon", "connection date")),
    })
    key = identity.person_key(F.col("profile_url"), F.col("email"), F.col("name"), F.col("company"))
    return rows.withColumn("person_key", F.when(F.col("name") != "", key))


def normalize_connections(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    rows = out.keep("parsed_connections", connection_rows(raw).drop("row", "row_no", "dataset"))
    _judge(out, rows, "connections", F.col("person_key").isNotNull())
    kept = rows.filter(F.col("person_key").isNotNull())
    c = F.col
    out.add("people", _person(
        kept, name=c("name"), first_name=t.nullif_blank(c("first")), last_name=t.nullif_blank(c("last")), headline=_headline(c("position"), c("company")),
        profile_url=c("profile_url"), email=c("email"), current_company=c("company"), current_title=c("position"), connected_at=c("connected_at"),
        confidence=F.when(c("profile_url").isNotNull(), 100).when(c("email").isNotNull(), 95).otherwise(80)))
    held = kept.filter(c("company").isNotNull() | c("position").isNotNull())
    out.add("employment", held.select(
        *TRACE, "person_key", c("company").alias("company_name"), c("position").alias("title"), _null().alias("description"),
        _null().alias("start_date"), _null().alias("end_date"), _null("date").alias("started_on"), _null("date").alias("ended_on"),
        F.lit(True).alias("is_current")))
    _companies(out, kept, c("company"))
    out.add("emails", kept.filter(c("email").isNotNull()).select(*TRACE, "person_key", "email", F.lit(True).alias("is_primary")))
    # A person repeated in an export is one connection with the earliest date seen.
    out.add("connections", kept.groupBy(*SCOPE, "person_key").agg(
        F.min("connected_at").alias("connected_at"), F.min_by("source_file", "ord").alias("source_file"), F.min("ord").alias("ord")
    ).withColumn("status", F.lit("connected")))


def normalize_invitations(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    rows = dataset_rows(raw, "invitations").join(owner.select(*SCOPE, "owner_name"), SCOPE, "left")
    direction, sender, receiver = F.upper(t.clean(pick("direction"))), t.clean(pick("from")), t.clean(pick("to"))
    outgoing = F.when(direction != "", direction == "OUTGOING").otherwise(t.comparison_key(sender) == F.coalesce("owner_name", F.lit("")))
    rows = rows.withColumn("outgoing", outgoing).withColumns({
        "counterpart": F.when(F.col("outgoing"), receiver).otherwise(sender),
        "url": t.profile_url(F.when(F.col("outgoing"), pick("inviteeprofileurl", "invitee profile url")).otherwise(
            pick("inviterprofileurl", "inviter profile url"))),
    })
    _counterparts(out, rows, "invitations", "invitation", pick("sent at", "sentat", "date"), F.col("counterpart"), F.col("url"))


def _counterparts(out: Canonical, rows: DataFrame, dataset: str, kind: str, at: Column, name: Column, url: Column,
                  first: Column | None = None, last: Column | None = None) -> None:
    """People known by a name and perhaps a profile, and the touchpoint with each."""
    shown = F.coalesce(t.nullif_blank(name), url)
    rows = rows.withColumns({"shown": shown, "at": dates.parse_date(at), "url": url}).withColumn(
        "person_key", F.when(F.col("shown").isNotNull(), identity.person_key(F.col("url"), F.lit(""), F.col("shown"), F.lit(""))))
    _judge(out, rows, dataset, F.col("person_key").isNotNull())
    kept = rows.filter(F.col("person_key").isNotNull())
    extra = {} if first is None else {"first_name": t.nullif_blank(first), "last_name": t.nullif_blank(last)}
    out.add("people", _person(kept, name=F.col("shown"), profile_url=F.col("url"), **extra,
                              confidence=F.when(F.col("url").isNotNull(), 90).otherwise(60)))
    out.add("interactions", kept.select(*TRACE, "person_key", F.lit(kind).alias("kind"), F.col("at").alias("occurred_at")))


def normalize_company_follows(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    rows = dataset_rows(raw, "company_follows").withColumn("company", t.company_name(pick("organization", "company", "company name")))
    _judge(out, rows, "company_follows", F.col("company").isNotNull())
    _companies(out, rows, F.col("company"))


def normalize_endorsements(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    """The skill counts for the owner even when the endorser cannot be identified."""
    first, last = t.clean(pick("endorser first name")), t.clean(pick("endorser last name"))
    rows = dataset_rows(raw, "endorsements_received").withColumns({
        "first": first, "last": last, "name": t.full_name(first, last),
        "url": t.profile_url(pick("endorser public url", "endorser profile url")), "skill": t.optional(pick("skill name", "skill"))})
    out.add("skills", _owned(rows.filter(F.col("skill").isNotNull()), owner).select(*TRACE, "person_key", "skill", F.lit(1).alias("points")))
    _counterparts(out, rows, "endorsements_received", "endorsement", pick("endorsement date", "date"), F.col("name"), F.col("url"),
                  F.col("first"), F.col("last"))


def normalize_recommendations(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    for dataset, kind in (("recommendations_received", "recommendation_received"), ("recommendations_given", "recommendation_given")):
        first, last = t.clean(pick("first name", "firstname")), t.clean(pick("last name", "lastname"))
        rows = dataset_rows(raw, dataset).withColumns({
            "first": first, "last": last, "name": t.full_name(first, last), "company": t.company_name(pick("company", "company name")),
            "position": t.title(pick("job title", "title")), "at": dates.parse_date(pick("creation date", "date"))})
        key = identity.person_key(F.lit(""), F.lit(""), F.col("name"), F.col("company"))
        rows = rows.withColumn("person_key", F.when(F.col("name") != "", key))
        _judge(out, rows, dataset, F.col("person_key").isNotNull())
        kept, c = rows.filter(F.col("person_key").isNotNull()), F.col
        out.add("people", _person(kept, name=c("name"), first_name=t.nullif_blank(c("first")), last_name=t.nullif_blank(c("last")),
                                  current_company=c("company"), current_title=c("position"), headline=_headline(c("position"), c("company")),
                                  confidence=F.lit(70)))
        _companies(out, kept, c("company"))
        out.add("interactions", kept.select(*TRACE, "person_key", F.lit(kind).alias("kind"), c("at").alias("occurred_at")))


# --- communication, activity, jobs -----------------------------------------------------------------


def _digest(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def normalize_messages(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    rows = dataset_rows(raw, "messages").join(owner, SCOPE, "left").withColumns({
        "content": t.clean(pick("content", "message", "body")), "sender": t.clean(pick("from", "sender name")),
        "receiver": t.clean(pick("to", "recipient")), "sender_url": t.profile_url(pick("sender profile url", "senderprofileurl")),
        "sent_at": dates.parse_date(pick("date", "sent date", "created at")), "folder": F.upper(t.clean(pick("folder")))})
    c, usable = F.col, (F.col("content") != "") | (F.col("sender") != "") | (F.col("receiver") != "")
    _judge(out, rows, "messages", usable)
    mine = (
        F.when(c("folder") == "SENT", True)
        .when(c("owner_slug").isNotNull() & c("sender_url").isNotNull(), t.profile_slug(c("sender_url")) == c("owner_slug"))
        .when(F.coalesce("owner_name", F.lit("")) != "", t.comparison_key(c("sender")) == c("owner_name")).otherwise(False)
    )
    rows = rows.filter(usable).withColumn("mine", mine).withColumns({
        "counterpart_name": t.nullif_blank(F.when(c("mine"), c("receiver")).otherwise(c("sender"))),
        "counterpart_url": F.when(c("mine"), t.profile_url(pick("recipient profile urls", "recipientprofileurls"))).otherwise(c("sender_url"))})
    fallback = F.concat(F.lit("counterpart:"), F.coalesce(
        t.nullif_blank(t.comparison_key(c("counterpart_name"))), t.profile_slug(c("counterpart_url")), F.lit("unknown")))
    rows = rows.withColumns({
        "conversation_key": F.coalesce(t.optional(pick("conversation id", "conversationid")), fallback),
        "subject": t.optional(pick("subject")), "topic": t.optional(pick("conversation title", "subject"))}).drop("row")
    rows = out.keep("parsed_messages", rows)
    out.add("messages", rows.select(
        *TRACE, "conversation_key",
        F.concat_ws("#", "conversation_key", F.coalesce(dates.iso_instant(c("sent_at")), F.concat(F.lit("row"), c("row_no").cast("string"))),
                    _digest(c("content"))).alias("external_id"),
        t.nullif_blank(c("sender")).alias("sender_name"), t.nullif_blank(c("receiver")).alias("recipient_name"),
        c("subject").alias("subject"), c("content").alias("content"), "sent_at",
        F.when(c("mine"), "outbound").otherwise("inbound").alias("direction")))
    first = F.struct(
        F.coalesce("topic", "counterpart_name").alias("title"),
        "counterpart_name", "counterpart_url", "source_file")
    out.add("conversations", rows.groupBy(*SCOPE, "conversation_key").agg(F.min_by(first, "ord").alias("f"), F.min("ord").alias("ord")).select(
        *SCOPE, "conversation_key", "ord", "f.*"))


ACTIVITIES = {
    "comments": ("comment", ("message", "comment", "content"), ("link", "url")),
    "reactions": ("reaction", ("type",), ("link", "url")),
    "shares": ("share", ("sharecommentary", "share commentary", "commentary"), ("sharelink", "share link", "sharedurl", "shared url", "link")),
}


def normalize_activities(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    for dataset, (kind, content, url) in ACTIVITIES.items():
        rows = dataset_rows(raw, dataset).withColumns({
            "content": t.optional(pick(*content)), "url": t.optional(pick(*url)), "at": dates.parse_date(pick("date"))})
        usable = F.col("content").isNotNull() | F.col("url").isNotNull()
        _judge(out, rows, dataset, usable)
        when = F.coalesce(dates.iso_instant(F.col("at")), F.concat(F.lit("row"), F.col("row_no").cast("string")))
        out.add("activities", rows.filter(usable).select(
            *TRACE, F.concat_ws(":", F.lit(kind), F.coalesce("url", F.lit("")), when, _digest(F.col("content"))).alias("external_id"),
            F.lit(kind).alias("activity_type"), F.col("content").alias("content"), F.col("url").alias("content_url"),
            F.col("at").alias("created_at")))


def normalize_jobs(raw: DataFrame, owner: DataFrame, out: Canonical) -> None:
    for dataset, prefix, dated, moment in (
        ("job_applications", "application", ("application date", "applied on", "date"), "applied_at"),
        ("saved_jobs", "saved", ("saved date", "date"), "saved_at"),
    ):
        rows = dataset_rows(raw, dataset).withColumns({
            "position": t.optional(pick("job title", "title")), "company": t.company_name(pick("company name", "company")),
            "url": t.optional(pick("job url", "url")), "at": dates.parse_date(pick(*dated))})
        c, usable = F.col, F.col("position").isNotNull() | F.col("company").isNotNull()
        _judge(out, rows, dataset, usable)
        parts = [t.comparison_key(c("company")), t.comparison_key(c("position"))]
        if dataset == "job_applications":
            parts.append(F.coalesce(dates.iso_instant(c("at")), F.lit("")))
        at = {m: (c("at") if m == moment else _null("timestamp_ntz")) for m in ("applied_at", "saved_at")}
        kept = rows.filter(usable)
        out.add("job_rows", kept.select(
            *TRACE, F.concat(F.lit(prefix + ":"), F.coalesce("url", F.concat_ws("|", *parts))).alias("external_id"),
            F.coalesce("position", "company").alias("title"), c("company").alias("company_name"), "url",
            *[v.alias(k) for k, v in at.items()]))
        _companies(out, kept, c("company"))


def merge_jobs(rows: DataFrame) -> DataFrame:
    """One job per external id: the first title, and for the rest the first value known."""
    known = [identity.first_known(c, F.col("ord")) for c in ("company_name", "url", "applied_at", "saved_at")]
    return rows.groupBy(*SCOPE, "external_id").agg(
        F.min_by("title", "ord").alias("title"), *known, F.min_by("source_file", "ord").alias("source_file"), F.min("ord").alias("ord"))


STEPS = [
    normalize_profile, normalize_contacts, normalize_positions, normalize_education, normalize_skills, normalize_profile_lists,
    normalize_volunteering, normalize_connections, normalize_invitations, normalize_company_follows, normalize_endorsements,
    normalize_recommendations, normalize_messages, normalize_activities, normalize_jobs,
]


CANDIDATES = ["people", "companies", "employment", "connections", "interactions", "emails", "education", "skills", "phone_numbers",
              "profile_fields", "messages", "conversations", "activities", "job_rows"]


def normalize_datasets(raw: DataFrame, keep=lambda name, df: df, together=lambda *actions: [a() for a in actions]) -> Canonical:
    """All datasets of a batch: canonical tables, people merged and weak identities reconciled.

    `keep(name, df)` may store a table and return it as read back; the import job does, so that each
    cell is parsed once and the merges that follow start from plain columns. `together` may run
    independent `keep`s at once."""
    owner, out = keep("owners", owners(raw)), Canonical(keep=keep)
    for step in STEPS:
        step(raw, owner, out)
    held = together(*[lambda name=name: keep(f"candidate_{name}", out.union(name)) for name in CANDIDATES],
                    lambda: keep("outcomes", out.outcomes()))
    rows = dict(zip(CANDIDATES, held))
    people = keep("merged_people", identity.merge_people(rows["people"]))
    remap = keep("weak_to_strong", identity.weak_to_strong(people))
    done = Canonical()
    done.add("outcomes", held[-1])
    done.add("people", identity.reconcile_people(people, remap))
    done.add("companies", identity.merge_companies(rows["companies"]))
    done.add("jobs", merge_jobs(rows["job_rows"]))
    for name in ("employment", "connections", "interactions", "emails"):
        done.add(name, identity.remap_keys(rows[name], remap))
    for name in ("education", "skills", "phone_numbers", "profile_fields", "messages", "conversations", "activities"):
        done.add(name, rows[name])
    return done
