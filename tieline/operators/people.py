"""People list, facets, drill-down and the page of one person, computed for all people at once."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import classify, similarity as sim, text as t
from tieline.operators import pages
from tieline.operators.growth import instant
from tieline.operators.signals import SIGNAL_KEYS, check_signal, signal_array
from tieline.sources.facts import NetworkFacts

PERSON = ["ws", "person_id"]


@dataclass
class PeopleFilter:
    """Every filter is optional; those given must all hold."""

    q: str | None = None
    company: str | None = None
    past_company: str | None = None
    title: str | None = None
    location: str | None = None
    industry: str | None = None
    school: str | None = None
    tag: str | None = None
    connected_after: str | None = None
    connected_before: str | None = None
    signals: list[str] = field(default_factory=list)


def holds_text(c: Column, text: str) -> Column:
    return F.ilike(c, F.lit(f"%{text}%"))


DOCUMENT = ["name", "headline", "current_title", "current_company", "location", "industry", "email"]


def search_document(people: DataFrame) -> Column:
    return sim.tokens(F.concat_ws(" ", *DOCUMENT))


def text_match(term: str) -> Column:
    """Full text, or part of the name or company, or a similar name."""
    term = term.strip()
    wanted = sim.tokens(F.lit(term))
    return (
        sim.matches_all(F.col("_document"), wanted) | holds_text(F.col("name"), term)
        | F.coalesce(holds_text(F.col("current_company"), term), F.lit(False))
        | (sim.similarity(F.col("name"), F.lit(term)) > sim.SIMILAR_ABOVE)
    )


def text_rank(term: str) -> Column:
    term = term.strip()
    return F.round(F.greatest(
        sim.token_rank(F.col("_document"), sim.tokens(F.lit(term))), sim.similarity(F.col("name"), F.lit(term))
    ), 9)


def same_company(employment: DataFrame, name: str, current: bool) -> DataFrame:
    """People with a current (or former) row at the company a name normalises to."""
    at = employment.filter(F.col("is_current") if current else ~F.col("is_current"))
    return at.filter(F.col("company_key") == t.company_key(F.lit(name))).select(*PERSON).distinct()


def filter_people(flagged: DataFrame, wanted: PeopleFilter, employment: DataFrame | None = None,
                  education: DataFrame | None = None, person_tags: DataFrame | None = None) -> DataFrame:
    """Column filters first, so they reach the scan; then semi joins for the child tables."""
    for key in wanted.signals:
        check_signal(key)
    out = flagged
    if wanted.title:
        out = out.filter(holds_text(F.col("current_title"), wanted.title))
    if wanted.location:
        out = out.filter(holds_text(F.col("location"), wanted.location))
    if wanted.industry:
        out = out.filter(F.lower("industry") == wanted.industry.lower())
    if wanted.connected_after:
        out = out.filter(F.col("connected_at") >= instant(wanted.connected_after))
    if wanted.connected_before:
        out = out.filter(F.col("connected_at") <= instant(wanted.connected_before))
    for key in wanted.signals:
        out = out.filter(F.col(key))
    out = out.withColumn("rank", F.lit(0.0))
    if wanted.q and wanted.q.strip():
        out = out.withColumn("_document", search_document(out)).filter(text_match(wanted.q))
        out = out.withColumn("rank", text_rank(wanted.q)).drop("_document")
    if wanted.company:
        out = out.join(same_company(employment, wanted.company, True), PERSON, "left_semi")
    if wanted.past_company:
        out = out.join(same_company(employment, wanted.past_company, False), PERSON, "left_semi")
    if wanted.school:
        out = out.join(education.filter(holds_text(F.col("school"), wanted.school)).select(*PERSON), PERSON, "left_semi")
    if wanted.tag:
        out = out.join(person_tags.filter(F.lower("tag") == wanted.tag.lower()).select(*PERSON), PERSON, "left_semi")
    return out


def sort_order(sort: str) -> list[Column]:
    return pages.columns_of(pages.people_order(sort))


def page_of(df: DataFrame, sort: str, page: int, limit: int) -> DataFrame:
    """One page per workspace. The rank filter lets Spark drop rows beyond the page before the
    shuffle, so a large workspace sends page × limit rows per task and no more."""
    rank = F.row_number().over(W.partitionBy("ws").orderBy(*sort_order(sort)))
    return df.withColumn("position", rank).filter(F.col("position") <= page * limit).filter(
        F.col("position") > (page - 1) * limit
    )


def totals(df: DataFrame) -> DataFrame:
    return df.groupBy("ws").agg(F.count(F.lit(1)).alias("total"))


def with_tags(people: DataFrame, person_tags: DataFrame) -> DataFrame:
    """Sorted tag names per person; a person holds each tag once, so the array is bounded by the vocabulary."""
    held = person_tags.groupBy(*PERSON).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return people.join(held, PERSON, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def list_people(flagged: DataFrame, wanted: PeopleFilter, employment: DataFrame, education: DataFrame,
                person_tags: DataFrame, sort: str | None = None, page: int = 1, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(page rows with signals and tags, totals). Tags are looked up for the page only."""
    chosen = filter_people(flagged, wanted, employment, education, person_tags)
    rows = page_of(chosen, sort or ("relevance" if wanted.q else "connected_desc"), page, limit)
    tags = person_tags.join(rows.select(*PERSON), PERSON, "left_semi")
    return with_tags(rows.withColumn("signals", signal_array()).drop(*SIGNAL_KEYS), tags), totals(chosen)


def top_per_workspace(counts: DataFrame, limit: int) -> DataFrame:
    """Largest counts first, then by value."""
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.col("count").desc(), F.col("value").asc()))
    return counts.withColumn("position", rank).filter(F.col("position") <= limit)


TOP_COLUMNS = ["current_title", "location", "industry", "current_company"]


def value_counts(people: DataFrame, column: str) -> DataFrame:
    if column not in TOP_COLUMNS:
        raise ValueError(f"unsupported facet column {column!r}")
    return (
        people.filter(F.col(column).isNotNull()).groupBy("ws", F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def school_counts(education: DataFrame) -> DataFrame:
    return (
        education.filter(F.col("school").isNotNull()).select("ws", "person_id", F.col("school").alias("value")).distinct()
        .groupBy("ws", "value").agg(F.count(F.lit(1)).alias("count"))
    )


def tag_counts(tags: DataFrame, person_tags: DataFrame) -> DataFrame:
    """People per tag; tags nobody has keep 0. Counted before the join, which is one row per tag."""
    used = person_tags.groupBy("ws", "tag").agg(F.count(F.lit(1)).alias("count"))
    return tags.select("ws", "tag").join(used, ["ws", "tag"], "left").select(
        "ws", F.col("tag").alias("value"), F.coalesce("count", F.lit(0)).alias("count")
    )


def facets(people: DataFrame, education: DataFrame, companies: DataFrame, tags: DataFrame, person_tags: DataFrame,
           limit: int = 25) -> DataFrame:
    """(ws, facet, position, value, count)."""
    by_company = companies.filter("current_count > 0").select("ws", F.col("name").alias("value"), F.col("current_count").alias("count"))
    parts = {
        "company": by_company, "location": value_counts(people, "location"), "industry": value_counts(people, "industry"),
        "title": value_counts(people, "current_title"), "school": school_counts(education), "tag": tag_counts(tags, person_tags),
    }
    out = None
    for name, counts in parts.items():
        part = top_per_workspace(counts, limit).select("ws", F.lit(name).alias("facet"), "position", "value", "count")
        out = part if out is None else out.unionByName(part)
    return out


# --- drill-down -----------------------------------------------------------------------------

METRICS = ["company", "former_company", "title", "role_family", "seniority", "industry", "location", "city", "country",
           "school", "recent", "changed_company", "new_since_import"]


def records_for_metric(facts: NetworkFacts, metric: str, value: str = "") -> DataFrame:
    """The people behind a metric's value. An unknown metric selects nobody."""
    v, people = value.strip().lower(), facts.people
    if metric == "company":
        named = t.key_of(F.col("current_company"))
        return people.filter((t.effective_key(F.col("current_company_key"), F.col("current_company")) == v) | (named == v))
    if metric == "former_company":
        at = facts.employment.filter(~F.col("is_current") & (t.effective_key(F.col("company_key"), F.col("company_name")) == v))
        return people.join(at.select(*PERSON), PERSON, "left_semi")
    if metric == "title":
        return people.filter(t.key_of(F.col("current_title")) == v)
    if metric == "role_family":
        return classify.with_role_family(people, F.col("current_title"), "_c").filter(F.col("_c.key") == v).drop("_c")
    if metric == "seniority":
        return classify.with_seniority(people, F.col("current_title"), "_c").filter(F.col("_c.key") == v).drop("_c")
    if metric == "industry":
        classed = classify.with_industry(people, F.col("industry"), F.col("current_title"), F.col("current_company"), "_c")
        return classed.filter(F.col("_c.key") == v).drop("_c")
    if metric in ("location", "city", "country"):
        return people.filter((F.col("location") != "") & F.contains(F.lower("location"), F.lit(v)))
    if metric == "school":
        at = facts.education.filter(t.key_of(F.col("school")) == v)
        return people.join(at.select(*PERSON), PERSON, "left_semi")
    if metric == "recent":
        return people.filter(F.col("connected_at").isNotNull())
    if metric == "changed_company":
        from tieline.operators.mobility import multiple_employers

        return people.join(multiple_employers(people, facts.employment).select(*PERSON), PERSON, "left_semi")
    if metric == "new_since_import":
        latest = facts.imports.filter("had_connections").groupBy("ws").agg(
            F.max(F.struct("uploaded_at", "import_id")).alias("_latest")
        ).select("ws", F.col("_latest.import_id").alias("first_import_id"))
        return people.join(latest, ["ws", "first_import_id"], "left_semi")
    return people.limit(0)


# --- one person's page, for everybody ----------------------------------------------------------


def employer_sets(people: DataFrame, employment: DataFrame) -> DataFrame:
    """(ws, person_id, is_self, employers): each person's distinct employers, most popular first.

    The array holds one person's employers; many people share the same one."""
    rows = employment.filter(F.col("company_key").isNotNull()).select(*PERSON, "company_key").distinct()
    owners = people.filter("is_self").select(*PERSON, F.lit(True).alias("is_self"))
    rows = rows.join(owners, PERSON, "left").withColumn("is_self", F.coalesce("is_self", F.lit(False)))
    size = rows.groupBy("ws", "company_key").agg((-F.count(F.lit(1))).alias("_size"))
    return (
        rows.join(size, ["ws", "company_key"])
        .groupBy(*PERSON, "is_self").agg(F.sort_array(F.collect_list(F.struct("_size", "company_key"))).alias("_set"))
        .select(*PERSON, "is_self", F.transform("_set", lambda x: x["company_key"]).alias("employers"))
    )


SLOT_PEOPLE = 16_384  # numbered together on average; a bitmap has room for twice as many


def numbered_people(rows: DataFrame, slot_people: int = SLOT_PEOPLE) -> DataFrame:
    """(ws, person_id, slot, bit): dense numbers of a workspace's people. They are dealt to slots by an even hash first, so that no task numbers
    a whole workspace, and numbered from 0 in their slot."""
    total = rows.groupBy("ws").agg(F.count(F.lit(1)).alias("_total"))
    slot = F.pmod(F.xxhash64("person_id"), F.ceil(F.col("_total") / slot_people)).alias("slot")
    bit = F.row_number().over(W.partitionBy("ws", "slot").orderBy("person_id")) - 1
    return rows.join(total, "ws").select(*PERSON, slot).withColumn("bit", bit.cast("long"))


RANGE_SLOTS, BLOCK_SETS = 16, 4096  # slots and sets of one task


def people_of_sets(sets: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """(ws, set, _n): how many people the bitmaps of each set's employers hold together, over the slots given."""
    counts = np.zeros(len(sets), np.int64)
    keys = bitmaps.column("company_key").combine_chunks().dictionary_encode()
    number = {k: i for i, k in enumerate(keys.dictionary.to_pylist())}
    employers = sets.column("employers").to_pylist()
    named = np.array([number.get(k, -1) for e in employers for k in e], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(e) for e in employers])
    slots, keys = bitmaps.column("slot").to_numpy(), keys.indices.to_numpy()
    bits = bitmaps.column("bits").combine_chunks()
    for slot in np.unique(slots):
        at = np.flatnonzero(slots == slot)
        words = np.frombuffer(b"".join(bits.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)
        place = np.full(len(number) + 1, -1)  # the last one is for employers without people
        place[keys[at]] = np.arange(len(at))
        rows = place[named]
        rows, whose = rows[rows >= 0], owner[rows >= 0]
        for start in range(0, len(sets), 256):  # a few sets at a time, so that the bitmaps side by side stay small
            low, high = np.searchsorted(whose, [start, start + 256])
            if low == high:
                continue
            first = np.flatnonzero(np.diff(whose[low:high], prepend=-1))
            held = np.bitwise_or.reduceat(words[rows[low:high]], first, axis=0)
            counts[whose[low:high][first]] += np.bitwise_count(held).sum(axis=1, dtype=np.int64)
    return pa.table({"ws": sets.column("ws"), "set": sets.column("set"), "_n": counts})


def colleague_counts(people: DataFrame, employment: DataFrame, slot_people: int = SLOT_PEOPLE, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(ws, person_id, colleagues): distinct other people, owners aside, who share an employer.

    An employer's people are bitmaps over the people of each slot. The people of a set of employers are these bitmaps or-ed, once for each
    distinct set, and counted. So neither the size of an employer nor the number of a person's employers matters, and pairs of
    people are never formed; a slot's bitmap is 4 KiB however many people it holds.

    Sets are dealt to blocks and slots to ranges. A task gets the sets of a block, and of a range the bitmaps of the employers they name: a bitmap
    moves once for a block, not for each set that names it. The work remains sets times slots, that is by nature of the question."""
    rows = employment.filter(F.col("company_key").isNotNull()).select(*PERSON, "company_key").distinct()
    owners = people.filter("is_self").select(*PERSON, F.lit(True).alias("is_self"))
    sets = rows.groupBy(*PERSON).agg(F.sort_array(F.collect_list("company_key")).alias("employers")).join(owners, PERSON, "left")
    sets = sets.withColumn("is_self", F.coalesce("is_self", F.lit(False))).withColumn("set", F.sha2(F.to_json("employers"), 256))
    others = rows.join(owners, PERSON, "left_anti")
    places = numbered_people(others.select(*PERSON).distinct(), slot_people)
    held = others.join(places, PERSON).groupBy("ws", "company_key", "slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = held.withColumn("range", F.floor(F.col("slot") / RANGE_SLOTS))
    distinct_sets = sets.groupBy("ws", "set").agg(F.first("employers").alias("employers"))
    blocks = distinct_sets.groupBy("ws").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("_blocks"))
    dealt = distinct_sets.join(blocks, "ws").withColumn("block", F.pmod(F.xxhash64("set"), F.col("_blocks"))).drop("_blocks")
    named = dealt.select("ws", "block", F.explode("employers").alias("company_key")).distinct()
    wanted = named.join(held, ["ws", "company_key"]).select("ws", "block", "range", "slot", "company_key", "bits")
    ranges = held.select("ws", "range").distinct()
    # Both sides come from the same rows, so the columns of one are named anew.
    wanted = wanted.select(*[F.col(c).alias(c) for c in wanted.columns])
    met = (
        dealt.join(ranges, "ws").groupBy("ws", "block", "range").cogroup(wanted.groupBy("ws", "block", "range"))
        .applyInArrow(people_of_sets, dealt.select("ws", "set", F.lit(0).cast("long").alias("_n")).schema)
    )
    per_set = met.groupBy("ws", "set").agg(F.sum("_n").alias("_n"))
    return sets.join(per_set, ["ws", "set"], "left").select(
        *PERSON, (F.coalesce("_n", F.lit(0)) - F.when(F.col("is_self"), 0).otherwise(1)).alias("colleagues")
    )


def shared_context(people: DataFrame, employment: DataFrame, education: DataFrame, companies: DataFrame) -> DataFrame:
    """(ws, person_id, kind, value): employers and schools a person shares with the owner."""
    from tieline.sources.facts import owner_companies, owner_schools

    at = (
        employment.select(*PERSON, "company_key").distinct()
        .join(owner_companies(people, employment), ["ws", "company_key"], "left_semi")
        .join(companies.select("ws", "company_key", F.col("name").alias("value")), ["ws", "company_key"])
        .select(*PERSON, F.lit("company").alias("kind"), "value")
    )
    studied = (
        education.withColumn("school_key", F.lower("school"))
        .join(owner_schools(people, education), ["ws", "school_key"], "left_semi")
        .select(*PERSON, F.lit("school").alias("kind"), F.col("school").alias("value"))
    )
    return at.unionByName(studied)


# Child rows are shown from the largest of these down, nulls last, as far as a table has them; its other columns settle ties.
DISPLAY = {
    "employment": ["is_current", "started_on", "observed_at", "employment_id"], "education": ["end_date"], "skills": ["endorsements"],
    "conversations": ["last_message_at"], "interactions": ["occurred_at", "interaction_id"], "notes": ["created_at"],
}


def placed(section: str, rows: DataFrame) -> DataFrame:
    """`rows` with their position on their person's page."""
    first = [c for c in DISPLAY[section] if c in rows.columns]
    rest = [c for c in rows.columns if c not in [*PERSON, *first]]
    order = [*[F.col(c).desc_nulls_last() for c in first], *[F.col(c).asc_nulls_last() for c in rest]]
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*PERSON).orderBy(*order)))


def profile_sections(employment: DataFrame, education: DataFrame, conversations: DataFrame, interactions: DataFrame,
                     skills: DataFrame, notes: DataFrame | None = None, interaction_limit: int | None = 50) -> dict[str, DataFrame]:
    """The child rows of every person's page with their order of display. Rows stay rows: no person's
    history is gathered into one value. Interactions keep the `interaction_limit` latest, as the page shows, or all without a limit."""
    job = ["employment_id", "company_id", "company_name", "title", "description", "start_date", "end_date", "is_current", "started_on", "observed_at"]
    tables = {
        "employment": employment.select(*PERSON, *[c for c in job if c in employment.columns]),
        "education": education,
        "skills": skills,
        "conversations": conversations,
        "interactions": interactions.select(*PERSON, "kind", "occurred_at", "interaction_id"),
    }
    if notes is not None:
        tables["notes"] = notes
    sections = {name: placed(name, rows) for name, rows in tables.items()}
    touches = sections["interactions"].select(*PERSON, "position", "kind", "occurred_at")
    if interaction_limit is not None:
        touches = touches.filter(F.col("position") <= interaction_limit)
    return {**sections, "interactions": touches}


def profile_pages(detail: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """The whole pages as rows: section `person` is a person's detail, the others their child rows; columns of other sections are null.
    Rows without a person (conversations with strangers) are on no page, and go before positions are numbered."""
    out = detail.withColumns({"section": F.lit("person"), "position": F.lit(1)})
    for name, rows in sections.items():
        rows = rows.filter(F.col("ws").isNotNull() & F.col("person_id").isNotNull()).withColumn("section", F.lit(name))
        out = out.unionByName(rows, allowMissingColumns=True)
    return out
