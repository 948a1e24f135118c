"""Affiliation graph: owner, company and school hubs, weighted edges. No person-person edges exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

MAX_HUBS, MAX_PEOPLE, MAX_SCHOOLS = 40, 300, 12
CAVEAT = (
    "This is an affiliation graph (you → company/school → people), not a map of who knows whom. "
    "LinkedIn exports do not include connections among your connections. "
    "Sharing a company is not evidence that two people know each other."
)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _node(df: DataFrame, node, kind: str, label, size, entity=None, current=None, former=None) -> DataFrame:
    empty = F.lit(None).cast("string")
    return df.select(
        "ws", node.alias("node_id"), F.lit(kind).alias("type"), label.alias("label"), size.cast("long").alias("size"),
        (empty if entity is None else entity.cast("string")).alias("entity_id"),
        (F.lit(None) if current is None else current).cast("long").alias("current"),
        (F.lit(None) if former is None else former).cast("long").alias("former"),
    )


def _edge(df: DataFrame, source, target, kind, weight) -> DataFrame:
    return df.select("ws", source.alias("source"), target.alias("target"), kind.alias("type"), weight.cast("long").alias("weight"))


def hubs(companies: DataFrame, min_size: int = 1, limit: int = MAX_HUBS) -> DataFrame:
    rank = F.row_number().over(
        W.partitionBy("ws").orderBy(F.col("connection_count").desc(), F.col("name").asc(), F.col("company_id").asc())
    )
    return companies.filter(F.col("connection_count") >= max(1, min_size)).withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def hidden_companies(companies: DataFrame, shown: DataFrame, min_size: int = 1) -> DataFrame:
    """(ws, hidden, people) of the companies beyond the hubs: everything minus what is shown, so
    the tail is never ranked."""
    sums = lambda df, n, p: df.groupBy("ws").agg(F.count(F.lit(1)).alias(n), F.sum("connection_count").alias(p))
    every = sums(companies.filter(F.col("connection_count") >= max(1, min_size)), "n", "p")
    return every.join(sums(shown, "sn", "sp"), "ws").select(
        "ws", (F.col("n") - F.col("sn")).alias("hidden"), (F.col("p") - F.col("sp")).alias("people")
    ).filter("hidden > 0")


def school_hubs(education: DataFrame, min_size: int = 1, limit: int = MAX_SCHOOLS) -> DataFrame:
    from tieline.operators.people import school_counts, top_per_workspace

    return top_per_workspace(school_counts(education).filter(F.col("count") >= max(1, min_size)), limit)


def moved_to(employment: DataFrame, shown: DataFrame) -> DataFrame:
    """(ws, from_id, to_id, weight): distinct people with a former row at one hub and a current one
    at another. Only hubs are kept first, so one person holds at most as many companies as there are hubs."""
    visible = shown.select("ws", "company_id")
    stays = employment.join(visible, ["ws", "company_id"], "left_semi")
    per_person = stays.groupBy("ws", "person_id").agg(
        F.collect_set(F.when(~F.col("is_current"), F.col("company_id"))).alias("left"),
        F.collect_set(F.when(F.col("is_current"), F.col("company_id"))).alias("now"),
    )
    return (
        per_person.select("ws", F.explode("left").alias("from_id"), "now").select("ws", "from_id", F.explode("now").alias("to_id"))
        .filter("from_id <> to_id").groupBy("ws", "from_id", "to_id").agg(F.count(F.lit(1)).alias("weight"))
    )


def overview(people: DataFrame, companies: DataFrame, employment: DataFrame, education: DataFrame,
             min_size: int = 1, include_schools: bool = True) -> Graph:
    """`people` holds the owners; `education` leaves them out; `companies` carries its counters."""
    owner = people.groupBy("ws").agg(
        F.min(F.when(F.col("is_self"), F.col("person_id"))).alias("id"), F.min_by("name", F.when(F.col("is_self"), F.col("person_id"))).alias("name")
    )
    shown, me = hubs(companies, min_size), F.lit("self")
    rest = hidden_companies(companies, shown, min_size)
    hub = F.concat(F.lit("company:"), F.col("company_id"))
    tail = F.lit("cluster:companies")
    nodes = _node(owner, me, "self", F.coalesce("name", F.lit("You")), F.lit(1), F.col("id"))
    nodes = nodes.unionByName(_node(shown, hub, "company", F.col("name"), F.col("connection_count"), F.col("company_id"),
                                    F.col("current_count"), F.col("former_count")))
    nodes = nodes.unionByName(_node(rest, tail, "cluster", F.concat(F.col("hidden").cast("string"), F.lit(" smaller companies")), F.col("people")))
    edges = _edge(shown.filter("current_count > 0"), me, hub, F.lit("works_at"), F.col("current_count"))
    edges = edges.unionByName(_edge(shown.filter("former_count > 0"), me, hub, F.lit("worked_at"), F.col("former_count")))
    edges = edges.unionByName(_edge(rest, me, tail, F.lit("in_cluster"), F.col("people")))
    ends = [F.concat(F.lit("company:"), F.col(c)) for c in ("from_id", "to_id")]
    edges = edges.unionByName(_edge(moved_to(employment, shown), *ends, F.lit("moved_to"), F.col("weight")))
    if include_schools:
        schools, place = school_hubs(education, min_size), F.concat(F.lit("school:"), F.col("value"))
        nodes = nodes.unionByName(_node(schools, place, "school", F.col("value"), F.col("count")))
        edges = edges.unionByName(_edge(schools, me, place, F.lit("studied_at"), F.col("count")))
    return Graph(nodes, edges)


def company_graphs(people: DataFrame, companies: DataFrame, employment: DataFrame, limit: int = MAX_PEOPLE) -> tuple[Graph, DataFrame]:
    """The focused graph of every company, as (graph keyed by company_id, hidden people).
    At most `limit` people are drawn, those with the lowest ids, current rows first."""
    others = people.filter(~F.col("is_self")).select("ws", "person_id", "name")
    per_person = (
        employment.filter(F.col("company_id").isNotNull()).groupBy("ws", "company_id", "person_id")
        .agg(F.max("is_current").alias("is_current"),
             F.max_by("title", F.struct("is_current", "observed_at", "employment_id")).alias("title"))
        .join(others, ["ws", "person_id"])
    )
    rank = F.row_number().over(W.partitionBy("ws", "company_id").orderBy("person_id"))
    drawn = per_person.withColumn("_rank", rank).filter(F.col("_rank") <= limit)
    hub, person = F.concat(F.lit("company:"), F.col("company_id")), F.concat(F.lit("person:"), F.col("person_id").cast("string"))
    nodes = companies.select("ws", "company_id", hub.alias("node_id"), F.lit("company").alias("type"), F.col("name").alias("label"),
                             F.col("connection_count").cast("long").alias("size"), F.lit(None).cast("string").alias("title"))
    nodes = nodes.unionByName(drawn.select("ws", "company_id", person.alias("node_id"), F.lit("person").alias("type"),
                                           F.col("name").alias("label"), F.lit(1).cast("long").alias("size"), "title"))
    edges = companies.select("ws", "company_id", F.lit("self").alias("source"), hub.alias("target"), F.lit("works_at").alias("type"),
                             F.col("connection_count").cast("long").alias("weight"))
    edges = edges.unionByName(drawn.select("ws", "company_id", person.alias("source"), hub.alias("target"),
                                           F.when(F.col("is_current"), "works_at").otherwise("worked_at").alias("type"), F.lit(1).cast("long").alias("weight")))
    visible = drawn.groupBy("ws", "company_id").agg(F.count(F.lit(1)).alias("_shown"))
    hidden = companies.join(visible, ["ws", "company_id"], "left").select(
        "ws", "company_id", F.greatest(F.col("connection_count") - F.coalesce("_shown", F.lit(0)), F.lit(0)).alias("hidden_people")
    )
    return Graph(nodes, edges), hidden
