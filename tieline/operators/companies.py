"""Company list and company pages, for all companies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tieline.operators.people import employer_sets, holds_text


def list_companies(companies: DataFrame, q: str | None = None, sort: str = "connections", page: int = 1, limit: int = 25) -> DataFrame:
    orders = {"connections": [F.col("connection_count").desc(), F.col("name").asc()], "name": [F.col("name").asc()]}
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}")
    chosen = companies.filter(holds_text(F.col("name"), q)) if q else companies
    rank = F.row_number().over(W.partitionBy("ws").orderBy(*orders[sort], F.col("company_id").asc()))
    return chosen.withColumn("position", rank).filter(F.col("position") <= page * limit).filter(F.col("position") > (page - 1) * limit)


def company_people(employment: DataFrame, people: DataFrame) -> DataFrame:
    """One row per company and person: the current row if any, else the one observed last."""
    best = F.row_number().over(
        W.partitionBy("ws", "company_id", "person_id").orderBy(
            F.col("is_current").desc(), F.col("observed_at").desc(), F.col("employment_id").desc())
    )
    return (
        employment.filter(F.col("company_id").isNotNull())
        .select("ws", "company_id", "person_id", "title", "is_current", "observed_at", "employment_id")
        .withColumn("_best", best).filter("_best = 1")
        .join(people.select("ws", "person_id", "name", "location", "profile_url"), ["ws", "person_id"])
        .select("ws", "company_id", "person_id", "name", "title", "is_current", "location", "profile_url")
    )


def _top(pairs: DataFrame, section: str, limit: int) -> DataFrame:
    """Distinct people per company and value, the largest `limit` values of each company."""
    counts = (
        pairs.filter(F.col("value").isNotNull()).distinct().groupBy("ws", "company_id", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    rank = F.row_number().over(W.partitionBy("ws", "company_id").orderBy(F.col("count").desc(), F.col("value").asc()))
    return (
        counts.withColumn("position", rank).filter(F.col("position") <= limit)
        .select("ws", "company_id", F.lit(section).alias("section"), "position", "value", "count")
    )


def company_profile(employment: DataFrame, people: DataFrame, education: DataFrame) -> DataFrame:
    """(ws, company_id, section, position, value, count) for titles, locations and schools.
    Schools count the owner too, unlike titles and locations."""
    rows = employment.filter(F.col("company_id").isNotNull()).select("ws", "company_id", "person_id", "title").distinct()
    others = people.filter(~F.col("is_self")).select("ws", "person_id", "location")
    known = rows.join(others, ["ws", "person_id"])
    titles = known.select("ws", "company_id", "person_id", F.col("title").alias("value"))
    places = known.select("ws", "company_id", "person_id", F.col("location").alias("value"))
    schools = rows.select("ws", "company_id", "person_id").distinct().join(
        education.select("ws", "person_id", F.col("school").alias("value")), ["ws", "person_id"]
    )
    return _top(titles, "title", 10).unionByName(_top(places, "location", 10)).unionByName(_top(schools, "school", 10))


BLOCK = 64  # employers of a set that meet another block of it in one row


def related_companies(employment: DataFrame, people: DataFrame, companies: DataFrame, limit: int = 8, block: int = BLOCK) -> DataFrame:
    """The `limit` companies that share most people, the owner among them, with each company; ties by name, then id.

    This is the product of the (company, set of employers) matrix with its transpose, sets weighted by the people who have them, without
    the pairs that cannot be among the first `limit`:

    * Two companies that share one set only tie there with all others of the set, so the set's first names stand for them. Companies
      in a single set never enter the product, whatever the size of the set.
    * A company whose sets hold fewer people in all than `limit` others already share with this one is left out.

    What remains of a large set is multiplied block by block, each pair of blocks a row of its own. `companies` has one row per key."""
    sets = employer_sets(people, employment).filter(F.size("employers") > 1).groupBy("ws", "employers").agg(F.count(F.lit(1)).alias("n"))
    held = sets.select("ws", F.sha2(F.to_json("employers"), 256).alias("set"), "n", F.explode("employers").alias("company_key"))
    held = held.join(companies.select("ws", "company_key", "company_id", "name"), ["ws", "company_key"]).drop("company_key")
    inside = W.partitionBy("ws", "set")
    by_name = inside.orderBy("name", "company_id")
    held = held.withColumn("size", F.count(F.lit(1)).over(inside)).withColumn("place", F.row_number().over(by_name))
    # Sets of more than `limit` companies: each shares `n` people with at least `limit` others.
    known = held.groupBy("ws", "company_id").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("most"), F.coalesce(F.max(F.when(F.col("size") > limit, F.col("n"))), F.lit(0)).alias("least"))
    held = held.join(known, ["ws", "company_id"])

    this, other = F.struct("company_id", "name", "sets", "most", "least"), F.col("other")
    first = F.collect_list(F.when(F.col("place") <= limit + 1, this)).over(inside)
    tied = held.withColumn("other", first).select("ws", this.alias("this"), "n", F.explode("other").alias("other"))
    tied = tied.filter((F.col("this.company_id") != other["company_id"]) & ((F.col("this.sets") == 1) | (other["sets"] == 1)))

    many = held.filter("sets > 1").withColumn("at", F.row_number().over(by_name) - 1).withColumn("blocks", F.ceil(F.count(F.lit(1)).over(inside) / block))
    many = many.withColumn("at", F.floor(F.col("at") / block)).select(
        "ws", "set", "n", "at", this.alias("this"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("meets"))
    lower = F.col("at") <= F.col("meets")
    tiles = many.groupBy("ws", "set", "n", F.least("at", "meets").alias("i"), F.greatest("at", "meets").alias("j")).agg(
        F.collect_list(F.when(lower, F.col("this"))).alias("left"), F.collect_list(F.when(~lower | (F.col("at") == F.col("meets")), F.col("this"))).alias("right"))
    one_way = tiles.select("ws", "n", "i", "j", "left", F.explode("right").alias("b")).select("ws", "n", "i", "j", "b", F.explode("left").alias("a"))
    ways = F.when(F.col("i") == F.col("j"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    product = one_way.filter("a.company_id <> b.company_id").select("ws", "n", F.explode(ways).alias("pair")).filter("pair.b.most >= pair.a.least")

    pairs = product.select("ws", "pair.a.company_id", F.col("pair.b.company_id").alias("other_id"), F.col("pair.b.name").alias("other_name"), "n").unionByName(
        tied.select("ws", "this.company_id", other["company_id"].alias("other_id"), other["name"].alias("other_name"), "n"))
    shared = pairs.groupBy("ws", "company_id", "other_id", "other_name").agg(F.sum("n").alias("shared_people"))
    rank = F.row_number().over(
        W.partitionBy("ws", "company_id").orderBy(F.col("shared_people").desc(), F.col("other_name").asc(), F.col("other_id").asc())
    )
    return (
        shared.withColumn("position", rank).filter(F.col("position") <= limit)
        .select("ws", "company_id", "position", "other_id", "other_name", "shared_people")
    )


def owner_worked_here(employment: DataFrame, people: DataFrame, companies: DataFrame) -> DataFrame:
    mine = (
        employment.join(people.filter("is_self").select("ws", "person_id"), ["ws", "person_id"], "left_semi")
        .select("ws", "company_id").distinct().withColumn("self_worked_here", F.lit(True))
    )
    return companies.join(mine, ["ws", "company_id"], "left").withColumn(
        "self_worked_here", F.coalesce("self_worked_here", F.lit(False))
    )
