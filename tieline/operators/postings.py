"""An inverted index over people, companies and conversations, and what it finds for many terms at once.

A posting `(ws, list, term, id, row, at)` says that a term occurs in a row. A list is a column and the way it is taken apart:

* words of a person's document, in full;
* pieces: runs of three characters of a lower-cased text at each position, the last two filled up, so that every part of a text is a run of
  whole pieces or, below three characters, the start of one;
* grams: trigrams of padded words, for similar names;
* whole values.

Postings are made row by row without a shuffle. A search asks `posting_counts` which of a term's pieces are rare in a workspace, reads the
postings of these only, and tests the few rows found with the same conditions as a search without index. Parts of messages are found by
the positions of their pieces alone, so no message is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import similarity as sim, text as t
from tieline.operators import search as se
from tieline.operators.people import DOCUMENT

FILL = "\u0001"
SPOKEN = "message.content"
PERSON = {"person.document": "word", "person.name": "piece", "person.current_company": "piece", "person.current_title": "piece",
          "person.location": "piece", "person.email": "whole", "person.name~": "gram", "person.current_company~": "gram"}
COMPANY = {"company.name": "piece", "company.name~": "gram"}
TALK = {"talk.title": "piece", SPOKEN: "piece"}
WILD = r"[%_\\]"  # what the pattern of a search takes for more than a character


def pieces(c: Column) -> Column:
    """The piece that starts at each character. A text without characters has one piece of fillers."""
    chars = F.when(F.length(c) > 0, F.split(F.lower(c), "")).when(c.isNotNull(), F.array(F.lit(FILL)))
    at = lambda held, i: F.coalesce(F.get(held, i), F.lit(FILL))
    return t.let(chars, lambda held: F.transform(held, lambda x, i: F.concat(x, at(held, i + 1), at(held, i + 2))))


def _terms(name: str, how: str, c: Column) -> Column:
    """Distinct terms of a list as (list, term)."""
    made = {"word": lambda: sim.tokens(c), "piece": lambda: pieces(c), "gram": lambda: sim.trigrams(c), "whole": lambda: F.array(c)}[how]()
    held = F.filter(F.array_distinct(F.coalesce(made, F.array().cast("array<string>"))), lambda x: x.isNotNull())
    return F.transform(held, lambda x: F.struct(F.lit(name).alias("list"), x.alias("term")))


def _listed(rows: DataFrame, lists: dict[str, str], id_: str, columns: dict[str, Column]) -> DataFrame:
    entries = F.concat(*[_terms(name, how, columns[name.rstrip("~")]) for name, how in lists.items()])
    found = rows.select("ws", F.col(id_).cast("string").alias("id"), F.explode(entries).alias("_entry"))
    return found.select("ws", "_entry.list", "_entry.term", "id", F.lit(None).cast("string").alias("row"), F.lit(None).cast("int").alias("at"))


def postings(people: DataFrame, companies: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Postings of all rows. Null texts have none; rows that repeat have theirs repeated, which no search minds."""
    column = lambda name: F.col(name.split(".")[1].rstrip("~"))
    person = {name: column(name) for name in PERSON if name != "person.document"} | {"person.document": F.concat_ws(" ", *DOCUMENT)}
    spoken = messages.select("ws", F.col("conversation_id").cast("string").alias("id"), F.col("message_id").cast("string").alias("row"),
                             F.posexplode(pieces(F.col("content"))).alias("at", "term"))
    return (
        _listed(people, PERSON, "person_id", person)
        .unionByName(_listed(companies, COMPANY, "company_id", {"company.name": F.col("name")}))
        .unionByName(_listed(conversations, {"talk.title": "piece"}, "conversation_id", {"talk.title": F.col("title")}))
        .unionByName(spoken.select("ws", F.lit(SPOKEN).alias("list"), "term", "id", "row", "at"))
    )


def posting_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("ws", "list", "term").agg(F.count(F.lit(1)).alias("n"))


def terms_frame(spark, terms: list[str]) -> DataFrame:
    """(q): the terms without blanks around them; empty ones find nothing and are left out."""
    given = sorted({x.strip() for x in terms} - {""})
    # Literals, not rows from Python, as the few terms are read by many small steps.
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in given]).cast("array<string>")).alias("q"))


def wanted_terms(terms: DataFrame) -> DataFrame:
    """(q, list, term, short, size, keep): what a row must hold to be found by a list. Of `size` terms, each row sought holds at least one of
    the `keep` rarest. A short term is the start of a piece, in place of a whole one."""
    low = F.lower("q")
    runs = F.filter(F.split(low, WILD), lambda r: r != "")
    whole = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= 3), lambda r: F.transform(
        F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, 3))))
    longest = F.aggregate(runs, F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a))
    ways = {
        "word": (F.array_distinct(sim.tokens(F.col("q"))), F.lit(1)),
        "whole": (F.array(low), F.lit(1)),
        # More than three tenths of a term's trigrams are shared, so one is not among the three tenths that are most common.
        "gram": (sim.trigrams(F.col("q")), None),
        "piece": (F.array_distinct(whole), F.lit(1)),
    }
    out = []
    for name, how in {**PERSON, **COMPANY, **TALK}.items():
        made, keep = ways[how]
        size = F.size("_made")
        keep = size - F.floor(size * 3 / 10).cast("int") if keep is None else keep
        rows = terms.select("q", made.alias("_made"), longest.alias("_longest"))
        out.append(rows.select("q", F.lit(name).alias("list"), F.explode("_made").alias("term"), F.lit(False).alias("short"), size.alias("size"), keep.alias("keep")))
        if how == "piece":
            out.append(rows.filter(size == 0).select("q", F.lit(name).alias("list"), F.col("_longest").alias("term"), F.lit(True).alias("short"),
                                                     F.lit(1).alias("size"), F.lit(1).alias("keep")))
    return reduce(DataFrame.unionByName, out)


def only_terms(wanted: DataFrame) -> Column:
    """A filter on list and term that reaches the scan. It names the terms' pieces, which are as many as the terms have characters."""
    named = wanted.select("list", "term", "short").distinct().collect()
    exact = sorted({r.term for r in named if not r.short})
    starts = sorted({r.term for r in named if r.short})
    by_term = F.col("term").isin(exact) if exact else F.lit(False)
    return F.col("list").isin(sorted({r.list for r in named})) & reduce(lambda a, s: a | F.col("term").startswith(s), starts, by_term)


def rarest(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(q, ws, list, term): the postings to read. A workspace that lacks too many of a list's terms has none."""
    exact = wanted.filter("NOT short").join(counts, ["list", "term"])
    group = W.partitionBy("q", "ws", "list")
    exact = exact.withColumn("_held", F.count(F.lit(1)).over(group)).withColumn("_rank", F.row_number().over(group.orderBy("n", "term")))
    exact = exact.filter("_rank <= keep - (size - _held)")
    begun = wanted.filter("short").withColumnRenamed("term", "_start").join(counts, "list").filter(F.col("term").startswith(F.col("_start")))
    return exact.select("q", "ws", "list", "term").unionByName(begun.select("q", "ws", "list", "term"))


def said(entries: DataFrame, near: DataFrame, terms: DataFrame) -> DataFrame:
    """(q, ws, id): conversations with a message that holds a term, by the positions of its pieces. `near` holds the messages with the term's
    rarest piece (q, ws, row)."""
    low, length = F.lower("q"), F.length(F.lower("q"))
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), length - 3, F.lit(3)), F.array(length - 3)))
    cover = terms.filter(length >= 3).select("q", low.alias("_low"), F.size(offsets).alias("_parts"), F.explode(offsets).alias("_offset"))
    cover = cover.select("q", "_parts", "_offset", F.expr("substring(_low, _offset + 1, 3)").alias("term"))
    placed = (
        entries.filter(F.col("list") == SPOKEN).join(cover, "term").join(near, ["q", "ws", "row"], "left_semi")
        .groupBy("q", "ws", "id", "row", (F.col("at") - F.col("_offset")).alias("_start"), "_parts").agg(F.count_distinct("_offset").alias("_found"))
    )
    return placed.filter("_found = _parts").select("q", "ws", "id").distinct()


def search(entries: DataFrame, counts: DataFrame, people: DataFrame, companies: DataFrame, conversations: DataFrame, messages: DataFrame,
           everyone: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """`search.global_search` for many terms by the index: its columns and the term, q. `conversations` hold message_count and last_message_at.

    Messages are read only for terms with characters that stand for others (%, _ and the backslash)."""
    asked = terms_frame(people.sparkSession, terms)
    wanted = wanted_terms(asked)
    near = only_terms(wanted)
    chosen = rarest(wanted, counts.filter(near))
    hits = entries.filter(near).join(chosen, ["ws", "list", "term"])
    found = hits.filter(F.col("list") != SPOKEN).select("q", "ws", F.split("list", "\\.")[0].alias("kind"), "id").distinct()
    of = lambda kind, id_: found.filter(F.col("kind") == kind).select("q", "ws", F.col("id").alias(id_))
    keyed = lambda rows, id_: rows.withColumn("_id", F.col(id_).cast("string"))
    by = ["ws", "q"]

    persons = keyed(people, "person_id").join(of("person", "_id"), ["ws", "_id"])
    firms = keyed(companies, "company_id").join(of("company", "_id"), ["ws", "_id"])

    plain = [q for q in sorted({q.strip() for q in terms} - {""}) if not any(x in q for x in "%_\\")]
    messages_near = hits.filter(F.col("list") == SPOKEN).select("q", "ws", "id", "row").distinct()
    exact = F.col("q").isin(plain) if plain else F.lit(False)
    short = F.length("q") < 3
    spoken = messages_near.filter(exact & short).select("q", "ws", "id").distinct().unionByName(
        said(entries.filter(near), messages_near.filter(exact & ~short), asked.filter(exact)))
    if len(plain) < asked.count():
        texts = messages.select("ws", F.col("message_id").cast("string").alias("row"), "content")
        wild = messages_near.filter(~exact).join(texts, ["ws", "row"]).filter(se.holds(F.col("content"), F.col("q")))
        spoken = spoken.unionByName(wild.select("q", "ws", "id").distinct())

    names = everyone.select("ws", "person_id", "name")
    talks = keyed(conversations.filter("message_count > 0"), "conversation_id")
    named = keyed(names, "person_id").join(of("person", "_id"), ["ws", "_id"]).filter(se.holds(F.col("name"), F.col("q")))
    by_name = talks.select("ws", "person_id", "_id").join(named.select("q", "ws", "person_id").distinct(), ["ws", "person_id"])
    reached = (
        spoken.select("q", "ws", F.col("id").alias("_id"), F.lit(True).alias("_said"))
        .unionByName(of("talk", "_id").withColumn("_said", F.lit(False)))
        .unionByName(by_name.select("q", "ws", "_id", F.lit(False).alias("_said")))
        .groupBy("q", "ws", "_id").agg(F.max("_said").alias("_said"))
    )
    rows = talks.join(reached, ["ws", "_id"]).join(names, ["ws", "person_id"], "left")
    parts = [se.search_people(persons, F.col("q"), limit, by), se.search_companies(firms, F.col("q"), limit, by), se.best_conversations(rows, F.col("q"), limit, by)]
    return se.ranked(reduce(DataFrame.unionByName, parts), limit, by)
