"""Global search over people, companies and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import similarity as sim
from tieline.operators.people import search_document
TYPES = ["person", "company", "conversation"]
COMPANY_HIT, NAME_HIT, CONVERSATION_SCORE = 0.35, 0.5, 0.2


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def holds(c: Column, q: Column) -> Column:
    return F.ilike(c, F.concat(F.lit("%"), q, F.lit("%")))


def _best(df: DataFrame, order: list[Column], limit: int, by: list[str]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_within", rank).filter(F.col("_within") <= limit)


def _hit(df: DataFrame, by: list[str], kind: str, id_: str, title: Column, subtitle: Column, detail: Column, score: Column) -> DataFrame:
    return df.select(
        *by, F.lit(kind).alias("type"), F.lit(TYPES.index(kind)).alias("_type"), "_within", F.col(id_).cast("string").alias("id"),
        title.alias("title"), subtitle.alias("subtitle"), detail.alias("detail"), score.alias("score"),
    )


def _plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def search_people(people: DataFrame, q: Column, limit: int, by: list[str]) -> DataFrame:
    """Hits of the term `q`, which may be a column of `people`; the best `limit` per value of `by`."""
    wanted = sim.tokens(q)
    rows = (
        people.withColumn("_document", search_document(people)).withColumn("_name", sim.similarity(F.col("name"), q))
        .withColumn("_employer", sim.similarity(F.col("current_company"), q))
    )
    mail = _false(F.col("email") == F.lower(q))
    at = _false(holds(F.col("current_company"), q))
    found = (
        sim.matches_all(F.col("_document"), wanted) | holds(F.col("name"), q) | at
        | _false(holds(F.col("current_title"), q)) | _false(holds(F.col("location"), q)) | mail
        | (F.col("_name") > sim.SIMILAR_ABOVE) | (F.col("_employer") > sim.SIMILAR_ABOVE)
    )
    score = F.greatest(sim.token_rank(F.col("_document"), wanted), F.col("_name"),
                       F.when(at, COMPANY_HIT).otherwise(0.0), F.when(mail, 1.0).otherwise(0.0))
    rows = rows.filter(found).withColumn("score", F.round(score, 9))
    best = _best(rows, [F.col("score").desc(), F.col("name").asc(), F.col("person_id").asc()], limit, by)
    role = F.concat_ws(" at ", "current_title", "current_company")
    return _hit(best, by, "person", "person_id", F.col("name"), F.when(role != "", role), F.col("location"), F.col("score"))


def search_companies(companies: DataFrame, q: Column, limit: int, by: list[str]) -> DataFrame:
    rows = companies.withColumn("_similar", sim.similarity(F.col("name"), q)).withColumn("_hit", holds(F.col("name"), q))
    rows = rows.filter(F.col("_hit") | (F.col("_similar") > sim.SIMILAR_ABOVE)).withColumn(
        "score", F.round(F.greatest("_similar", F.when(F.col("_hit"), NAME_HIT).otherwise(0.0)), 9))
    best = _best(rows, [F.col("score").desc(), F.col("connection_count").desc(), F.col("company_id").asc()], limit, by)
    return _hit(best, by, "company", "company_id", F.col("name"), F.col("industry"), _plural(F.col("connection_count"), "connection"), F.col("score"))


def search_conversations(conversations: DataFrame, messages: DataFrame, people: DataFrame, q: Column, limit: int) -> DataFrame:
    spoken = messages.groupBy("ws", "conversation_id").agg(
        F.max(_false(holds(F.col("content"), q))).alias("_said"), F.count(F.lit(1)).alias("message_count"),
        F.max("sent_at").alias("last_message_at"),
    )
    rows = conversations.join(spoken, ["ws", "conversation_id"]).join(people.select("ws", "person_id", "name"), ["ws", "person_id"], "left")
    return best_conversations(rows, q, limit, ["ws"])


def best_conversations(rows: DataFrame, q: Column, limit: int, by: list[str]) -> DataFrame:
    """A hit in a message (`_said`), the title or the counterpart's name; conversations without messages never match."""
    found = F.col("_said") | _false(holds(F.col("title"), q)) | _false(holds(F.col("name"), q))
    best = _best(rows.filter(found), [F.col("conversation_id").asc()], limit, by)
    return _hit(best, by, "conversation", "conversation_id", F.coalesce("name", "title", F.lit("Conversation")),
                _plural(F.col("message_count"), "message"), F.date_format("last_message_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
                F.lit(CONVERSATION_SCORE))


def global_search(people: DataFrame, companies: DataFrame, conversations: DataFrame, messages: DataFrame, everyone: DataFrame,
                  term: str, types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """(ws, position, type, id, title, subtitle, detail, score, total); total counts hits within the
    limits of each branch. Each branch keeps its best rows before the branches meet."""
    term = term.strip()
    unknown = set(types or []) - set(TYPES)
    if unknown:
        raise ValueError(f"unknown search types {sorted(unknown)}")
    build = {
        "person": lambda: search_people(people, F.lit(term), limit, ["ws"]),
        "company": lambda: search_companies(companies, F.lit(term), limit, ["ws"]),
        "conversation": lambda: search_conversations(conversations, messages, everyone, F.lit(term), limit),
    }
    out = None
    for kind in types or TYPES:
        part = build[kind]()
        out = part if out is None else out.unionByName(part)
    if not term:
        out = out.limit(0)
    return ranked(out, limit, ["ws"])


def ranked(hits: DataFrame, limit: int, by: list[str]) -> DataFrame:
    """Hits of all branches in order. At most three branches of `limit` rows per value of `by` reach these windows."""
    order = [F.col("score").desc(), F.col("_type").asc(), F.col("_within").asc()]
    placed = hits.withColumn("total", F.count(F.lit(1)).over(W.partitionBy(*by))).withColumn(
        "position", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return placed.filter(F.col("position") <= limit).drop("_type", "_within")
