"""Questions about a network: mapped to intents by rules, answered by counts and records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import classify, fixed_values as fv, text as t
from tieline.functions.templates import fill, number, people_have, plural
from tieline.plans.report import AnalyticsReport


def with_intent(questions: DataFrame, question: Column) -> DataFrame:
    """Adds `intent`, `subject` and `target` to a table of questions. The first rule that holds wins."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    part = lambda pattern, i=1: F.trim(F.regexp_extract(F.col("_q"), f"(?i){pattern}", i))
    holds = lambda pattern: F.col("_q").rlike(f"(?i){pattern}")
    rows = questions.withColumn("_q", q)
    intent = F.when(F.col("_q") == "", "unsupported")
    for name, pattern in fv.QUESTION_KEYWORDS:
        intent = intent.when(holds(pattern), name)
    intent = (
        intent.when(holds(fv.FORMER_COMPANY_QUESTION), "people_former_company")
        .when(holds(fv.CURRENT_COMPANY_QUESTION), "people_at_company")
        .when(holds(fv.LOCATION_WORDS) & holds(fv.LOCATION_QUESTION), "people_in_location")
        .when(holds(fv.INDUSTRY_QUESTION), "industry_count")
        .when(holds(fv.PATH_QUESTION), "career_path")
        .otherwise("unsupported")
    )
    rows = rows.withColumn("intent", intent)
    subject = (
        F.when(F.col("intent") == "people_former_company", part(fv.FORMER_COMPANY_QUESTION))
        .when(F.col("intent") == "people_at_company", F.trim(F.regexp_replace(
            F.regexp_extract(F.col("_q"), f"(?i){fv.CURRENT_COMPANY_QUESTION}", 1), r"^the\s+", "")))
        .when(F.col("intent") == "people_in_location", part(fv.LOCATION_QUESTION))
        .when(F.col("intent") == "industry_count", part(fv.INDUSTRY_QUESTION))
        .when(F.col("intent") == "career_path", part(fv.PATH_QUESTION))
    )
    target = F.when(F.col("intent") == "career_path", part(fv.PATH_QUESTION, 2))
    return rows.withColumn("subject", subject).withColumn("target", target).drop("_q")


def intent_of(question: str) -> tuple[str, str | None, str | None]:
    """The same rules for the one question a caller asks: (intent, subject, target)."""
    q = question.strip().lower()
    for name, pattern in fv.QUESTION_KEYWORDS:
        if q and re.search(pattern, q):
            return name, None, None
    found = lambda pattern: re.search(pattern, q)
    if hit := found(fv.FORMER_COMPANY_QUESTION):
        return "people_former_company", hit[1].strip(), None
    if hit := found(fv.CURRENT_COMPANY_QUESTION):
        return "people_at_company", re.sub(r"^the\s+", "", hit[1]).strip(), None
    if (hit := found(fv.LOCATION_QUESTION)) and found(fv.LOCATION_WORDS):
        return "people_in_location", hit[1].strip(), None
    if hit := found(fv.INDUSTRY_QUESTION):
        return "industry_count", hit[1], None
    if hit := found(fv.PATH_QUESTION):
        return "career_path", hit[1].strip(), hit[2].strip()
    return "unsupported", None, None


class NetworkAnalyst:
    """Answers one question for every workspace at once: `answer` has one row per workspace,
    `records` up to `records_shown` rows per workspace behind it (`changed` of them for what changed); rankings list the `top` largest or
    the `least` smallest bins."""

    def __init__(self, report: AnalyticsReport, records_shown: int = 50, changed: int = 30, top: int = 8, least: int = 5):
        self.report, self.facts = report, report.facts
        self.records_shown, self.changed, self.top, self.least = records_shown, changed, top, least

    # -- rows behind an answer ------------------------------------------------------------------

    def _matches(self, intent: str, subject: str | None, target: str | None) -> DataFrame | None:
        """(ws, person_id, name, detail, ord) for intents that list people or moves."""
        people, needle = self.facts.people, (subject or "").strip().lower()
        person = lambda df, detail: df.select("ws", "person_id", "name", detail.alias("detail"), F.col("person_id").alias("ord"), F.lit(0).alias("ord2"))
        role = F.concat_ws(" at ", "current_title", "current_company")
        as_text = F.when(role != "", role)
        if intent == "people_at_company":
            key = t.effective_key(F.col("current_company_key"), F.col("current_company"))
            return person(people.filter(F.contains(key, F.lit(needle)) | F.contains(t.key_of(F.col("current_company")), F.lit(needle))), as_text)
        if intent == "people_former_company":
            key = t.effective_key(F.col("company_key"), F.col("company_name"))
            past = self.facts.employment.filter(~F.col("is_current") & F.contains(key, F.lit(needle))).select("ws", "person_id")
            return person(people.join(past, ["ws", "person_id"], "left_semi"), F.col("current_company"))
        if intent == "industry_count":
            classed = classify.with_industry(people, F.col("industry"), F.col("current_title"), F.col("current_company"), "_c")
            return person(classed.filter((F.col("_c.key") == needle) | F.contains(t.key_of(F.col("_c.label")), F.lit(needle))), as_text)
        if intent == "people_in_location":
            return person(people.filter((F.col("location") != "") & F.contains(F.lower("location"), F.lit(needle))), F.col("location"))
        moved = F.concat(F.col("from_company"), F.lit(" → "), F.col("to_company"))
        move = lambda df: df.select("ws", "person_id", "name", moved.alias("detail"), F.col("person_id").alias("ord"), F.col("employment_id").alias("ord2"))
        if intent == "recent_movers":
            return move(self.report.moves)
        if intent == "career_path":
            end = (target or "").strip().lower()
            return move(self.report.moves.filter(F.contains("from_key", F.lit(needle)) & F.contains("to_key", F.lit(end))))
        if intent == "what_changed":
            return person(self.report.new, F.lit("New in latest connections import"))
        return None

    def _bins(self, intent: str) -> DataFrame | None:
        """Ranked bins for intents that list bins."""
        if intent == "top_companies":
            rank = F.row_number().over(W.partitionBy("ws").orderBy(F.col("count").desc(), F.col("label").asc()))
            return self.report.companies.withColumn("_rank", rank).filter(F.col("_rank") <= self.top)
        if intent == "underrepresented":
            last = F.row_number().over(W.partitionBy("ws").orderBy(F.col("count").asc(), F.col("label").desc()))
            return self.report.industries.filter("share_of_known > 0").withColumn("_rank", -last).filter(F.col("_rank") >= -self.least)
        return None

    def records(self, question: str) -> DataFrame:
        """(ws, position, person_id, name, detail)."""
        intent, subject, target = intent_of(question)
        limit = self.changed if intent == "what_changed" else self.records_shown
        bins = self._bins(intent)
        if bins is not None:
            order = F.row_number().over(W.partitionBy("ws").orderBy("_rank"))
            return bins.select("ws", order.alias("position"), F.lit(None).cast("string").alias("person_id"), F.col("label").alias("name"),
                               F.concat(F.col("count").cast("string"), F.lit(" people")).alias("detail"))
        found = self._matches(intent, subject, target)
        if found is None:
            found = self._matches("people_in_location", "", None).limit(0)
        rank = F.row_number().over(W.partitionBy("ws").orderBy("ord", "ord2"))
        return found.withColumn("position", rank).filter(F.col("position") <= limit).select(
            "ws", "position", F.col("person_id").cast("string").alias("person_id"), "name", "detail")

    # -- the answer -----------------------------------------------------------------------------

    def answer(self, question: str) -> DataFrame:
        """(ws, question, intent, answer, confidence), one row per workspace."""
        intent, subject, target = intent_of(question)
        text, c = fv.ANSWER_TEXT, F.col
        size = self.facts.people.groupBy("ws").agg(F.count(F.lit(1)).alias("total"), F.count_if((F.coalesce("location", F.lit("")) == "")).alias("without"))
        counted = lambda df, name: df.groupBy("ws").agg(F.count(F.lit(1)).alias(name))
        out, confidence = size, F.lit("high")
        if intent == "network_size":
            said = fill(text["network_size"], total=c("total"))
        elif intent == "top_companies":
            line = F.concat(c("label"), F.lit(": "), c("count").cast("string"), F.lit(" ("), number(c("share_of_network")), F.lit("% of network)"))
            # Eight rows per workspace at most.
            top = self._bins(intent).groupBy("ws").agg(
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", line.alias("s")))), lambda x: x["s"]), "; ").alias("lines"),
                F.max("known").alias("known"))
            out = size.join(top, "ws", "left")
            said = F.when(c("lines").isNull(), F.lit(text["no_employer"])).otherwise(F.concat(
                c("lines"), F.lit(". "), (c("total") - c("known")).cast("string"), F.lit(" have no current employer.")))
        elif intent == "recent_movers":
            out = size.join(counted(self.report.movers, "people"), "ws", "left").join(counted(self.report.moves, "moves"), "ws", "left").fillna(0)
            said = fill(text[intent], people=c("people"), people_have=people_have(c("people")), moves=c("moves"))
        elif intent == "underrepresented":
            line = F.concat(c("label"), F.lit(" "), number(c("share_of_known")), F.lit("%"))
            small = self._bins(intent).groupBy("ws").agg(
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", line.alias("s")))), lambda x: x["s"]), ", ").alias("lines"),
                F.max("known").alias("known"))
            out, confidence = size.join(small, "ws", "left").fillna(0), F.lit("medium")
            said = F.when(c("known") < 20, fill(text["few_classified"], known=c("known"))).otherwise(fill(text[intent], bins=c("lines")))
        elif intent == "what_changed":
            pair = self.report.import_pair
            out = size.join(pair, "ws", "left")
            for df, name in ((self.report.new, "new"), (self.report.gone, "gone"), (self.report.moves, "moves")):
                out = out.join(counted(df, name), "ws", "left")
            out = out.fillna(0)
            compared = c("previous_import").isNotNull()
            nothing = "No import that contained Connections.csv, so a change report cannot be produced."
            said = F.when(compared, fill(text[intent], new=c("new"), gone=c("gone"), moves=c("moves"))).otherwise(F.coalesce("limitation", F.lit(nothing)))
            confidence = F.when(compared, "high").otherwise("low")
        elif intent == "industry_count":
            needle = (subject or "").lower()
            first = F.row_number().over(W.partitionBy("ws").orderBy(F.col("count").desc(), F.col("label").asc()))
            industries = self.report.industries
            hit = industries.filter((c("key") == needle) | F.contains(t.key_of(c("label")), F.lit(needle))).withColumn("_rank", first).filter("_rank = 1")
            known = industries.groupBy("ws").agg(F.max("known").alias("_known"))
            out = size.join(known, "ws", "left").join(hit.select("ws", "count", "label", "share_of_known", F.col("confidence").alias("_sure")), "ws", "left")
            unknown = c("total") - F.coalesce("_known", F.lit(0))
            said = F.when(c("count").isNotNull(), fill(text["industry_found"], count=c("count"), known=c("_known"), share_of_known=number(c("share_of_known")),
                                                        label=c("label"), unknown=unknown)).otherwise(
                fill(text["industry_none"], needle=F.lit(subject), unknown=unknown, total=c("total")))
            confidence = F.coalesce("_sure", F.lit("low"))
        elif intent == "unsupported":
            said, confidence = F.lit(text[intent]), F.lit("low")
        else:
            out = size.join(counted(self._matches(intent, subject, target), "n"), "ws", "left").fillna(0)
            said = fill(text[intent], n=c("n"), s=plural(c("n")), needle=F.lit(subject or ""), needle2=F.lit(target or ""), without=c("without"))
            if intent == "people_in_location":
                confidence = F.when(c("n") > 0, "high").otherwise("low")
        return out.select("ws", F.lit(question).alias("question"), F.lit(intent).alias("intent"), said.alias("answer"), confidence.alias("confidence"))

    def answers(self, questions: list[str]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [self.answer(q) for q in questions])
