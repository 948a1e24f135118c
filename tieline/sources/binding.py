"""Binds star-schema tables (customers, orders, line items, events, conversations) to the network
model, so that every operator can run over them at any scale.

Regions become workspaces, customers people, orders employment rows, suppliers companies, order
years imports. The rules below are the whole mapping; checks/base_sql.py states them in SQL.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tieline.functions import text as t
from tieline.sources import facts
from tieline.session import checkpoint_dir, compiled_methods

COMPANY_NAMES = [
    "Stripe", "OpenAI", "Pfizer", "Deloitte", "Okta", "Nvidia", "Google", "Goldman Sachs", "Acme",
    "Globex", "Initech", "Umbrella Health", "Hooli", "Vandelay Industries", "Wonka", "Soylent",
    "Tyrell", "Cyberdyne Systems", "Wayne Labs", "Nippon Systems K.K.",
]
COMPANY_ENDINGS = ["", " Inc", ", Corp."]
TITLES = [
    "Software Engineer", "Senior Software Engineer", "Staff Engineer", "Principal Architect",
    "Engineering Manager", "VP Engineering", "CTO", "Data Scientist", "Machine Learning Engineer",
    "Product Manager", "UX Designer", "Account Executive", "Director of Marketing", "Recruiter",
    "General Counsel", "CFO", "Research Scientist", "Customer Success Manager", "Chief of Staff",
    "Founder & CEO", "Marketing Intern", "Junior Developer", "Clinical Nurse", "Security Engineer",
    "Barista", "Owner", None,
]
NOW = "2001-08-02 00:00:00"
EVENT_NOW = "2024-02-01 00:00:00"


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over all cores. A table of few bytes is read by one task, whatever work its rows are put to next."""
    return rows.repartition(*rows.columns)


def written(rows: DataFrame, path: str) -> DataFrame:
    """`rows` written to the shared folder and read back."""
    rows.write.mode("overwrite").parquet(path)
    # With its schema given, reading back needs no job that opens the files.
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class stored_table:
    """A table computed from the given ones, written once per application and directory into the
    shared checkpoint folder, then read back as Parquet: the warehouse that queries start from.
    Readers get column pruning and pushed filters, and a lost executor costs no recomputation."""

    def __init__(self, build):
        self.build = build

    def __set_name__(self, owner, name):
        self.name = name

    def __get__(self, tables, owner=None):
        if tables is None:
            return self
        path = f"{tables.warehouse}/{self.name}"
        if path not in _READ:
            _READ[path] = written(self.build(tables), path)
        return _READ[path]


# Tables opened in this process, by application and path.
_READ: dict[str, DataFrame] = {}


class Binding:
    """Warehouse tables over one directory of star-schema Parquet files."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory
        compiled_methods(spark)

    @cached_property
    def warehouse(self) -> str:
        source = hashlib.sha256(self.directory.encode()).hexdigest()[:16]
        return f"{checkpoint_dir(self.spark)}/tieline/{self.spark.sparkContext.applicationId}/{source}"

    def table(self, name: str) -> DataFrame:
        path = f"{self.spark.sparkContext.applicationId}:{self.directory}/{name}.parquet"
        if path not in _READ:
            _READ[path] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return _READ[path]

    @cached_property
    def customers(self) -> DataFrame:
        """(ws, person_id, name, segment, nation): one row per customer."""
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("ws"))
        return (
            self.table("customer")
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("ws", F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("segment"), "nation")
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("person_id"),
            F.col("o_orderdate").alias("ordered_at"), F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderpriority").alias("priority"),
        )

    @stored_table
    def worked(self) -> DataFrame:
        """Employment without company keys: one row per order with line items; the customer's latest such order is current."""
        line = (
            self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("line"))
            .select("order_id", F.col("line.l_suppkey").alias("supplier"), F.col("line.l_partkey").alias("p_partkey"))
        )
        rows = self.orders.select("order_id", "person_id", "ordered_at").join(line, "order_id")
        # Joined on the order, not the person, so a person with very many orders stays spread out.
        latest = rows.groupBy("person_id").agg(
            F.max(F.struct("ordered_at", "order_id")).alias("last")
        ).select(F.col("last.order_id").alias("order_id"), F.lit(True).alias("is_last"))
        rows = (
            rows.join(latest, "order_id", "left")
            .join(self.table("part").select("p_partkey", "p_size"), "p_partkey", "left")
            .join(self.customers.select("ws", "person_id"), "person_id")
        )
        dominant = F.when((F.col("ws") == "AFRICA") & (F.col("supplier") % 20 < 17), 0).when(
            (F.col("ws") == "AMERICA") & (F.col("supplier") % 20 < 12), 0
        ).otherwise(F.col("supplier") % 20)
        company = F.when(
            F.col("order_id") % 17 != 0,
            F.concat(pick(COMPANY_NAMES, dominant), pick(COMPANY_ENDINGS, F.col("supplier") % 3)),
        )
        return rows.select(
            "ws", F.col("order_id").alias("employment_id"), "person_id", company.alias("company_name"),
            pick(TITLES, F.col("p_size") % len(TITLES)).alias("title"),
            F.col("ordered_at").cast("date").alias("started_on"),
            F.date_trunc("year", "ordered_at").cast("timestamp_ntz").alias("observed_at"),
            F.coalesce("is_last", F.lit(False)).alias("is_current"),
        )

    @stored_table
    def employment(self) -> DataFrame:
        """`worked` with the key of its company, which is made once for each distinct name."""
        names = self.worked.select("company_name").distinct()
        keys = names.withColumn("company_key", t.nullif_blank(t.company_key(F.col("company_name"))))
        reference = F.when(F.col("company_key").isNotNull(), F.concat_ws("/", "ws", "company_key"))
        return self.worked.join(keys, "company_name", "left").select(
            "ws", "employment_id", "person_id", "company_name", "company_key", "title", "started_on", "observed_at", "is_current",
            reference.alias("company_id"),
        )

    @stored_table
    def companies(self) -> DataFrame:
        """One row per workspace and company key; the name first seen wins."""
        return (
            self.employment.filter(F.col("company_key").isNotNull())
            .groupBy("ws", "company_key")
            .agg(F.min_by("company_name", "employment_id").alias("name"))
            .select("ws", F.concat_ws("/", "ws", "company_key").alias("company_id"), "company_key", "name",
                    F.when(F.length("company_key") % 3 == 0, F.lit("Software")).alias("industry"))
        )

    @stored_table
    def fact_people(self) -> DataFrame:
        return facts.fact_people(self.people, self.employment)

    @stored_table
    def fact_employment(self) -> DataFrame:
        return facts.without_owners(self.employment, self.people)

    @cached_property
    def education(self) -> DataFrame:
        key = F.col("person_id")
        schools = F.array_compact(F.array(
            F.when(key % 2 == 0, F.concat(F.lit("University of "), F.col("nation"))),
            F.when(key % 7 == 0, F.lit("Open Academy")),
            F.when(key % 14 == 0, F.concat(F.lit("UNIVERSITY OF "), F.col("nation"))),
        ))
        return self.customers.select("ws", "person_id", F.explode(schools).alias("school"))

    @cached_property
    def interactions(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("person_id"), F.col("event_type").alias("kind"),
            F.col("ts").alias("occurred_at"), F.col("event_id").alias("interaction_id"),
        ).join(self.customers.select("ws", "person_id"), "person_id")

    @cached_property
    def messages(self) -> DataFrame:
        turns = self.table("conversations").filter(F.col("role") != "system")
        at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(
            F.col("conv_id").cast("int"), F.col("turn").cast("int")
        )
        return turns.join(
            self.customers.select("ws", F.col("person_id").alias("conv_id")), "conv_id"
        ).select(
            "ws", F.col("conv_id").alias("conversation_id"),
            F.concat_ws("#", "conv_id", "turn").alias("message_id"), F.col("text").alias("content"),
            at.alias("sent_at"),
            F.when(F.col("role") == "user", "inbound").otherwise("outbound").alias("direction"),
        )

    @cached_property
    def conversations(self) -> DataFrame:
        ids = self.table("conversations").select("conv_id").distinct()
        return ids.join(
            self.customers.select("ws", F.col("person_id").alias("conv_id")), "conv_id"
        ).select(
            "ws", F.col("conv_id").alias("conversation_id"), F.col("conv_id").alias("person_id"),
            F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Thread "), F.col("conv_id").cast("string"))).alias("title"),
        )

    @cached_property
    def imports(self) -> DataFrame:
        year = F.year("ordered_at")
        years = (
            self.orders.join(self.customers.select("ws", "person_id"), "person_id")
            .select("ws", year.alias("y")).distinct()
        )
        return years.select(
            "ws", F.concat_ws("-", "ws", F.col("y").cast("string")).alias("import_id"),
            F.make_timestamp_ntz(F.col("y"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("uploaded_at"),
            F.when(F.col("y") == 1996, "failed").when(F.col("y") == 1998, "partially_completed")
            .when(F.col("y") == 1995, "processing").otherwise("completed").alias("status"),
            F.concat(F.lit("export-"), F.col("y").cast("string"), F.lit(".zip")).alias("filename"),
        )

    @cached_property
    def import_files(self) -> DataFrame:
        return self.imports.select(
            "ws", "import_id", F.when(F.year("uploaded_at") == 1999, "messages").otherwise("connections").alias("dataset")
        )

    @cached_property
    def person_tags(self) -> DataFrame:
        return (
            self.orders.select("person_id", F.col("priority").alias("tag")).distinct()
            .join(self.customers.select("ws", "person_id"), "person_id").select("ws", "person_id", "tag")
        )

    @cached_property
    def tags(self) -> DataFrame:
        used = self.person_tags.select("ws", "tag").distinct()
        unused = self.customers.select("ws").distinct().withColumn("tag", F.lit("unused"))
        return used.unionByName(unused)

    @cached_property
    def jobs(self) -> DataFrame:
        return self.employment.join(
            self.orders.filter(F.col("order_status") == "P").select(F.col("order_id").alias("employment_id"), "ordered_at"),
            "employment_id",
        ).select(
            "ws", F.col("employment_id").alias("job_id"), F.coalesce("title", "company_name").alias("title"),
            "company_name", "company_id",
            F.when(F.col("employment_id") % 3 != 0, F.col("ordered_at")).alias("applied_at"),
            F.when(F.col("employment_id") % 2 == 0, F.col("ordered_at")).alias("saved_at"),
        )

    @cached_property
    def endorsements(self) -> DataFrame:
        """(ws, person_id, skill, points, ord): one endorsement per line item."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("p_partkey"), "l_linenumber"
        )
        return (
            lines.join(self.table("part").select("p_partkey", "p_type"), "p_partkey")
            .join(self.orders.select("order_id", "person_id"), "order_id")
            .join(self.customers.select("ws", "person_id"), "person_id")
            .select(
                "ws", "person_id",
                F.when(F.col("order_id") % 2 == 0, F.initcap("p_type")).otherwise(F.col("p_type")).alias("skill"),
                F.lit(1).alias("points"), F.struct("order_id", "l_linenumber", "p_partkey").alias("ord"),
            )
        )

    @stored_table
    def people(self) -> DataFrame:
        """People with the denormalised columns that derivation keeps up to date."""
        from tieline.operators.rollups import interaction_totals

        spans = self.orders.groupBy("person_id").agg(
            F.min_by("ordered_at", "order_id").alias("first_ordered"),
            F.year(F.min("ordered_at")).alias("first_year"),
            F.year(F.max("ordered_at")).alias("last_year"),
        )
        owners = self.customers.groupBy("ws").agg(F.min("person_id").alias("owner_id"))
        current = self.employment.filter("is_current").select(
            "person_id", F.col("company_name").alias("current_company"), F.col("title").alias("current_title")
        )
        totals = interaction_totals(self.conversations, self.messages, self.interactions).drop("ws")
        key = F.col("person_id")
        import_of = lambda y: F.when(F.col(y).isNotNull(), F.concat_ws("-", "ws", F.col(y).cast("string")))
        rows = (
            self.customers.join(owners, "ws").join(spans, "person_id", "left")
            .join(current, "person_id", "left").join(totals, "person_id", "left")
        )
        return rows.select(
            "ws", "person_id", "name",
            F.split("name", "#")[0].alias("first_name"), F.split("name", "#")[1].alias("last_name"),
            F.when(F.col("current_title").isNotNull() & F.col("current_company").isNotNull(),
                   F.concat_ws(" at ", "current_title", "current_company")).otherwise(F.col("current_title")).alias("headline"),
            "current_company", "current_title",
            F.when(key % 4 == 1, F.concat_ws(", ", "nation", "ws"))
            .when(key % 4 == 2, F.concat(F.col("nation"), F.lit(", CA, US"))).when(key % 4 == 3, F.lit("UK")).alias("location"),
            F.when(key % 9 == 0, F.col("segment")).when(key % 9 == 3, F.lit("Hospital & Health Care"))
            .when(key % 9 == 6, F.lit("Computer Software")).alias("industry"),
            F.when(key % 5 != 0, F.concat(
                F.lit("https://www.linkedin.com/in/c"),
                F.when(key % 50 == 2, key - 1).otherwise(key).cast("string"),
            )).alias("profile_url"),
            F.when(key % 3 == 0, F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com"))).alias("email"),
            F.when(key % 10 != 9, F.col("first_ordered")).alias("connected_at"),
            F.coalesce("interaction_count", F.lit(0)).cast("long").alias("interaction_count"), "last_interaction_at",
            (key == F.col("owner_id")).alias("is_self"),
            import_of("first_year").alias("first_import_id"), import_of("last_year").alias("last_import_id"),
        )

    @stored_table
    def talks(self) -> DataFrame:
        """Conversations with their message counts and dates."""
        from tieline.operators.rollups import conversation_totals

        return self.conversations.join(conversation_totals(self.messages), ["ws", "conversation_id"], "left").fillna(0, ["message_count"])

    @stored_table
    def postings(self) -> DataFrame:
        """The search index."""
        from tieline.operators.postings import postings

        return postings(self.people, self.companies, self.conversations, self.messages).sortWithinPartitions("ws", "list", "term")

    @stored_table
    def posting_counts(self) -> DataFrame:
        from tieline.operators.postings import posting_counts

        return posting_counts(self.postings).sortWithinPartitions("ws", "list", "term")
