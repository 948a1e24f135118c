"""Findings on time and memory of the third round: what the plans must not do again, and that rows stay the same."""

from pyspark.sql import functions as F

from tieline.functions import similarity as sim
from tieline.operators import normalize as nz, postings as po
from tieline.operators.merge import merge_rows
from tieline.plans.warehouse import TABLES, Warehouse


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_merging_into_a_table_without_rows_needs_no_join(spark, folder):
    house = Warehouse(spark, folder, buckets=2)
    empty, spec = house.read("tags"), TABLES["tags"]
    assert empty.schema.names == house.schema("tags").names and empty.count() == 0
    batch = spark.createDataFrame([("w", "a", "A"), ("w", "b", "B")], "ws string, tag_key string, tag string")
    merged = merge_rows(empty, batch, spec.keys, spec.rules)
    assert "Join" not in plan(merged) and "LocalRelation <empty>" in plan(empty)
    assert sorted(map(tuple, merged.collect())) == [("w", "a", "A", True), ("w", "b", "B", True)]


def test_uploads_of_the_import_queries_are_built_once(spark, folder):
    from tieline.checks import ingest
    from tieline.sources.binding import Binding

    rows = [(i, f"Customer#{i:09d}", "AUTO") for i in range(1, 4)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    tables = Binding(spark, folder)
    held = ingest.uploads(tables)
    assert "MapInArrow" not in plan(held) and ingest.uploads(Binding(spark, folder)) is held
    assert [tuple(r) for r in held.collect()] == [tuple(r) for r in ingest.derived_files(tables).collect()]


def test_profile_lists_clean_a_cell_once(spark):
    cells = [(1, {"name": " B\u00a0b ", "authority": "n/a"}), (2, {"title": "A", "authority": "X"}), (3, {"name": "N/A", "authority": "Y"}), (4, {})]
    raw = spark.createDataFrame([("w", "i", "f", n, row, "certifications") for n, row in cells],
                                "ws string, import_id string, source_file string, row_no long, row map<string,string>, dataset string")
    out = nz.Canonical()
    nz.normalize_profile_lists(raw, nz.owners(raw), out)
    held = out.tables["profile_fields"][0]
    assert [tuple(r) for r in held.select("field_value", "ord.row_no").collect()] == [("B b; A \u2014 X", 1)]
    assert "Generate explode" in plan(held)
    assert out.outcomes().filter("dataset = 'certifications'").select("accepted", "rejected").first() == (2, 2)


def test_terms_are_literals_and_grams_made_once(spark):
    terms = po.terms_frame(spark, [" b ", "a", "", "a"])
    assert "RDD" not in plan(terms) and [r.q for r in terms.orderBy("q").collect()] == ["a", "b"]
    assert po.terms_frame(spark, ["", " "]).count() == 0
    rows = spark.createDataFrame([("Golman Saks", "goldman sachs"), (None, "x"), ("", "")], "a string, b string")
    alike = rows.select(sim.similarity(F.col("a"), F.col("b")).alias("s"))
    assert plan(alike, "analyzed").count("split(") == 2
    assert [round(r.s, 6) for r in alike.collect()] == [round(7 / 19, 6), 0.0, 0.0]


def test_pieces_of_a_text(spark):
    rows = spark.createDataFrame([("A\U0001f600\nb",), ("",), (None,), ("x",)], "c string").select(po.pieces(F.col("c")).alias("p"))
    f = po.FILL
    assert [r.p for r in rows.collect()] == [["a\U0001f600\n", "\U0001f600\nb", "\nb" + f, "b" + f + f], [f * 3], None, ["x" + f + f]]
    assert "regexp_extract_all" not in plan(rows)


def test_shingles_are_dealt_before_they_are_counted(spark):
    from tieline.llm import simhash

    counts = simhash.shingle_counts(spark.createDataFrame([(1,), (1,), (2,), (None,)], "h long"), 3)
    assert sorted(map(tuple, counts.collect()), key=str) == [(1, 2), (2, 1), (None, 1)]
    steps = plan(counts, "executedPlan").split("== Initial Plan ==")[-1]
    assert steps.rindex("HashAggregate") < steps.index("Exchange") and steps.count("Exchange") == 1
