"""The inverted index against plain search, on invented rows and over a warehouse that imports keep adding to."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import exports as ex
from test_import import DONE, uploads
from tieline.operators import postings as po, search as se
from tieline.plans import search_index
from tieline.plans.import_job import run_import
from tieline.plans.warehouse import Warehouse, delete_import

SYLLABLES = ["ka", "to", "Ri", "ÄN", "ßo", "el", "um", "o", " ", " ", "-", "%", "_", "\\", "😀", "İ", "Σ"]


def text(rng, n):
    return None if rng.random() < 0.1 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(n)))


def tables(spark, seed, workspaces=2, n=60):
    rng, people, firms, talks, messages = random.Random(seed), [], [], [], []
    for i in range(n):
        ws = f"w{i % workspaces}"
        people.append((ws, f"p{i}", text(rng, 8) or "x", text(rng, 5), text(rng, 6), text(rng, 5), text(rng, 5), text(rng, 4), f"{i}@kato.el" if i % 3 else None))
        firms.append((ws, f"f{i}", text(rng, 6) or "", text(rng, 3), i % 7))
        talks.append((ws, f"t{i}", f"p{(i * 7) % n}" if i % 5 else None, text(rng, 5), 3 if i % 4 else 0, dt.datetime(2024, 1, 1)))
        messages += [(ws, f"t{i}", f"m{i}-{j}", text(rng, 12), dt.datetime(2024, 1, 1)) for j in range(3 if i % 4 else 0)]
    make = spark.createDataFrame
    return (
        make(people, "ws string, person_id string, name string, headline string, current_title string, current_company string, location string, industry string, email string"),
        make(firms, "ws string, company_id string, name string, industry string, connection_count long"),
        make(talks, "ws string, conversation_id string, person_id string, title string, message_count long, last_message_at timestamp_ntz"),
        make(messages, "ws string, conversation_id string, message_id string, content string, sent_at timestamp_ntz"),
    )


COLUMNS = ["ws", "position", "type", "id", "title", "subtitle", "detail", "score", "total"]


def plain(people, firms, talks, messages, term):
    bare = talks.drop("message_count", "last_message_at")
    rows = se.global_search(people, firms, bare, messages, people, term).collect()
    return sorted(tuple(map(str, (r[c] for c in COLUMNS))) for r in rows)


def test_equal_to_plain_search(spark):
    given = tables(spark, 3)
    entries = po.postings(*given)
    terms = ["o", "to ri", "RIÄN", "1@kato.el", "k_to", "ka%o", "to😀", "İ", "  kato  ", ""]
    got = po.search(entries, po.posting_counts(entries), given[0], given[1], given[2], given[3], given[0], terms).collect()
    for term in terms:
        assert sorted(tuple(map(str, (r[c] for c in COLUMNS))) for r in got if r.q == term.strip()) == plain(*given, term), term


def test_empty_tables_and_no_terms(spark):
    given = [t.limit(0) for t in tables(spark, 1, n=4)]
    entries = po.postings(*given)
    assert po.search(entries, po.posting_counts(entries), given[0], given[1], given[2], given[3], given[0], ["kato"]).count() == 0


def test_long_texts_are_found_to_their_end(spark):
    people, firms, talks, messages = tables(spark, 5, n=8)
    long = "kato " * 60_000 + "needle"
    messages = messages.filter("message_id <> 'm1-0'").union(spark.createDataFrame([("w1", "t1", "m1-0", long, dt.datetime(2024, 1, 1))], messages.schema))
    entries = po.postings(people, firms, talks, messages)
    got = po.search(entries, po.posting_counts(entries), people, firms, talks, messages, people, ["o needle", "needle kato"]).collect()
    assert [(r.q, r.type, r.id) for r in got if r.type == "conversation"] == [("o needle", "conversation", "t1")]


def test_common_pieces_are_not_read(spark):
    wanted = po.wanted_terms(po.terms_frame(spark, ["kato"]))
    counts = spark.createDataFrame([("w", "company.name", "kat", 900), ("w", "company.name", "ato", 2), ("v", "company.name", "kat", 5)], "ws string, list string, term string, n long")
    chosen = po.rarest(wanted, counts).collect()
    assert [(r.ws, r.list, r.term) for r in chosen] == [("w", "company.name", "ato")]  # v lacks a piece, so it holds no such name


def test_plans_of_plain_terms_read_no_message(spark, folder):
    given = tables(spark, 3)
    for name, df in zip(("people", "firms", "talks", "messages"), given, strict=True):
        df.write.parquet(f"{folder}/{name}")
    people, firms, talks, messages = (spark.read.parquet(f"{folder}/{n}") for n in ("people", "firms", "talks", "messages"))
    po.postings(people, firms, talks, messages).write.parquet(f"{folder}/postings")
    entries = spark.read.parquet(f"{folder}/postings")
    po.posting_counts(entries).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    files = lambda terms: {f.rsplit("/", 2)[1] for f in po.search(entries, counts, people, firms, talks, messages, people, terms).inputFiles()}
    assert "messages" not in files(["kato", "um el"])
    assert "messages" in files(["k_to"])


def hits(house, terms):
    return sorted((r.ws, r.q, r.type, r.title) for r in search_index.search(house, terms).collect())


def test_imports_and_deletions_keep_the_index(spark, folder):
    house = Warehouse(spark, folder + "/w", buckets=2)
    with pytest.raises(ValueError, match="build"):
        search_index.search(house, ["mara"])
    first, second = ex.zipped(ex.export_files()), ex.zipped(ex.export_files(ex.SECOND))
    run_import(house, uploads(spark, ("w1", "w1-1", "export.zip", first, dt.datetime(2026, 2, 1))), DONE)
    search_index.build(house)
    terms = ["rolf eng", "mara quill", "globex"]
    before = hits(house, terms)
    assert ("w1", "mara quill", "person", "Mara Quill") in before and not [h for h in before if h[1] == "rolf eng" and h[3] == "Rolf Eng"]
    run_import(house, uploads(spark, ("w1", "w1-2", "export.zip", second, dt.datetime(2026, 2, 2)), ("w2", "w2-1", "export.zip", second, dt.datetime(2026, 2, 2))), DONE)
    after = hits(house, terms)
    assert {h[0] for h in after if h[1:] == ("rolf eng", "person", "Rolf Eng")} == {"w1", "w2"}
    delete_import(house, spark.createDataFrame([("w2", "w2-1")], "ws string, import_id string"), with_data=True)
    gone = hits(house, terms)
    assert [h for h in gone if h[0] == "w1"] == [h for h in after if h[0] == "w1"]
    assert not [h for h in gone if h[0] == "w2" and h[2] == "person" and h[3] == "Rolf Eng"]
