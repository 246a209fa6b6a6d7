"""Row selection, keyed changes, constraints, discovery, crawl and review."""

import re

import pytest
from pyspark.sql import functions as F

from exposight import schemas
from exposight.operators import rows
from exposight.plans import crawl, discovery, review
from exposight.session import work_folder
from exposight.sources import landed, sinks


def test_keep_first_with_a_hot_key(spark):
    data = [("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(3000, 0, -1)] + [(None, 9), (None, 7)]
    df = spark.createDataFrame(data, "k string, o bigint").repartition(8)
    firsts = rows.first_per_key(df, ["k"], ["o"])
    want = {}
    for k, o in data:
        want[k] = min(o, want.get(k, o))
    assert {r["k"]: r["o"] for r in firsts.collect()} == want
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    # The map side passes on one row per key and task, so the hot key does not pile up.
    assert re.search(r"WindowGroupLimit .*, 1, Partial", plan)
    again = rows.first_per_key(firsts, ["k"], ["o"])
    assert again.count() == firsts.count()


def test_upsert(spark):
    stored = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, t string, n int")
    new = spark.createDataFrame([("b", "z1", 1), ("b", None, 2), ("c", "w", 1)], "id string, t string, seq int")
    once = rows.upsert(stored, new, "id", ["seq"])
    assert {tuple(r) for r in once.collect()} == {("a", "x", 1), ("b", "y", 2), ("c", "w", None)}
    assert {tuple(r) for r in rows.upsert(once, new, "id", ["seq"]).collect()} == {tuple(r) for r in once.collect()}


def test_append_new_adds_nothing_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    rows_in = [(1, 'quote " and, comma', "p", "d.example.com"), (2, "", "q", "e")]
    df = spark.createDataFrame(rows_in, landed.MISTAKE_SCHEMA)
    sinks.write_csv(df, str(tmp_path / "m"))
    back = landed.read_mistakes(spark, str(tmp_path / "m")).collect()
    assert {r["email_id"]: r["actual"] for r in back}[1] == 'quote " and, comma'


def test_tables_defaults_and_constraints(spark):
    assert set(schemas.missing_tables(spark, "default")) <= set(schemas.TABLES)
    page = schemas.with_defaults(spark.createDataFrame([(1, 5)], "id bigint, search_result_id bigint"), "crawled_pages")
    assert page.schema == schemas.TABLES["crawled_pages"].schema or page.columns == schemas.TABLES["crawled_pages"].schema.names
    r = page.first()
    assert (r["verification_status"], r["risk_score"], r["match_score"], r["html"]) == ("pending", 0.0, 0.0, None)
    child = spark.createDataFrame([(1, "u", "contact"), (2, None, "social"), (2, "v", None)], "page_id bigint, url string, link_type string")
    found = {(x["rule"], x["column_name"]): x["violations"] for x in schemas.constraint_report(child, "page_links", {"crawled_pages": page}).collect()}
    assert found == {("not_null", "page_id"): 0, ("not_null", "url"): 1, ("not_null", "link_type"): 1, ("reference", "page_id"): 2}
    state = {x["column_name"]: x["state"] for x in schemas.schema_report(child.withColumn("url", F.lit(1)), "page_links").collect()}
    assert state == {"page_id": "ok", "url": "other type", "link_type": "ok"}
    gone = spark.createDataFrame([(2,)], "id bigint")
    assert rows.without_parents(child, gone, "page_id", "id").count() == 1


def test_discovery_run_twice(spark):
    subject = spark.createDataFrame(
        [(1, "Ana", "[]", "Testwell", "a@x.example.com", "[]", '["Northport"]', None)],
        "subject_id bigint, first_name string, middle_names string, last_name string, email string, usernames string, locations string, numbers string",
    )
    subjects = discovery.subjects_from(subject)
    hits = spark.createDataFrame(
        [(1, 0, '"a@x.example.com"', 1, "", "t", "b"), (1, 0, '"a@x.example.com"', 2, "http://h.example.com/p?x", "t2", None),
         (1, 1, '"Ana Testwell" "Northport"', 1, "http://h.example.com/p#y", "t3", "b"), (1, 1, '"Ana Testwell" "Northport"', 2, "http://g.example.com/q", None, "b")],
        "subject_id bigint, query_ord int, search_query string, result_rank int, href string, title string, body string",
    )
    none = spark.createDataFrame([], "subject_id bigint, url string")
    first = discovery.ingest(hits, subjects, none)
    got = {(r["url"], r["result_rank"], r["query_confidence"], r["domain"], r["page_title"], r["snippet"]) for r in first.collect()}
    assert got == {("http://h.example.com/p", 2, 1.0, "h.example.com", "t2", ""), ("http://g.example.com/q", 2, 0.6, "g.example.com", "", "b")}
    assert discovery.ingest(hits, subjects, first).count() == 0
    assert discovery.search_queries(subjects).count() == 4 + 2


def test_crawl_and_status(spark, tmp_path):
    candidates = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending"), (4, "success")], "id bigint, crawl_status string")
    page = "<title>T</title>a@b.example.com<a href='/contact'>Contact</a>"
    fetched = spark.createDataFrame(
        [(1, "http://h.example.com/", 200, "Text/HTML; charset=utf-8", page), (2, "http://h.example.com/x", 200, "application/pdf", page),
         (3, "http://h.example.com/y", 404, "text/html", page), (4, "http://h.example.com/z", 200, "text/html", page)], landed.FETCH_SCHEMA,
    )
    wanted, folder = crawl.pending_fetches(candidates, landed.normalise_fetches(fetched)), str(tmp_path)
    for _ in range(2):  # a repeated batch replaces its rows
        pages = crawl.ingest(wanted, folder, batch=7)
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}").select(*columns).collect()]
    assert dict(read("crawl_events", "search_result_id", "crawl_status")) == {1: "success", 2: "unsupported", 3: "failed"}
    assert len(read("crawl_events", "ts")) == 3 and None not in [r[0] for r in read("crawl_events", "ts")]
    assert pages.select("page_id", "page_title").collect() == [(1, "T")] and read("crawled_pages", "page_id") == [(1,)]
    assert read("page_emails", "page_id", "email") == [(1, "a@b.example.com")]
    assert read("page_links", "page_id", "url", "link_type") == [(1, "http://h.example.com/contact", "contact")]
    assert read("page_images", "page_id") == read("page_phones", "page_id") == []
    later = crawl.ingest(wanted.where("search_result_id = 9"), folder, batch=8)
    assert later.count() == 0 and len(read("crawl_events", "ts")) == 3
    events = spark.createDataFrame([(1, 1, "2024-01-01", "failed"), (2, 1, "2024-01-02", "success"), (3, 2, "2024-01-01", "failed")], "event_id bigint, search_result_id bigint, ts string, crawl_status string")
    now = {r["search_result_id"]: (r["crawl_status"], r["crawl_attempts"]) for r in crawl.status_now(candidates, events).collect()}
    assert now == {1: ("success", 2), 2: ("failed", 1), 3: ("pending", 0), 4: ("pending", 0)}


def test_local_html_files(spark, tmp_path):
    (tmp_path / "demo page.html").write_text("<p>Ana\nTestwell</p>", encoding="utf-8")
    wanted = spark.createDataFrame([(1, f"file://{tmp_path}/demo%20page.html"), (2, f"file://{tmp_path}/none.html")], "id bigint, url string")
    got = {r["search_result_id"]: r for r in landed.read_html_files(spark, str(tmp_path), wanted).collect()}
    assert got[1]["html"] == "<p>Ana\nTestwell</p>" and got[1]["http_status"] == 200
    assert got[2]["html"] is None
    status = spark.createDataFrame([(None, None)], "s int, c string").select(crawl.crawl_status(F.col("s"), F.col("c"))).first()[0]
    assert status == "failed"


def test_pages_are_written_as_files_of_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FOLDER_FILES", 3)
    rows = [(i, f"<p>\u00e9 {i}</p>") for i in range(8)] + [(3, "again"), (8, None), (-9, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1)
    sinks.write_files(pages, str(tmp_path / "pages"), "page_id", "html")
    files = landed.read_html_files(spark, str(tmp_path / "pages")).collect()
    got = {r["final_url"].split("/")[-1]: r["html"] for r in files}
    assert len(files) == 10 and len({r["final_url"].rsplit("/", 1)[0] for r in files}) == 4
    assert got["page_id=0-00000.txt"] == "<p>\u00e9 0</p>\n" and got["page_id=3-00000.txt"] == "<p>\u00e9 3</p>\nagain\n"
    assert got["page_id=8-00000.txt"] == got["page_id=-9-00000.txt"] == "\n"


def test_review(spark):
    pages = spark.createDataFrame(
        [(1, 1, "a", 25.0, 0.0, "pending"), (2, 2, None, 0.0, 0.0, "pending"), (3, 3, "c", None, 0.0, "pending"), (4, 4, "d", 65.0, 0.0, "pending"), (5, 5, "e", 0.0, 0.0, "ignored")],
        "id bigint, search_result_id bigint, page_title string, risk_score double, match_score double, verification_status string",
    )
    urls = pages.select("id", F.lit("u").alias("url"))
    queue = {m: [r["id"] for r in review.review_queue(pages, urls, m).collect()] for m in ("candidates", "false_negatives", "all_pending", "previous")}
    assert queue == {"candidates": [4, 1], "false_negatives": [2], "all_pending": [4, 1, 2, 3], "previous": [5]}
    with pytest.raises(ValueError):
        review.review_queue(pages, urls, "other")
    made = spark.createDataFrame([(1, 1, "t1", "V"), (2, 1, "t2", "s"), (3, 5, "t1", "r"), (4, 2, "t1", "f"), (5, 2, "t2", "i")], "event_id bigint, page_id bigint, ts string, choice string")
    after = {r["id"]: r["verification_status"] for r in review.apply_decisions(pages, made).collect()}
    assert after == {1: "verified", 2: "ignored", 3: "pending", 4: "pending", 5: "pending"}


def test_risk_reaches_the_queue(spark):
    pages = spark.createDataFrame([(i, i, "t", s, 0.0, "pending") for i, s in ((1, 0.0), (2, None), (3, 5.0), (4, 0.0))],
        "id bigint, search_result_id bigint, page_title string, risk_score double, match_score double, verification_status string")
    risks = spark.createDataFrame([(1, 7, 25), (1, 8, 65), (2, 7, 40), (4, None, 0)], "page_id bigint, subject_id bigint, risk_score bigint")
    queue = review.review_queue(review.with_risk(pages, risks), pages.select("id", F.lit("u").alias("url")), "candidates")
    assert [(r["id"], r["risk_score"]) for r in queue.collect()] == [(1, 65.0), (2, 40.0), (3, 5.0)]


def test_work_folder(spark):
    assert work_folder(spark, "a") != work_folder(spark, "a")


def test_append_adds_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for start in (0, 3):
        sinks.append(spark.range(start, start + 3), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(6))
