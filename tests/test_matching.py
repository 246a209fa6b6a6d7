"""Term matching against brute force, with short terms, shared keys, huge pages and skew."""

import random
import re

import pytest

from exposight.operators import matching
from exposight.plans import analyse

TERMS = "subject_id bigint, entity_type string, entity_value string, confidence double"
PAGES = "page_id bigint, extracted_text string"


def brute(pages, terms):
    found = set()
    for page_id, text in pages:
        for subject, kind, value, confidence in terms:
            if text is None:
                continue
            hay, needle = (re.sub(r"\D", "", text), re.sub(r"\D", "", value)) if kind == "phone" else (text.lower(), value.lower())
            if needle and needle in hay:
                found.add((subject, page_id, kind, value, confidence))
    return found


def as_set(df):
    rows = [tuple(r) for r in df.select("subject_id", "page_id", "entity_type", "entity_value", "confidence").collect()]
    assert len(rows) == len(set(rows)), "a finding came twice"
    return set(rows)


def random_case(seed):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abAB é01 .@") for _ in range(n))

    pages = [(i, text(rng.randint(0, 700))) for i in range(30)] + [(98, None), (99, "")]
    terms = []
    for s in range(60):
        kind = rng.choice(["email", "username", "name", "location", "phone"])
        source = rng.choice(pages[:30])[1]
        at, length = rng.randint(0, max(0, len(source) - 1)), rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 20, 40])
        value = source[at : at + length] if rng.random() < 0.7 else text(length)
        terms.append((s % 7, kind, value, 0.8 if kind == "location" else 1.0))
    return pages, terms + terms[:5]


@pytest.mark.parametrize("seed, broadcast", [(1, True), (2, True), (3, False)])
def test_equals_brute_force(spark, seed, broadcast):
    pages, terms = random_case(seed)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = matching.findings(spark.createDataFrame(pages, PAGES), spark.createDataFrame(terms, TERMS))
        found = as_set(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == brute(pages, terms)


def test_long_terms_only_use_wide_strides(spark):
    rng = random.Random(5)
    pages = [(i, "".join(rng.choice("abc ") for _ in range(400))) for i in range(20)]
    terms = [(i, "name", pages[i % 20][1][3 * i : 3 * i + 17 + i % 9], 1.0) for i in range(80)]
    assert as_set(matching.findings(spark.createDataFrame(pages, PAGES), spark.createDataFrame(terms, TERMS))) == brute(pages, terms)


def test_hot_term_hot_page_and_huge_page(spark):
    """A third of the pages hold one term a third of the subjects share; one page is very long."""
    huge = "x" * 150_000 + " Northport " + "y" * 150_000 + "Ana Testwell"
    pages = [(i, "in Northport" if i % 3 == 0 else f"page {i}") for i in range(60)] + [(100, huge)]
    terms = [(s, "location", "Northport" if s % 3 == 0 else f"Town {s}", 0.8) for s in range(30)] + [(1, "name", "Ana Testwell", 1.0)]
    assert as_set(matching.findings(spark.createDataFrame(pages, PAGES), spark.createDataFrame(terms, TERMS))) == brute(pages, terms)


def test_phone_modes(spark):
    pages = spark.createDataFrame([(1, "(01632) 960-123"), (2, "0163 then 2960 and 123"), (3, "01632 960124")], PAGES)
    terms = spark.createDataFrame([(1, "phone", "01632 960123", 1.0), (1, "phone", "none", 1.0)], TERMS)
    assert {r["page_id"] for r in matching.findings(pages, terms).collect()} == {1, 2}
    assert {r["page_id"] for r in matching.findings(pages, terms, phone_mode="token").collect()} == {1}
    with pytest.raises(ValueError):
        matching.findings(pages, terms, phone_mode="other")


def test_no_terms(spark):
    pages = spark.createDataFrame([(1, "text")], PAGES)
    assert matching.findings(pages, spark.createDataFrame([], TERMS)).count() == 0


def test_risk_and_analysis(spark):
    text = "Ana Testwell ana@mail.example.com ana42 Northport 01632 960123"
    pages = spark.createDataFrame([(1, text, "pending"), (2, "nothing", "pending"), (3, text, "verified"), (4, None, "pending")], PAGES + ", verification_status string")
    terms = spark.createDataFrame(
        [(1, "name", "Ana Testwell", 1.0), (1, "email", "ana@mail.example.com", 1.0), (1, "username", "ana42", 1.0),
         (1, "location", "Northport", 0.8), (1, "phone", "01632 960123", 1.0)], TERMS,
    )
    got = {tuple(r) for r in analyse.analyse_pages(pages, terms).select("page_id", "subject_id", "n_findings", "risk_score").collect()}
    assert got == {(1, 1, 5, 65), (2, None, 0, 0), (4, None, 0, 0)}


def test_texts_stay_in_place_while_terms_are_small(spark):
    pages, terms = random_case(4)
    plan = matching.needle_hits(
        spark.createDataFrame(pages, PAGES), matching.prepare(spark.createDataFrame(terms, TERMS))
    )._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("piece" not in line and "extracted_text" not in line for line in exchanges)


@pytest.mark.parametrize("seed", [1, 3, 6])
def test_fetched_path_equals_brute_force(spark, seed):
    """Places above the broadcast threshold: key rows without text, candidates fetch their characters."""
    pages, terms = random_case(seed)
    pages = pages + [(200, "x" * 5000 + pages[0][1] + "y" * 3000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        page_frame = spark.createDataFrame(pages, PAGES)
        prepared = matching.prepare(spark.createDataFrame(terms, TERMS))
        plan = matching.needle_hits(page_frame, prepared)._jdf.queryExecution().optimizedPlan().toString()
        found = as_set(matching.findings(page_frame, prepared))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == brute(pages, terms)
    assert "piece_no" in plan


def test_subjects_of_one_file_are_spread(spark):
    """One task reads a small file; the terms of its subjects are built by as many tasks as a shuffle has."""
    rows = [(i, "Ana", ["Bea"], f"Testwell{i}", None, [f"nick{i}x"], ["Port 1"], []) for i in range(40)]
    schema = "subject_id bigint, first_name string, middle_names array<string>, last_name string, email string, usernames array<string>, locations array<string>, numbers array<string>"
    terms = matching.identity_terms(spark.createDataFrame(rows, schema).coalesce(1))
    assert terms.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert terms.select("subject_id").distinct().count() == 40


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_few_key_rows_are_sent(spark, monkeypatch, bits):
    """Key rows without a place are left out before the shuffle, at any size of the set of bits."""
    monkeypatch.setattr(matching, "KEY_BITS", bits)
    keys = spark.createDataFrame([(6, f"k{i:04d}") for i in range(3000)], "group int, key string")
    places = keys.where("key like 'k000%'")
    kept = {r["key"] for r in matching._with_places(keys, places).collect()}
    assert {f"k{i:04d}" for i in range(10)} <= kept and len(kept) < (20 if bits > 64 else 900)
