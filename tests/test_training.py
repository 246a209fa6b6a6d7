"""Report, split, features, classifier, corrections."""

import math
import random
import threading
from collections import Counter

from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.operators import evaluation, features, split
from exposight.plans import training


def test_report_by_hand(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] + [("c", "a")]
    df = spark.createDataFrame(pairs, "actual string, predicted string")
    report = {r["label"]: r for r in evaluation.classification_report(df).collect()}
    assert (report["a"]["precision"], report["a"]["recall"], report["a"]["support"]) == (0.6, 0.75, 4)
    assert (report["c"]["precision"], report["c"]["recall"], report["c"]["f1_score"]) == (0.0, 0.0, 0.0)
    assert report["accuracy"]["precision"] == report["accuracy"]["recall"] == 5 / 8
    assert math.isclose(report["macro avg"]["recall"], (0.75 + 2 / 3 + 0) / 3)
    assert math.isclose(report["weighted avg"]["recall"], 5 / 8)
    fixed = {r["label"] for r in evaluation.classification_report(df, labels=["a", "z"]).collect()}
    assert fixed == {"a", "z", "accuracy", "macro avg", "weighted avg"}
    kept = training.report_rows(evaluation.classification_report(df), F.lit("t"))
    assert {r["label"]: r["recall"] for r in kept.collect()}["b"] == 0.67


def test_split_is_exact_and_complete(spark):
    rng = random.Random(1)
    labels = ["hot"] * 700 + ["x"] * 203 + ["y"] * 98 + ["z"]
    rng.shuffle(labels)
    df = spark.createDataFrame(list(enumerate(labels)), "id bigint, label string")
    got = split.stratified_split(df, "id", "label").collect()
    assert sorted(r["id"] for r in got) == list(range(len(labels)))
    held = Counter(r["label"] for r in got if r["is_test"])
    assert sum(held.values()) == math.ceil(len(labels) / 5)
    assert all(abs(held[k] - n / 5) < 1 for k, n in Counter(labels).items())
    again = split.stratified_split(df.repartition(7), "id", "label").where("is_test").select("id").collect()
    assert {r["id"] for r in again} == {r["id"] for r in got if r["is_test"]}
    other = split.stratified_split(df, "id", "label", seed=7).where("is_test").select("id").collect()
    assert {r["id"] for r in other} != {r["id"] for r in got if r["is_test"]}


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "Red red blue"), (2, "blue sky"), (3, "")], "id bigint, t string")
    got = {(r["id"], r["word"]): r["weight"] for r in features.tfidf(docs, "id", "t").collect()}
    idf = lambda df: math.log(4 / (1 + df)) + 1
    red, blue = 2 * idf(1), idf(2)
    assert math.isclose(got[(1, "red")], red / math.hypot(red, blue))
    assert math.isclose(got[(2, "sky")], idf(1) / math.hypot(idf(1), idf(2))) and len(got) == 4
    small = features.vocabulary(docs, "t", size=2).collect()
    assert [(r["word"], r["n_total"], r["n_docs"]) for r in small] == [("blue", 2, 2), ("red", 2, 1)]


def test_word_counts_of_a_task_do_not_grow_with_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 150, "red blue red " * 10) for i in range(200)], "id bigint, t string")
    parts = []
    for chars in (1 << 22, 4000, 1000):
        monkeypatch.setattr(features, "DEAL_CHARS", chars)
        counts = features.word_counts(docs, "id", "t")
        parts.append(counts.rdd.getNumPartitions())
        got = {(r["id"], r["word"]): r["n"] for r in counts.collect()}
        assert len(got) == 300 and got[(149, "red")] == 20 and got[(0, "blue")] == 20
        assert "id" in features.tfidf(docs, "id", "t").columns
    assert parts == [1, 26000 // 4000 + 1, 27]


def test_fixed_length_ids(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "aa " * 9), (3, "zz")], "id bigint, t string")
    vocab = features.vocabulary(docs.where("id < 3"), "t", 5)
    got = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in features.encode_fixed(docs, "id", "t", vocab, length=4).collect()}
    assert got == {1: ([2, 3, 2, 0], [1, 1, 1, 0]), 2: ([2] * 4, [1] * 4), 3: ([1, 0, 0, 0], [1, 0, 0, 0])}


def test_training_set_and_corrections(spark):
    stored = spark.createDataFrame(
        [(1, "marketing", None, False), (2, "ambiguous", "privacy", True), (3, "privacy", "newsletter", True), (4, "unlabelled", None, None)],
        "id bigint, label string, human_label string, human_verified boolean",
    )
    assert {r["id"]: r["training_label"] for r in training.training_set(stored).collect()} == {1: "marketing", 3: "newsletter"}
    wider = training.training_set(stored, filter_on="training_label")
    assert {r["id"] for r in wider.collect()} == {1, 2, 3}
    chosen = spark.createDataFrame([(4, 1, "t1", 0), (4, 2, "t2", 4), (4, 3, "t3", 9), (1, 4, "t1", -1)], "email_id bigint, event_id bigint, ts string, label_index int")
    after = {r["id"]: (r["human_label"], r["human_verified"]) for r in training.apply_corrections(stored, chosen).collect()}
    assert after == {1: (None, False), 2: ("privacy", True), 3: ("newsletter", True), 4: ("notification", True)}
    assert training.training_row(stored, 2).first()["training_label"] == "privacy"
    wrong = spark.createDataFrame([(2,), (2,)], "email_id bigint")
    assert training.training_rows_by_id(stored, wrong).count() == 1


def test_classifier_learns_saves_and_loads(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        label = fv.LABELS[min(i % 7, 4)]  # the last class holds three sevenths
        body = " ".join([label] * 2 + [rng.choice(["the", "and", "you", "mail", "now"]) for _ in range(8)])
        rows.append((i, "s@x.example.com", "d.example.com", "hello", None if i == 5 else body, label, None, False))
    stored = spark.createDataFrame(
        rows, "id bigint, original_sender_string string, sender_email_domain string, subject string, body string, label string, human_label string, human_verified boolean"
    )
    model, predictions, report, wrong = training.training_loop(stored, max_iter=15)
    scores = {r["label"]: r["f1_score"] for r in report.collect()}
    assert scores["macro avg"] >= 0.95 and predictions.count() == 80
    assert wrong.columns == ["email_id", "actual", "predicted", "sender_email_domain"]
    folder = str(tmp_path / "model")
    assert training.MailClassifier.load(spark, folder) is None
    model.save(spark, folder)
    texts = training.with_email_text(stored).select("id", "email_text")
    same = training.MailClassifier.load(spark, folder).predict(texts)
    assert {tuple(r) for r in same.select("id", "predicted").collect()} == {tuple(r) for r in model.predict(texts).select("id", "predicted").collect()}


def test_labels_are_fitted_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2)
    fit = training.LinearSVC.fit

    def met(self, rows):
        both.wait(timeout=60)
        return fit(self, rows)

    monkeypatch.setattr(training.LinearSVC, "fit", met)
    rows = [(f"sale offer {i}" if i % 2 else f"policy notice {i}", "advertising" if i % 2 else "privacy") for i in range(20)]
    texts = spark.createDataFrame(rows, "email_text string, training_label string")
    model = training.MailClassifier.fit(texts, max_iter=20)
    assert model.labels == ["advertising", "privacy"]
    assert model.predict(texts).where("predicted != training_label").count() == 0
