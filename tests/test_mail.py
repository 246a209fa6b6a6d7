"""Labels, mail cleaning and mail sources."""

import base64
import json
import re

import pytest
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.operators import labels
from exposight.plans import mail
from exposight.sources import mailbox

MAIL = "ordinal bigint, sender string, subject string, body string, date string"


def score(sections, tiers):
    total = strong = 0
    for s in sections:
        for tier, points in (("strong", 2), ("weak", 1)):
            for phrase in tiers[tier]:
                n = len(re.findall(re.escape(phrase), s.lower()))
                total += points * n
                strong += n if tier == "strong" else 0
    return total if total > 1 or strong else 0


TEXTS = [
    "wholesale", "sale and sale", "Weekly digest", "free trial", "monthly newsletter", "GDPR data subject, legal basis",
    "is livestreaming", "uploaded a new video", "aaa deal", "UPGRADE NOW upgrade", "what's new see what's new", "", "save %save %",
]


def test_scores_equal_counting_by_hand(one):
    rows = [("", t, u) for t in TEXTS for u in TEXTS]
    counts = labels.label_counts([F.col("a"), F.col("b"), F.col("c")])
    got = one(rows, "a string, b string, c string", counts)
    for row, (g,) in zip(rows, got):
        assert g.asDict() == {f"{k}_count": score(row, tiers) for k, tiers in fv.KEYWORDS.items()}, row


def test_hand_computed_labels(spark):
    cases = {"wholesale": "unlabelled", "sale and sale": "advertising", "Weekly digest": "newsletter", "free trial": "marketing",
             "coupon webinar": "ambiguous", "friend request": "notification"}
    rows = spark.createDataFrame([("", s, None) for s in cases], "original_sender_string string, subject string, body string")
    assert {r["subject"]: r["label"] for r in labels.with_labels(rows).collect()} == cases


def test_keywords_from_a_table(spark):
    table = spark.createDataFrame([("new", "strong", "xyz"), ("new", "weak", "q"), ("old", "weak", "z")], "label string, tier string, phrase string")
    words = labels.keywords_from(table)
    assert words == {"new": {"strong": ["xyz"], "weak": ["q"]}, "old": {"strong": [], "weak": ["z"]}}
    rows = spark.createDataFrame([("", "xyz", "")], "original_sender_string string, subject string, body string")
    assert labels.with_labels(rows, keywords=words).first()["label"] == "new"


def test_label_ids(one):
    got = one([("advertising", 4), ("none", 5), ("notification", -1)], "l string, n int", labels.label_id(F.col("l")), labels.label_at(F.col("n")))
    assert got == [(0, "notification"), (None, None), (4, None)]
    assert one([([0.5, 0.9, 0.9, 0.1, 0.2],)], "s array<double>", labels.best_label(F.col("s"))) == [("marketing",)]


def test_training_rows(spark):
    zw, nb = chr(0x200B), chr(0xA0)
    rows = [
        (1, "A <a@x.example.com>", " Hi  there ", f"<p>sale &amp; sale</p><p>end{nb} of{zw}</p>", "d1"),
        (0, "B <b@y.example.com>", None, None, "d0"),
        (2, "C <c@z.example.com>", " Hi  there ", f"<p>sale &amp; sale</p><p>end{nb} of{zw}</p>", "d2"),
        (3, "", None, None, "d3"),
        (4, "", "", "", "d4"),
    ]
    got = {r["ordinal"]: r for r in mail.training_rows(spark.createDataFrame(rows, MAIL)).collect()}
    # Raw equality decides: null and "" are not equal, two nulls are; the first of each stays.
    assert sorted(got) == [0, 1, 4]
    r = got[1]
    assert (r["subject"], r["body"], r["label"], r["advertising_count"]) == ("Hi  there", "sale & sale end of", "advertising", 2)
    assert (r["sender_name"], r["sender_email_username"], r["sender_email_domain"]) == ("A", "a", "x.example.com")
    inbox = mail.inbox_rows(spark.createDataFrame(rows, MAIL).withColumnRenamed("ordinal", "gmail_id"))
    assert inbox.count() == 5 and inbox.columns == mail.INBOX_COLUMNS and inbox.first()["classification"] == "unclassified"


MESSAGES = [
    b"From: A <a@x.example.com>\nSubject: plain\nDate: d1\n\nhello\n>From here\n",
    b"From: b\nSubject: multi\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\none\n--B\n"
    b"Content-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n--B\nContent-Type: text/plain\n\ntwo\n--B--\n",
    b"From: c\nSubject: html only\nContent-Type: text/html\n\n<p>x</p>\n",
    b"From: d\nSubject: qp\nContent-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 =3D\n",
    b"From: e\nSubject: bad byte\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"ok\xffok") + b"\n",
    b"From: f\n\nno subject\n",
]
EXPECTED = {
    "plain": "hello\n>From here\n", "multi": "onetwo", "html only": "<p>x</p>\n", "qp": "café =\n", "bad byte": "okok", "": "no subject\n",
}


def test_mbox_and_api_feed_agree(spark, tmp_path):
    mbox = b"".join(b"From x@y.example.com Mon Jan  1 00:00:00 2024\n" + m + b"\n" for m in MESSAGES)
    (tmp_path / "small.mbox").write_bytes(mbox)
    rows = mailbox.read_mbox(spark, str(tmp_path / "small.mbox")).orderBy("mail_file", "mail_block", "mail_seq").collect()
    assert [r["subject"] for r in rows] == ["plain", "multi", "html only", "qp", "bad byte", ""]
    assert {r["subject"]: r["body"] for r in rows} == EXPECTED
    feed = [json.dumps({"id": f"m{i}", "raw": base64.urlsafe_b64encode(m).decode()}) for i, m in enumerate(MESSAGES)]
    (tmp_path / "feed.json").write_text("\n".join(feed))
    api = mailbox.read_api_feed(spark, str(tmp_path / "feed.json"))
    assert {r["subject"]: r["body"] for r in api.collect()} == EXPECTED
    ids = spark.createDataFrame([("b",), ("a",), ("c",)], "id string")
    assert [r["id"] for r in mailbox.first_ids(ids, 2).collect()] == ["a", "b"]


def test_a_large_mbox_is_read_by_many_tasks(spark, tmp_path):
    one = "From x Mon Jan  1 00:00:00 2024\nFrom: s{0}\nSubject: n{0}\n\n" + "line\n" * 50 + "\n"
    (tmp_path / "big.mbox").write_text("".join(one.format(i) for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = mailbox.read_mbox(spark, str(tmp_path / "big.mbox"))
        assert df.select(F.spark_partition_id()).distinct().count() > 3
        rows = df.orderBy("mail_file", "mail_block", "mail_seq").select("subject", "body").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["subject"] for r in rows] == [f"n{i}" for i in range(2000)]
    assert {r["body"] for r in rows} == {"line\n" * 50}


def test_mailbox_to_training_rows(spark, tmp_path):
    box = tmp_path / "box.mbox"
    mails = [("first", "Flash sale: buy now"), ("second", "GDPR data subject"), ("first", "Flash sale: buy now"), ("third", "hello")]
    box.write_text("\n".join(f"From x\nFrom: Jane <j@x.com>\nSubject: {s}\nDate: d\n\n{b}\n" for s, b in mails))
    found = mail.training_rows(mailbox.read_mbox(spark, str(box))).orderBy("ordinal").collect()
    assert [(r["subject"], r["body"], r["sender_email_domain"]) for r in found] == [(s, b, "x.com") for s, b in (mails[0], mails[1], mails[3])]


def test_mailbox_with_crlf_line_ends(spark, tmp_path):
    one = "From x Mon Jan  1 00:00:00 2024\r\nFrom: s{0}\r\nSubject: n{0}\r\n\r\nfirst\r\nlast {0}\r\n\r\n"
    (tmp_path / "crlf.mbox").write_bytes("".join(one.format(i) for i in range(3)).encode())
    rows = mailbox.read_mbox(spark, str(tmp_path / "crlf.mbox")).orderBy("mail_file", "mail_block", "mail_seq").collect()
    assert [(r["sender"], r["subject"], r["body"]) for r in rows] == [(f"s{i}", f"n{i}", f"first\r\nlast {i}\r\n") for i in range(3)]


def test_absent_phrases_are_only_looked_for(spark):
    mails = spark.createDataFrame([("a", "Sale sale", "SALE wholesale, buy now buy now"), ("b", "", "")], "sender string, subject string, body string")
    counted = labels.with_labels(mails, "sender")
    got = {r["sender"]: r["advertising_count"] for r in counted.collect()}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    points = fv.KEYWORD_POINTS
    assert got == {"a": 2 * points["strong"] + 4 * points["weak"], "b": 0} and "CASE WHEN Contains(" in plan
