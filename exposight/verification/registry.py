"""Named queries over the given tables, one per operator. ``oracles.py`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposight import schemas
from exposight.functions import fixed_values as fv
from exposight.functions import html as h
from exposight.functions import people, sender, urls
from exposight.functions import text as tx
from exposight.operators import evaluation, features, labels, matching, rows
from exposight.operators.split import stratified_split
from exposight.plans import analyse, crawl, discovery, mail, review, training
from exposight.session import materialise, work_folder
from exposight.sources import landed, mailbox, sinks
from exposight.streaming import pages as streams
from exposight.verification.views import given_table, spark_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE = "\n"
F1_BAR = 0.5


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return discovery.subjects_from(spark_view(spark, d, "subjects"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return matching.identity_terms(_subjects(spark, d))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return crawl.parse_pages(spark_view(spark, d, "raw_pages"))


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "mails")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return given_table(spark, d, "documents")


def _lines(values: str) -> Column:
    return F.array_join(values, LINE)


# --- sources -------------------------------------------------------------------


def _message_text(body: Column) -> Column:
    header = [F.lit("From: "), F.col("sender"), F.lit("\nSubject: "), F.col("subject"), F.lit("\nDate: "), F.col("date")]
    return F.concat(*header, F.lit("\n\n"), body)


def _mbox_records(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.regexp_replace("body", r"(?m)^From ", ">From ")
    record = F.concat(F.lit("From box@mail.example.com Mon Jan  1 00:00:00 2024\n"), _message_text(quoted), F.lit("\n"))
    return spark_view(spark, d, "messages").select(record.alias("value"))


@query
def mail_scan(spark, d):
    folder = work_folder(spark, "mbox")
    _mbox_records(spark, d).write.text(folder)
    return mailbox.read_mbox(spark, folder).select("sender", "subject", "date", "body")


@query
def mail_raw_decode(spark, d):
    raw = F.translate(F.base64(F.encode(_message_text(F.col("body")), "UTF-8")), "+/", "-_")
    folder = work_folder(spark, "mail-feed")
    spark_view(spark, d, "messages").select("id", raw.alias("raw")).write.json(folder)
    return mailbox.read_api_feed(spark, folder)


@query
def mail_ids_top(spark, d):
    return mailbox.first_ids(spark_view(spark, d, "messages"), fv.INBOX_SIZE)


@query
def hits_explode(spark, d):
    listed = F.array_sort(F.collect_list(F.struct("result_rank", "href", "title", "body")))
    hits = spark_view(spark, d, "hits").groupBy("subject_id", "query_ord", "search_query").agg(listed.alias("hits"))
    feed = hits.withColumn(
        "hits", F.transform("hits", lambda x: F.struct(x["href"].alias("href"), x["title"].alias("title"), x["body"].alias("body")))
    )
    folder = work_folder(spark, "hit-feed")
    feed.write.json(folder)
    return landed.read_hits(spark, folder)


@query
def fetch_feed(spark, d):
    fetches = landed.normalise_fetches(spark_view(spark, d, "fetches"))
    return fetches.select("search_result_id", "final_url", "http_status", "content_type", F.md5("html").alias("html_md5"))


@query
def html_files(spark, d):
    folder = work_folder(spark, "html-files")
    sinks.write_files(spark_view(spark, d, "raw_pages"), folder, "page_id", "html")
    page_id = F.regexp_extract("final_url", r"page_id=(\d+)", 1).cast("bigint")
    files = landed.read_html_files(spark, folder)
    return files.select(page_id.alias("page_id"), "http_status", "content_type", F.md5("html").alias("html_md5"))


@query
def pending_pages(spark, d):
    return analyse.pending_pages(spark_view(spark, d, "page_texts"))


@query
def training_by_id(spark, d):
    wrong = evaluation.mistakes(spark_view(spark, d, "predictions"), spark_view(spark, d, "mail_domains"))
    return training.training_rows_by_id(spark_view(spark, d, "training"), wrong)


@query
def report_history(spark, d):
    report = evaluation.classification_report(spark_view(spark, d, "predictions"))
    folder = work_folder(spark, "history")
    for stamp in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        sinks.write_csv(training.report_rows(report, F.lit(stamp)), folder, mode="append")
    return landed.read_report_history(spark, folder)


@query
def identity_terms(spark, d):
    return _terms(spark, d)


# --- table changes -------------------------------------------------------------


@query
def hits_insert_ignore(spark, d):
    fresh = discovery.first_seen(spark_view(spark, d, "hits"))
    new = rows.insert_or_ignore(fresh, spark_view(spark, d, "known_urls"), ["subject_id", "url"])
    return new.select("subject_id", "url", "query_ord", "result_rank", "title")


@query
def page_emails(spark, d):
    return crawl.page_emails(_parsed(spark, d))


@query
def page_images(spark, d):
    return crawl.page_images(_parsed(spark, d))


@query
def page_links(spark, d):
    return crawl.page_links(_parsed(spark, d))


@query
def page_phones(spark, d):
    return crawl.page_phones(_parsed(spark, d))


@query
def crawl_status_latest(spark, d):
    return crawl.status_now(spark_view(spark, d, "candidates"), spark_view(spark, d, "crawl_events"))


@query
def apply_corrections(spark, d):
    return training.apply_corrections(spark_view(spark, d, "training"), spark_view(spark, d, "corrections"))


@query
def review_apply(spark, d):
    now = review.apply_decisions(spark_view(spark, d, "crawled"), spark_view(spark, d, "decisions"))
    return now.select("id", "verification_status")


@query
def emails_upsert(spark, d):
    return rows.upsert(spark_view(spark, d, "stored_emails"), spark_view(spark, d, "incoming_emails"), "gmail_id", ["event_id"])


@query
def schema_check(spark, d):
    checked = {"crawled": "crawled_pages", "child_links": "page_links", "training": "training_data"}
    return rows.union_all([schemas.schema_report(spark_view(spark, d, v), t) for v, t in checked.items()])


@query
def constraint_report(spark, d):
    pages = spark_view(spark, d, "crawled")
    return rows.union_all(
        [
            schemas.constraint_report(spark_view(spark, d, "child_links"), "page_links", {"crawled_pages": pages}),
            schemas.constraint_report(pages, "crawled_pages", {"search_results": spark_view(spark, d, "candidates")}),
        ]
    )


@query
def cascade_delete(spark, d):
    return rows.without_parents(spark_view(spark, d, "child_links"), given_table(spark, d, "labels"), "page_id", "doc_id")


@query
def mail_prepare(spark, d):
    return mail.prepare_training(_mails(spark, d))


# --- filters and projections ---------------------------------------------------


@query
def crawl_classify(spark, d):
    status = crawl.crawl_status(F.col("http_status"), F.col("content_type"))
    return spark_view(spark, d, "fetches").select("search_result_id", status.alias("crawl_status"))


@query
def training_set(spark, d):
    stored = spark_view(spark, d, "training")
    both = [
        training.training_set(stored, c).withColumn("filter_on", F.lit(c)) for c in ("label", "training_label")
    ]
    return rows.union_all(both).select("filter_on", "id", "training_label")


def _queue(mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pages, candidates = spark_view(spark, d, "crawled"), spark_view(spark, d, "candidates")
        return review.review_queue(pages, candidates, mode).select(
            "id", "page_title", "risk_score", "match_score", "verification_status", "url"
        )

    return run


for _name in ("candidates", "false_negatives", "all_pending", "previous"):
    QUERIES[f"review_{_name}"] = _queue(_name)


@query
def mistakes(spark, d):
    return evaluation.mistakes(spark_view(spark, d, "predictions"), spark_view(spark, d, "mail_domains"))


@query
def email_text(spark, d):
    prepared = _mails(spark, d).withColumnRenamed("sender", "original_sender_string")
    return prepared.select("ordinal", mail.email_text().alias("text_or_null"), mail.email_text(True).alias("text"))


# --- matching ------------------------------------------------------------------


@query
def pii_findings(spark, d):
    return matching.findings(spark_view(spark, d, "page_texts"), _terms(spark, d))


@query
def pii_phone(spark, d):
    phones = matching.prepare(_terms(spark, d).where(F.col("entity_type") == "phone"))  # once for both modes
    pages = spark_view(spark, d, "page_texts")
    modes = [
        matching.findings(pages, phones, phone_mode=m).select(F.lit(m).alias("phone_mode"), "subject_id", "page_id", "entity_value")
        for m in ("page_digits", "token")
    ]
    return rows.union_all(modes)


@query
def risk_score(spark, d):
    pages = spark_view(spark, d, "page_texts")
    return matching.page_risk(pages, matching.risk_scores(matching.findings(pages, _terms(spark, d))))


@query
def review_detail(spark, d):
    pages = spark_view(spark, d, "page_texts")
    found = matching.findings(pages, _terms(spark, d))
    detail = review.review_detail(pages.withColumnRenamed("page_id", "id"), found)
    return detail.withColumn("finding_lines", _lines("finding_lines"))


# --- aggregates ----------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return labels.with_labels(_mails(spark, d), sender="sender")


@query
def label_counts(spark, d):
    return _labelled(spark, d).select("ordinal", *[F.col(f"{x}_count").cast("bigint").alias(f"{x}_count") for x in fv.LABELS])


@query
def label_assign(spark, d):
    return _labelled(spark, d).select("ordinal", "label")


@query
def label_distribution(spark, d):
    return rows.value_counts(training.training_set(spark_view(spark, d, "training")), "label")


@query
def null_profile(spark, d):
    return rows.null_counts(mail.prepare_training(_mails(spark, d)))


@query
def dedup_stats(spark, d):
    return rows.dedup_counts(_mails(spark, d), ["subject", "body"])


@query
def frame_profile(spark, d):
    return rows.profile(_mails(spark, d))


@query
def page_stats(spark, d):
    return crawl.page_stats(_parsed(spark, d))


def _rounded(report: DataFrame, digits: int = 6) -> DataFrame:
    return report.withColumns({m: F.round(m, digits) for m in ("precision", "recall", "f1_score")})


@query
def classification_report(spark, d):
    predictions = spark_view(spark, d, "predictions")
    seen = evaluation.classification_report(predictions).withColumn("classes", F.lit("seen"))
    wanted = fv.LABELS + ["spam"]
    given = evaluation.classification_report(predictions, wanted).withColumn("classes", F.lit("given"))
    return _rounded(seen.unionByName(given))


@query
def class_weights(spark, d):
    weights = evaluation.class_weights(spark_view(spark, d, "training"))
    return weights.withColumn("weight", F.round("weight", 6))


# --- windows -------------------------------------------------------------------


@query
def mail_dedup(spark, d):
    return mail.keep_first_mail(_mails(spark, d)).select("ordinal", "subject", "body")


@query
def hits_first_seen(spark, d):
    return discovery.first_seen(spark_view(spark, d, "hits")).select("subject_id", "url", "query_ord", "result_rank")


@query
def hits_topk(spark, d):
    return discovery.top_hits(spark_view(spark, d, "hits")).select("subject_id", "query_ord", "result_rank", "href")


@query
def stratified_split_rows(spark, d):
    return stratified_split(spark_view(spark, d, "training"), "id", "label").select("id", "label", "is_test")


QUERIES["stratified_split"] = QUERIES.pop("stratified_split_rows")


@query
def name_permutations(spark, d):
    names = people.search_names(F.col("first_name"), F.col("middle_names"), F.col("last_name"))
    return _subjects(spark, d).select("subject_id", F.posexplode(names).alias("name_ord", "name"))


@query
def search_queries(spark, d):
    return discovery.search_queries(_subjects(spark, d)).select("subject_id", "query_ord", "search_query")


# --- scalar functions ----------------------------------------------------------


@query
def page_text(spark, d):
    return spark_view(spark, d, "raw_pages").select("page_id", h.visible_text(h.drop_elements(F.col("html"))).alias("extracted_text"))


@query
def page_meta(spark, d):
    return _parsed(spark, d).select("page_id", "page_title", "description", "keywords")


@query
def mail_clean(spark, d):
    return mail.clean_text(_mails(spark, d)).select("ordinal", "subject", "body")


@query
def doc_emails(spark, d):
    found = F.posexplode(tx.emails_in(F.col("text"))).alias("pos", "email")
    return _documents(spark, d).select("doc_id", found)


@query
def doc_phones(spark, d):
    found = F.posexplode(tx.phones_in(F.col("text"))).alias("pos", "phone_number")
    return _documents(spark, d).select("doc_id", found)


@query
def sender_parts(spark, d):
    return mail.split_sender(_mails(spark, d), "sender").select("ordinal", "sender", *mail.SENDER_COLUMNS)


@query
def url_canonical(spark, d):
    return spark_view(spark, d, "hits").select("href", urls.canonical(F.col("href")).alias("url"))


@query
def url_domain(spark, d):
    return spark_view(spark, d, "hits").select("href", urls.domain(F.col("href")).alias("domain"))


@query
def url_resolve(spark, d):
    pages = spark_view(spark, d, "raw_pages")
    links = pages.select("page_id", "url", F.explode(F.transform(h.anchors(h.drop_elements(F.col("html"))), lambda a: a["href"])).alias("href"))
    return links.select("page_id", "href", urls.resolve(F.col("url"), F.col("href")).alias("resolved"))


@query
def query_confidence(spark, d):
    rated = discovery.with_query_confidence(spark_view(spark, d, "hits"), _subjects(spark, d))
    return rated.select("subject_id", "query_ord", "result_rank", "query_confidence")


@query
def label_encode(spark, d):
    number = labels.label_id(F.col("actual"))
    encoded = spark_view(spark, d, "predictions").select("email_id", "actual", number.alias("label_id"))
    return encoded.withColumn("label_back", labels.label_at(F.col("label_id")))


@query
def argmax_label(spark, d):
    scores = F.array(*[F.col(f"s{i}") for i in range(5)])
    return spark_view(spark, d, "score_vectors").select("vec_id", labels.best_label(scores).alias("label"))


# --- learning ------------------------------------------------------------------


@query
def tokens(spark, d):
    return features.word_counts(_documents(spark, d), "doc_id", "text")


@query
def tfidf(spark, d):
    weights = features.tfidf(_documents(spark, d), "doc_id", "text")
    return weights.withColumn("weight", F.round("weight", 6))


@query
def encode_fixed(spark, d):
    docs = _documents(spark, d)
    encoded = features.encode_fixed(docs, "doc_id", "text", features.vocabulary(docs, "text"))
    return encoded.select(
        "doc_id",
        F.array_join("input_ids", ",").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_real"),
    )


def _stored_training(spark: SparkSession, d: str) -> DataFrame:
    stored = materialise(mail.training_rows(spark_view(spark, d, "short_mails")), "training-rows")
    human = {"human_label": F.lit(None).cast("string"), "human_verified": F.lit(False)}
    return stored.withColumnRenamed("ordinal", "id").withColumns(human)


@query
def svm_train_eval(spark, d):
    """Exact held-out support per label, and whether its F1 reaches the bar that the planted labels allow."""
    _, _, report, _ = training.training_loop(_stored_training(spark, d))
    return report.where(F.col("label").isin(fv.LABELS)).select("label", "support", (F.col("f1_score") >= F1_BAR).alias("reaches_bar"))


@query
def svm_language_eval(spark, d):
    """The same loop over the whole texts of the documents, by language."""
    nothing = F.lit("")
    docs = _documents(spark, d).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.col("text").alias("body"), nothing.alias("subject"),
        nothing.alias("original_sender_string"), F.col("source").alias("sender_email_domain"),
        F.lit(None).cast("string").alias("human_label"), F.lit(False).alias("human_verified"),
    )
    _, _, report, _ = training.training_loop(docs)
    averages = F.col("label").isin("accuracy", "macro avg", "weighted avg")
    return report.where(~averages).select("label", "support", (F.col("f1_score") >= F1_BAR).alias("reaches_bar"))


# --- flows ---------------------------------------------------------------------


@query
def mail_training_rows(spark, d):
    cleaned = mail.training_rows(_mails(spark, d))
    return cleaned.withColumns({f"{x}_count": F.col(f"{x}_count").cast("bigint") for x in fv.LABELS})


@query
def inbox_rows(spark, d):
    return mail.inbox_rows(_mails(spark, d).withColumnRenamed("ordinal", "gmail_id"))


@query
def parse_pages(spark, d):
    lists = ["images", "emails", "phone_numbers", "contact_links", "privacy_links", "social_links"]
    return _parsed(spark, d).select(
        "page_id", "page_title", "description", "keywords", "extracted_text", *[_lines(c).alias(c) for c in lists]
    )


@query
def analyse_pages(spark, d):
    return analyse.analyse_pages(spark_view(spark, d, "page_texts"), _terms(spark, d))


@query
def discovery_ingest(spark, d):
    new = discovery.ingest(spark_view(spark, d, "hits"), _subjects(spark, d), spark_view(spark, d, "known_urls"))
    return new.drop("id")


@query
def mbox_training_rows(spark, d):
    """The mailbox scan and the cleaning flow in one: a written mailbox to labelled rows."""
    folder = work_folder(spark, "mbox-flow")
    _mbox_records(spark, d).write.text(folder)
    return mail.training_rows(mailbox.read_mbox(spark, folder)).select(
        "sender_name", "sender_email_username", "sender_email_domain", "original_sender_string", "subject", "body", "label"
    )


@query
def review_after_analysis(spark, d):
    """Pending pages are analysed, their scores stored, and the queue of exposed pages read from that."""
    texts = spark_view(spark, d, "page_texts")
    risks = analyse.analyse_pages(texts, _terms(spark, d))
    scored = review.with_risk(spark_view(spark, d, "text_pages"), risks)
    queue = review.review_queue(scored, spark_view(spark, d, "text_candidates"), "candidates")
    return queue.select("id", "page_title", "risk_score", "match_score", "url")


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the tables of a crawl: ``table_name, page_id, item, detail``."""
    nothing = F.lit(None).cast("string")
    shown = {
        "crawl_events": ("search_result_id", F.col("crawl_status"), F.col("ts")),
        "crawled_pages": ("page_id", F.col("page_title"), F.col("extracted_text")),
        "page_emails": ("page_id", F.col("email"), nothing),
        "page_images": ("page_id", F.col("image_url"), nothing),
        "page_links": ("page_id", F.col("url"), F.col("link_type")),
        "page_phones": ("page_id", F.col("phone_number"), nothing),
    }
    return rows.union_all(
        [
            spark.read.parquet(f"{folder}/{name}").select(
                F.lit(name).alias("table_name"), F.col(key).alias("page_id"), item.alias("item"), detail.alias("detail")
            )
            for name, (key, item, detail) in shown.items()
        ]
    )


@query
def crawl_ingest(spark, d):
    fetches = landed.normalise_fetches(spark_view(spark, d, "fetches"))
    wanted = crawl.pending_fetches(spark_view(spark, d, "candidates"), fetches)
    folder = work_folder(spark, "crawl")
    crawl.ingest(wanted, folder, batch=0, crawled_at=F.lit("2024-01-01 00:00:00"))
    return _written(spark, folder)


@query
def stream_analyse(spark, d):
    folder, out = work_folder(spark, "landed"), work_folder(spark, "analysed")
    fetches = landed.normalise_fetches(spark_view(spark, d, "fetches"))
    # All rows land twice: the second copies must not add anything.
    half = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    fetches.repartition(2 * half, "search_result_id").write.parquet(folder)
    fetches.repartition(half, "search_result_id").write.mode("append").parquet(folder)
    stream = streams.landed_pages(spark, folder, landed.FETCH_SCHEMA, files_per_batch=half)
    streams.analyse_stream(stream, _terms(spark, d), out, work_folder(spark, "checkpoint")).awaitTermination()
    events = spark.read.parquet(f"{out}/crawl_events").select(F.col("search_result_id").alias("page_id"), "crawl_status")
    pages = spark.read.parquet(f"{out}/crawled_pages").select("page_id", "page_title", "extracted_text")
    found = spark.read.parquet(f"{out}/findings").select("page_id", "subject_id", "entity_type", "entity_value")
    risk = spark.read.parquet(f"{out}/page_risk").select("page_id", "subject_id", "risk_score")
    told = risk.join(found, ["page_id", "subject_id"], "left")
    return events.join(pages, "page_id", "left").join(told, "page_id", "left").select(
        "page_id", "crawl_status", "page_title", "extracted_text", "subject_id", "entity_type", "entity_value", "risk_score"
    )


@query
def stream_dedup(spark, d):
    folder, out = work_folder(spark, "landed-hits"), work_folder(spark, "new-urls")
    hits = spark_view(spark, d, "hits").select("subject_id", "href")
    hits.write.parquet(folder)
    stream = streams.landed_pages(spark, folder, "subject_id bigint, href string", files_per_batch=4)
    streams.write_new_urls(stream, out, work_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("subject_id bigint, url string").parquet(out)
