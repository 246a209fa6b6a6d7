"""Fetched pages to page rows, child rows and crawl status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions import html as h
from exposight.functions import text as tx
from exposight.functions import urls
from exposight.operators.rows import latest_per_key
from exposight.sources.sinks import write_batch


def crawl_status(http_status: Column, content_type: Column) -> Column:
    """``failed`` for errors, ``unsupported`` for anything but HTML, else ``success``."""
    is_html = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))
    return (
        F.when(http_status.isNull() | (http_status >= 400), "failed")
        .when(~is_html, "unsupported")
        .otherwise("success")
    )


def parse_pages(
    pages: DataFrame,
    html: str = "html",
    base_url: str = "url",
    social_domains: list[str] = fv.SOCIAL_LINK_DOMAINS,
    social_mode: str = "substring",
) -> DataFrame:
    """Replace nothing, add everything a page says: title, description, keywords, text and the
    lists images, emails, phone_numbers, contact_links, privacy_links, social_links."""
    prepared = pages.withColumns(
        {"_markup": h.drop_elements(F.col(html)), "_base": urls.base_parts(F.col(base_url))}
    )
    markup, base = F.col("_markup"), F.col("_base")
    read = prepared.withColumns(
        {
            "extracted_text": h.visible_text(markup),
            "_links": h.classified_links(markup, base, social_domains, social_mode),
        }
    )

    def urls_where(flag: str) -> Column:
        chosen = F.filter("_links", lambda a: a[flag])
        return F.array_distinct(F.transform(chosen, lambda a: a["url"]))

    mail_links = F.transform(urls_where("is_mail"), lambda u: F.replace(u, F.lit("mailto:"), F.lit("")))
    return read.withColumns(
        {
            "page_title": h.title(markup),
            "description": h.meta_content(markup, "description"),
            "keywords": h.meta_content(markup, "keywords"),
            "images": F.array_distinct(
                F.transform(h.image_sources(markup), lambda s: urls.resolve_from(base, s))
            ),
            "emails": F.array_distinct(F.concat(tx.emails_in(F.col("extracted_text")), mail_links)),
            "phone_numbers": F.array_distinct(tx.phones_in(F.col("extracted_text"))),
            "contact_links": urls_where("is_contact"),
            "privacy_links": urls_where("is_privacy"),
            "social_links": urls_where("is_social"),
        }
    ).drop("_links", "_markup", "_base")


def _child_rows(parsed: DataFrame, items: Column | str, name: str) -> DataFrame:
    """One row per list entry. A plain explode would first filter on the list's size, and that
    filter would be pushed down to where it parses every page a second time."""
    return parsed.select("page_id", F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def page_emails(parsed: DataFrame) -> DataFrame:
    return _child_rows(parsed, "emails", "email")


def page_images(parsed: DataFrame) -> DataFrame:
    return _child_rows(parsed, "images", "image_url")


def page_phones(parsed: DataFrame) -> DataFrame:
    return _child_rows(parsed, "phone_numbers", "phone_number")


def page_links(parsed: DataFrame) -> DataFrame:
    """``page_id, url, link_type``; a link has one row per class it is in."""
    typed = F.concat(*[F.transform(f"{kind}_links", _typed(kind)) for kind in ("contact", "privacy", "social")])
    return _child_rows(parsed, typed, "link").select("page_id", "link.url", "link.link_type")


def _typed(kind: str):
    return lambda url: F.struct(url.alias("url"), F.lit(kind).alias("link_type"))


def page_stats(parsed: DataFrame) -> DataFrame:
    lists = ["emails", "images", "contact_links", "privacy_links", "social_links", "phone_numbers"]
    return parsed.select("page_id", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in lists])


CHILD_TABLES = {
    "page_emails": page_emails, "page_images": page_images, "page_links": page_links, "page_phones": page_phones,
}


def pending_fetches(candidates: DataFrame, fetches: DataFrame) -> DataFrame:
    """The fetched rows whose candidate is still pending."""
    pending = candidates.where(F.col("crawl_status") == "pending").select(F.col("id").alias("search_result_id"))
    return fetches.join(pending, "search_result_id", "left_semi")


def ingest(fetches: DataFrame, folder: str, batch: int | str, crawled_at: Column | None = None) -> DataFrame:
    """Write one batch of fetched rows to the tables below ``folder``; gives the stored pages of the batch.

    ``crawl_events`` gets one row per fetched row (``event_id, search_result_id, ts, crawl_status``; the id is the
    place of the row, one row per candidate and batch), ``crawled_pages`` the parsed page of every success, the child
    tables what the pages hold. Pages are parsed once: the child tables are read off the stored pages. A repeated
    batch replaces its own rows.
    """
    crawled_at = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if crawled_at is None else crawled_at
    spark = fetches.sparkSession
    judged = fetches.withColumn("crawl_status", crawl_status(F.col("http_status"), F.col("content_type")))
    events = judged.select(
        F.col("search_result_id").alias("event_id"), "search_result_id", crawled_at.alias("ts"), "crawl_status"
    )
    write_batch(events, f"{folder}/crawl_events", batch)
    good = judged.where(F.col("crawl_status") == "success").withColumn("page_id", F.col("search_result_id"))
    parsed = parse_pages(good.drop("crawl_status"), base_url="final_url")
    write_batch(parsed, f"{folder}/crawled_pages", batch)
    stored = spark.read.schema(parsed.schema).parquet(f"{folder}/crawled_pages/batch={batch}")
    for name, rows_of in CHILD_TABLES.items():
        write_batch(rows_of(stored), f"{folder}/{name}", batch)
    return stored


def status_now(candidates: DataFrame, crawl_events: DataFrame) -> DataFrame:
    """Candidates with their latest status, attempts and last crawl; ``pending`` and 0 without any."""
    latest = latest_per_key(crawl_events, "search_result_id", "crawl_status", ["ts", "event_id"])
    current = candidates.select(F.col("id").alias("search_result_id")).join(latest, "search_result_id", "left")
    return current.select(
        "search_result_id",
        F.coalesce("crawl_status", F.lit("pending")).alias("crawl_status"),
        F.coalesce("n_events", F.lit(0)).cast("bigint").alias("crawl_attempts"),
        F.col("last_ts").alias("last_crawled"),
    )
