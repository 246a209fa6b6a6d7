"""Table schemas, column defaults and constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from exposight.functions import fixed_values as fv


@dataclass(frozen=True)
class Table:
    columns: str
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    # child column -> (parent table, parent column)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    # column -> default; "now" stands for the time of the run
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


_PAGE = {"page_id": ("crawled_pages", "id")}

TABLES = {
    "emails": Table(
        "id bigint, message_id string, gmail_id string, sender_name string, sender_email_username string, "
        "sender_email_domain string, original_sender_string string, subject string, body string, date string, "
        "is_read int, classification string, confidence double, processed int, created_at timestamp",
        not_null=("sender_email_username", "sender_email_domain", "original_sender_string", "subject", "body"),
        unique=("message_id", "gmail_id"),
        defaults={"is_read": 0, "processed": 0, "created_at": "now"},
    ),
    "companies": Table(
        "id bigint, domain string, company_name string, industry string, country string, contact_email string, "
        "privacy_email string, privacy_url string, website string, privacy_score double, cluster int, "
        "created_at timestamp",
        not_null=("domain", "company_name"),
        unique=("domain",),
        defaults={"created_at": "now"},
    ),
    "search_results": Table(
        "id bigint, subject_id bigint, search_engine string, search_query string, query_confidence double, url string, "
        "domain string, page_title string, snippet string, result_rank int, discovered_at timestamp, "
        "crawl_status string, last_crawled timestamp, crawl_attempts int",
        not_null=("search_engine", "search_query", "url"),
        unique=("id",),
        defaults={"query_confidence": 0.0, "discovered_at": "now", "crawl_status": "pending", "crawl_attempts": 0},
    ),
    "pii_entities": Table(
        "subject_id bigint, page_id bigint, entity_type string, entity_value string, confidence double, "
        "analysed_at timestamp",
        not_null=("page_id", "entity_type", "entity_value"),
        references=_PAGE,
        defaults={"analysed_at": "now"},
    ),
    "crawled_pages": Table(
        "id bigint, search_result_id bigint, http_status int, content_type string, page_title string, "
        "description string, keywords string, html string, extracted_text string, content_hash string, "
        "verification_status string, risk_score double, match_score double, crawled_at timestamp, company_id bigint",
        not_null=("search_result_id",),
        unique=("search_result_id",),
        references={"company_id": ("companies", "id"), "search_result_id": ("search_results", "id")},
        defaults={"verification_status": "pending", "risk_score": 0.0, "match_score": 0.0, "crawled_at": "now"},
    ),
    "page_emails": Table("page_id bigint, email string", ("page_id", "email"), references=_PAGE),
    "page_images": Table("page_id bigint, image_url string", ("page_id", "image_url"), references=_PAGE),
    "page_links": Table(
        "page_id bigint, url string, link_type string", ("page_id", "url", "link_type"), references=_PAGE
    ),
    "page_phones": Table("page_id bigint, phone_number string", ("page_id", "phone_number"), references=_PAGE),
    "gdpr_requests": Table(
        "id bigint, company_id bigint, email_id bigint, page_id bigint, generated_request string, tone string, "
        "recipient_email string, status string, sent_date timestamp, response_date timestamp, notes string, "
        "created_at timestamp",
        not_null=("generated_request",),
        references={
            "company_id": ("companies", "id"),
            "email_id": ("emails", "id"),
            "page_id": ("crawled_pages", "id"),
        },
        defaults={"status": "Draft", "created_at": "now"},
    ),
    "training_data": Table(
        "id bigint, sender_name string, sender_email_username string, sender_email_domain string, "
        "original_sender_string string, subject string, body string, date string, "
        + "".join(f"{label}_count int, " for label in fv.LABELS)
        + "label string, human_label string, human_verified boolean",
        not_null=(
            "sender_name", "sender_email_username", "sender_email_domain", "original_sender_string",
            "subject", "body", "date",
        ),
        defaults={**{f"{label}_count": 0 for label in fv.LABELS}, "label": "unlabelled", "human_verified": False},
    ),
}


def with_defaults(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """Bring ``df`` to the table's columns, order and types; fill in declared defaults."""
    spec = TABLES[table]
    now = F.current_timestamp() if now is None else now
    columns = []
    for f in spec.schema.fields:
        default = spec.defaults.get(f.name)
        value = now if default == "now" else F.lit(default)
        have = F.coalesce(F.col(f.name), value) if f.name in df.columns else value
        columns.append(have.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def missing_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Names of required tables the catalog does not have."""
    return [t for t in TABLES if not spark.catalog.tableExists(f"{database}.{t}")]


def create_tables(spark: SparkSession, database: str = "default", source: str = "parquet") -> None:
    """Create every missing table; existing ones are left alone."""
    for name, spec in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({spec.columns}) USING {source}")


def schema_report(df: DataFrame, table: str) -> DataFrame:
    """Per declared column: is it there, has it the declared type, how many values are missing.

    One pass over the table; the report has one row per column.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for f in TABLES[table].schema.fields:
        state = "missing" if f.name not in actual else "ok" if actual[f.name] == f.dataType else "other type"
        nulls = F.sum(F.col(f.name).isNull().cast("bigint")) if f.name in actual else F.count("*")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(state).alias("state"),
                F.coalesce(nulls, F.lit(0)).cast("bigint").alias("n_null"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.lit(table).alias("table_name"), F.inline("r"))


def constraint_report(df: DataFrame, table: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Violations per declared rule: nulls in NOT NULL columns, repeated unique keys, orphans.

    Keys are counted per value before they meet the parent table, so a key held
    by a third of all rows travels as one row.
    """
    spec, parents = TABLES[table], parents or {}
    present = [c for c in spec.not_null if c in df.columns]
    parts = []
    if present:
        nulls = [
            F.struct(
                F.lit("not_null").alias("rule"),
                F.lit(c).alias("column_name"),
                F.coalesce(F.sum(F.col(c).isNull().cast("bigint")), F.lit(0).cast("bigint")).alias("violations"),
            )
            for c in present
        ]
        parts.append(df.agg(F.array(*nulls).alias("r")).select(F.inline("r")))
    for c in spec.unique:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).count()
        extra = F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0).cast("bigint"))
        parts.append(counts.agg(extra.alias("violations")).select(*_rule("unique", c)))
    for c, (parent, key) in spec.references.items():
        if parent in parents and c in df.columns:
            counts = df.where(F.col(c).isNotNull()).groupBy(c).count()
            known = parents[parent].select(F.col(key).alias(c))
            orphans = counts.join(known, c, "left_anti")
            total = F.coalesce(F.sum("count"), F.lit(0).cast("bigint"))
            parts.append(orphans.agg(total.alias("violations")).select(*_rule("reference", c)))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report.select(F.lit(table).alias("table_name"), "rule", "column_name", "violations")


def _rule(rule: str, column: str) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), F.col("violations")]
