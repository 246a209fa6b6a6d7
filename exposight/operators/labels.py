"""Weighted keyword labels of mail, label ids and class scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions.text import bind

# Stands between mail sections; no phrase can reach across it.
_SECTION_BREAK = chr(1)

Keywords = dict[str, dict[str, list[str]]]


def keywords_from(table: DataFrame) -> Keywords:
    """Keyword dictionary from a ``label, tier, phrase`` table; it becomes part of the plan, as the built-in one is."""
    rows = table.select("label", "tier", "phrase").orderBy("label", "tier", "phrase").collect()
    keywords: Keywords = {}
    for r in rows:
        keywords.setdefault(r["label"], {"strong": [], "weak": []})[r["tier"]].append(r["phrase"])
    return keywords


def _occurrences(hay: Column, phrases: list[str]) -> Column:
    """Non-overlapping occurrences of each phrase, summed over the phrases.

    Most phrases are absent, and looking for one costs far less than replacing it.
    """
    needles = F.array(*[F.lit(p.lower()) for p in phrases if p])

    def count(total: Column, phrase: Column) -> Column:
        gone = F.octet_length(hay) - F.octet_length(F.replace(hay, phrase, F.lit("")))
        present = F.contains(hay, phrase)
        return F.when(present, total + (gone / F.octet_length(phrase)).cast("int")).otherwise(total)

    return F.aggregate(needles, F.lit(0), count)


def label_counts(sections: list[Column], keywords: Keywords = fv.KEYWORDS) -> Column:
    """Struct of ``<label>_count``. A phrase counts wherever its letters stand, also inside a
    longer word. A lone weak hit over all sections counts as nothing."""
    hay = F.lower(F.array_join(F.array(*sections), _SECTION_BREAK))

    def counts(text: Column) -> Column:
        fields = []
        for label, tiers in keywords.items():
            strong = _occurrences(text, tiers["strong"]) * fv.KEYWORD_POINTS["strong"]
            weak = _occurrences(text, tiers["weak"]) * fv.KEYWORD_POINTS["weak"]
            total = F.transform(F.array(strong + weak), lambda n: F.when(n > 1, n).otherwise(0))[0]
            fields.append(total.alias(f"{label}_count"))
        return F.struct(*fields)

    return bind(hay, counts)


def label_of(counts: dict[str, Column]) -> Column:
    """Label with the highest count; ``unlabelled`` when all are 0, ``ambiguous`` on a tie."""
    best = F.greatest(*counts.values())
    n_best = sum((c == best).cast("int") for c in counts.values())
    winner = F.coalesce(*[F.when(c == best, F.lit(label)) for label, c in counts.items()])
    return F.when(best == 0, "unlabelled").when(n_best > 1, "ambiguous").otherwise(winner)


def with_labels(
    mails: DataFrame,
    sender: str = "original_sender_string",
    subject: str = "subject",
    body: str = "body",
    keywords: Keywords = fv.KEYWORDS,
) -> DataFrame:
    """Add ``<label>_count`` columns and ``label``."""
    sections = [F.coalesce(F.col(c), F.lit("")) for c in (sender, subject, body)]
    names = [f"{label}_count" for label in keywords]
    counted = mails.drop(*names, "label").withColumn("_counts", label_counts(sections, keywords))
    counted = counted.select("*", "_counts.*").drop("_counts")
    return counted.withColumn("label", label_of({k: F.col(f"{k}_count") for k in keywords}))


def label_id(label: Column, labels: list[str] = fv.LABELS) -> Column:
    """Position of the label in the fixed order; null for any other text."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), label)
    return F.when(at > 0, (at - 1).cast("int"))


def label_at(number: Column, labels: list[str] = fv.LABELS) -> Column:
    """Label at a position of the fixed order; null when out of range."""
    inside = (number >= 0) & (number < len(labels))
    return F.when(inside, F.get(F.array(*[F.lit(x) for x in labels]), number))


def best_label(scores: Column, labels: list[str] = fv.LABELS) -> Column:
    """Label with the highest score; the lowest position wins ties."""
    return label_at((F.array_position(scores, F.array_max(scores)) - 1).cast("int"), labels)
