"""Columns over one subject row: names, identity terms, search queries, confidence.

A subject row has ``first_name, last_name, email`` and the string arrays
``middle_names, usernames, locations, numbers``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions.text import digits_only

_NO_STRINGS = "array<string>"


def string_list(json_text: Column) -> Column:
    """A JSON array of strings; ``[]`` when absent or malformed."""
    return F.coalesce(F.from_json(json_text, _NO_STRINGS), F.array().cast(_NO_STRINGS))


def _full_name(first: Column, middles: Column, last: Column) -> Column:
    # Null parts are skipped, so a missing name never becomes a literal word.
    return F.array_join(F.concat(F.array(first), middles, F.array(last)), " ")


def _plain_name(first: Column, last: Column) -> Column:
    return F.array(F.array_join(F.array(first, last), " "))


def search_names(first: Column, middles: Column, last: Column) -> Column:
    """First and last name around every ordered subset of the middle names, sorted."""
    n_subsets = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size(middles))
    masks = F.sequence(F.lit(1).cast("bigint"), n_subsets - 1)

    def named(mask: Column) -> Column:
        chosen = F.filter(middles, lambda _, i: _shift(mask, i).bitwiseAND(F.lit(1)) == 1)
        return _full_name(first, chosen, last)

    # sequence(1, 0) would count down, hence the guard.
    with_middles = F.when(F.size(middles) > 0, F.transform(masks, named)).otherwise(
        F.array().cast(_NO_STRINGS)
    )
    return _usable(F.array_sort(F.array_distinct(F.concat(_plain_name(first, last), with_middles))))


def _shift(mask: Column, places: Column) -> Column:
    return F.call_function("shiftright", mask, places)


def matching_names(first: Column, middles: Column, last: Column) -> Column:
    """Names looked for in page text: plain, all middle names, each single middle name."""
    all_middles = F.array(_full_name(first, middles, last))
    singles = F.transform(middles, lambda m: _full_name(first, F.array(m), last))
    names = F.concat(_plain_name(first, last), all_middles, singles)
    return _usable(F.array_distinct(names))


def _usable(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def identity_terms_of() -> Column:
    """``array<struct<entity_type, entity_value, confidence>>`` of one subject row."""
    c = F.col

    def typed(kind: str, values: Column) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(
                F.lit(kind).alias("entity_type"),
                v.alias("entity_value"),
                F.lit(fv.TERM_CONFIDENCE[kind]).alias("confidence"),
            ),
        )

    # A number without digits would be found on every page, so it is no term.
    numbers = F.filter(_usable(c("numbers")), lambda n: digits_only(n) != "")
    return F.array_distinct(
        F.concat(
            typed("email", _usable(F.array(c("email")))),
            typed("username", _usable(c("usernames"))),
            typed("name", matching_names(c("first_name"), c("middle_names"), c("last_name"))),
            typed("location", _usable(c("locations"))),
            typed("phone", numbers),
        )
    )


def _quoted(value: Column, suffix: str = "") -> Column:
    return F.concat(F.lit('"'), value, F.lit('"' + suffix))


def _worded(value: Column, words: list[str]) -> Column:
    return F.array(_quoted(value), *[_quoted(value, f" {w}") for w in words])


def queries_of() -> Column:
    """All search queries of one subject row in search order, first occurrence kept."""
    c = F.col
    email, numbers = _usable(F.array(c("email"))), _usable(c("numbers"))
    usernames, locations = _usable(c("usernames")), _usable(c("locations"))
    sites = [f"site:{s}" for s in fv.SOCIAL_SITES + fv.DEV_SITES + fv.LEAK_SITES]
    names = search_names(c("first_name"), c("middle_names"), c("last_name"))

    def pair(name: Column) -> Column:
        others = F.concat(locations, usernames, email, numbers)
        return F.transform(others, lambda o: F.concat(_quoted(name), F.lit(" "), _quoted(o)))

    families = F.concat(
        F.flatten(F.transform(email, lambda e: _worded(e, fv.EMAIL_QUERY_WORDS))),
        F.flatten(F.transform(numbers, lambda n: _worded(n, fv.PHONE_QUERY_WORDS))),
        F.flatten(F.transform(usernames, lambda u: _worded(u, sites))),
        F.flatten(F.transform(names, pair)),
    )
    return F.array_distinct(families)


def _mentions_name(lowered: Column, first: Column, middles: Column, last: Column) -> Column:
    """Does the text hold first and last name around any ordered subset of the middle names?

    One pattern in which every middle name may be missing stands for all the
    subsets. Without first and last name any middle name will do.
    """

    def plain(value: Column) -> Column:
        return F.regexp_replace(F.lower(value), r"([\\^$.|?*+()\[\]{}])", r"\\$1")

    def optional(before: str, after: str) -> Column:
        parts = F.filter(middles, lambda m: m.isNotNull())
        return F.array_join(F.transform(parts, lambda m: F.concat(F.lit(f"(?:{before}"), plain(m), F.lit(f"{after})?"))), "")

    with_last = F.concat(F.coalesce(F.concat(plain(first), F.lit(" ")), F.lit("")), optional("", " "), plain(last))
    pattern = F.coalesce(with_last, F.concat(plain(first), optional(" ", "")))
    any_middle = F.exists(_usable(middles), lambda m: F.contains(lowered, F.lower(m)))
    return F.when(F.concat(F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))) == "", any_middle).otherwise(
        F.rlike(lowered, pattern)
    )


def query_confidence(query: Column) -> Column:
    """How surely ``query`` is about the subject of the row; the first rule that fits wins."""
    c = F.col
    lowered = F.lower(query)

    def mentions(values: Column) -> Column:
        return F.exists(_usable(values), lambda v: F.contains(lowered, F.lower(v)))

    named = _mentions_name(lowered, c("first_name"), c("middle_names"), c("last_name"))
    conf = fv.QUERY_CONFIDENCE
    return (
        F.when(mentions(F.array(c("email"))), conf["email"])
        .when(mentions(c("numbers")), conf["phone"])
        .when(mentions(c("usernames")), conf["username"])
        .when(named & mentions(c("locations")), conf["name_and_location"])
        .when(named, conf["name"])
        .otherwise(0.0)
    )
