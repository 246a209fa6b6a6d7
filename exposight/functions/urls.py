"""URL columns: canonical form, domain, resolution against a base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposight.functions.text import bind

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_BEFORE_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?"


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, _BEFORE_PATH + r"([^?#]*)", 1)


def domain(url: Column) -> Column:
    """Network location as written: port, user info and letter case are kept."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def canonical(url: Column) -> Column:
    """``scheme://netloc/path``: no query, no fragment, no ``;params`` on the last segment."""
    path = F.regexp_replace(_path(url), r";[^/]*$", "")
    return F.concat(_scheme(url), F.lit("://"), domain(url), path)


def _drop_empty_tail(url: Column) -> Column:
    """``p?`` and ``p#`` carry an empty query or fragment, which is not kept."""
    no_query = F.regexp_replace(url, r"^([^?#]*)\?(?=#|$)", "$1")
    trimmed = F.regexp_replace(no_query, r"^([^#]*)#$", "$1")
    return F.when(url.endswith("#") | F.contains(url, F.lit("?")), trimmed).otherwise(url)


def _fold_dots(path: Column, relative: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; empty inner segments go only when ``relative``."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    inner_kept = F.filter(parts, lambda s, i: (i == 0) | (i == last) | (s != ""))
    segments = F.when(relative, inner_kept).otherwise(parts)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    has_dots = path.rlike(r"(?:^|/)\.{1,2}(?:/|$)|//")
    joined = F.when(F.size(folded) > 0, F.concat(F.array_join(folded, "/"), trailing)).otherwise("/")
    return F.when(has_dots, joined).otherwise(path)


def base_parts(base: Column) -> Column:
    """The parts of a page's address that its links are resolved against, worked out once."""
    path = _path(base)
    return F.struct(
        base.alias("whole"),
        _scheme(base).alias("scheme"),
        F.concat(_scheme(base), F.lit("://"), domain(base)).alias("origin"),
        path.alias("path"),
        F.regexp_replace(path, r"[^/]*$", "").alias("folder"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]+)?", 1).alias("query"),
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` as found on the page ``base``."""
    return bind(base_parts(base), lambda parts: resolve_from(parts, href))


def resolve_from(base: Column, href: Column) -> Column:
    def resolved(ref: Column) -> Column:
        ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
        tail = F.substring(ref, F.length(ref_path) + 1, F.length(ref))
        absolute = ref.startswith("/")
        merged = F.when(absolute, ref_path).otherwise(F.concat(base["folder"], ref_path))
        folded = _fold_dots(merged, ~absolute)
        rooted = F.when(folded.startswith("/"), folded).otherwise(F.concat(F.lit("/"), folded))
        same_scheme = (_scheme(ref) == base["scheme"]) & ref.rlike(_AUTHORITY)
        after_scheme = F.regexp_replace(ref, _SCHEME, "")
        return (
            F.when(ref == "", base["whole"])
            .when(ref.startswith("//"), _drop_empty_tail(F.concat(base["scheme"], F.lit(":"), ref)))
            .when(ref.startswith("?"), _drop_empty_tail(F.concat(base["origin"], base["path"], ref)))
            .when(ref.startswith("#"), _drop_empty_tail(F.concat(base["origin"], base["path"], base["query"], ref)))
            .when(
                ~absolute & ref.rlike(_SCHEME),
                F.when(
                    same_scheme, _drop_empty_tail(F.concat(base["scheme"], F.lit(":"), after_scheme))
                ).otherwise(href),
            )
            .otherwise(_drop_empty_tail(F.concat(base["origin"], rooted, tail)))
        )

    return bind(F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", ""), resolved)
