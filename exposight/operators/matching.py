"""Known identity terms found in page text, and the risk score built on them.

Texts and terms meet in equi-joins, never pair by pair:

1. A term of at least ``stride + length - 1`` characters, wherever it stands,
   covers one text position that is a multiple of ``stride`` together with the
   ``length`` characters after it. So each text gives one key per ``stride``
   characters and each term ``stride`` keys, one per possible shift.
2. A key hit says where in the text a term might start and how long it would be.
   Terms sharing a key share these (start, length) places, so a key common to
   many terms (a mail provider, a family name) costs no more than its places.
3. The characters at each place are looked up among the terms by equality.

The result is exactly "text contains term", in one pass over the texts at any
number of terms. While the terms' places fit the broadcast threshold (counted,
not guessed), they are broadcast and each key row keeps its piece of text, which
never leaves its task. Beyond that, key rows carry no text: (page, piece number,
place) survive the shuffled join with the places, and only those candidates fetch
their characters, by (page, piece number), from pieces of FETCH_PIECE_CHARS
characters, so the text crosses the network about once. A key row is sent only if
its bit is set in a bit set of the places' keys, which is of a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions import people
from exposight.functions.text import digits_only, phone_token_digits
from exposight.session import materialise

# Terms of at least this length share one stride and key length, set by the shortest
# of them; each shorter length is a group of its own, keyed whole at every position.
LONG_TERM = 6
WIDEST_STRIDE = 8

# Texts are read in overlapping pieces of this many characters. Short pieces keep
# reaching into a piece cheap and bound what one huge page puts into one row.
PIECE_CHARS = 64
# Pieces that candidates fetch on the shuffled path: long, so their overlap is a small share.
FETCH_PIECE_CHARS = 1024
# Bytes of one place row as the broadcast threshold counts them.
PLACE_ROW_BYTES = 48
# Bits of the set that says which keys have a place, 64 to a row: a broadcast of 131,072 rows at most.
KEY_BITS = 1 << 23


def identity_terms(subjects: DataFrame) -> DataFrame:
    """One row per subject and term: ``subject_id, entity_type, entity_value, confidence``.

    Building terms costs far more than reading a subject, and many subjects may stand in one small file: they are spread.
    """
    n_tasks = int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return subjects.repartition(n_tasks, "subject_id").select("subject_id", F.explode(people.identity_terms_of()).alias("term")).select(
        "subject_id", "term.*"
    )


def _with_needles(terms: DataFrame) -> DataFrame:
    phone = F.col("entity_type") == "phone"
    needle = F.when(phone, digits_only(F.col("entity_value"))).otherwise(F.lower("entity_value"))
    named = terms.withColumns(
        {"in_digits": phone, "needle": needle}
    )
    # Every text contains the empty string, so an empty term says nothing.
    return named.where(F.col("needle") != "")


@dataclass(frozen=True)
class _Group:
    """Terms found by the same keys."""

    number: int
    shortest: int
    longest: int

    @property
    def key_length(self) -> int:
        half = min((self.shortest + 1) // 2, WIDEST_STRIDE)
        return min(self.shortest, max(LONG_TERM - 1, half))

    @property
    def stride(self) -> int:
        return min(WIDEST_STRIDE, self.shortest - self.key_length + 1)


def _group_of(needle: Column) -> Column:
    return F.least(F.length(needle), F.lit(LONG_TERM))


def _places(needles: DataFrame, groups: list[_Group]) -> DataFrame:
    """Per key, the distinct places of a term around it: how far before the key it starts, its length."""
    keys = [
        F.struct(F.lit(g.number).alias("group"), F.lit(shift).alias("shift"), F.lit(g.key_length).alias("key_length"))
        for g in groups
        for shift in range(g.stride)
    ]
    keyed = needles.withColumn("k", F.explode(F.array(*keys))).where(F.col("k.group") == F.col("group"))
    return keyed.select(
        "group",
        F.substring("needle", F.col("k.shift") + 1, F.col("k.key_length")).alias("key"),
        F.col("k.shift").alias("shift"),
        F.length("needle").alias("place_length"),
    ).distinct()


def _pieces(pages: DataFrame, page_id: str, text: Column, owned: int, reach: int) -> DataFrame:
    """``page_id, piece_no, piece``: a piece owns the terms starting in its first ``owned`` characters and holds
    ``reach`` characters, enough for the longest one whole."""
    pattern = rf"(?s)(?=(.{{1,{reach}}})).{{1,{owned}}}"
    return pages.select(
        F.col(page_id).alias("page_id"),
        F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("piece_no", "piece"),
    )


def _text_keys(
    pages: DataFrame, page_id: str, text: Column, groups: list[_Group], keep_piece: bool = True
) -> DataFrame:
    """Keys of all texts for the term lengths in use, with the piece they are in, or with its number only."""
    owned = PIECE_CHARS
    reach = owned + max(g.longest for g in groups)
    if not keep_piece:
        reach = owned + max(g.stride + g.key_length for g in groups)
    pieces = _pieces(pages, page_id, text, owned, reach)
    spots = [
        F.struct(F.lit(g.number).alias("group"), F.lit(at).alias("at"), F.lit(g.key_length).alias("key_length"))
        for g in groups
        for at in range(1, owned + g.stride + 1, g.stride)
    ]
    spotted = pieces.select("page_id", "piece_no", "piece", F.explode(F.array(*spots)).alias("spot"))
    return spotted.select(
        "page_id",
        "piece_no",
        *(["piece"] if keep_piece else []),
        F.col("spot.group").alias("group"),
        F.col("spot.at").alias("at"),
        F.substring("piece", F.col("spot.at"), F.col("spot.key_length")).alias("key"),
    )


@dataclass(frozen=True)
class PreparedTerms:
    """Terms as written tables: all of them, their distinct needles, and the places around their keys, by haystack."""

    terms: DataFrame
    needles: DataFrame
    groups: dict[bool, list[_Group]]
    places: dict[bool, DataFrame]
    place_rows: dict[bool, int] | None = None


def prepare(terms: DataFrame) -> PreparedTerms:
    """Written once, for one pass over texts or for many batches of them."""
    columns = ["subject_id", "entity_type", "entity_value", "confidence"]
    terms = materialise(_with_needles(terms.select(columns).distinct()), "identity-terms")
    grouped = terms.select("in_digits", "needle").distinct().withColumn("group", _group_of(F.col("needle")))
    grouped = materialise(grouped, "needles")
    sizes = (
        grouped.groupBy("in_digits", "group")
        .agg(F.min(F.length("needle")).alias("shortest"), F.max(F.length("needle")).alias("longest"))
        .orderBy("in_digits", "group")
        .collect()  # at most two rows per group
    )
    groups: dict[bool, list[_Group]] = {}
    for r in sizes:
        groups.setdefault(r["in_digits"], []).append(_Group(r["group"], r["shortest"], r["longest"]))
    places = {
        in_digits: materialise(_places(grouped.where(F.col("in_digits") == in_digits), own), "term-places")
        for in_digits, own in groups.items()
    }
    return PreparedTerms(terms, grouped, groups, places, {k: v.count() for k, v in places.items()})


def _broadcast_fits(spark, rows: int) -> bool:
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    size = int(threshold.lower().rstrip("b").replace("m", "000000").replace("k", "000")) if threshold else -1
    return size > 0 and rows * PLACE_ROW_BYTES <= size


def needle_hits(
    pages: DataFrame, prepared: PreparedTerms, page_id: str = "page_id", text: str = "extracted_text", phone_mode: str = "page_digits"
) -> DataFrame:
    """Distinct ``(page_id, in_digits, needle)`` with the needle contained in the page."""
    if phone_mode not in ("page_digits", "token"):
        raise ValueError(f"unknown phone mode: {phone_mode}")
    haystack = {
        False: F.lower(F.col(text)),
        True: digits_only(F.col(text)) if phone_mode == "page_digits" else phone_token_digits(F.col(text)),
    }
    found = pages.select(F.col(page_id).alias("page_id"), F.lit(False).alias("in_digits"), F.lit("").alias("needle")).limit(0)
    starts_at = F.col("at") - F.col("shift")
    for in_digits, groups in prepared.groups.items():
        needles = prepared.needles.where(F.col("in_digits") == in_digits).select("needle")
        rows = (prepared.place_rows or {}).get(in_digits)
        if rows is not None and not _broadcast_fits(pages.sparkSession, rows):
            hits = _fetched_hits(pages, page_id, haystack[in_digits], groups, prepared.places[in_digits], needles, rows)
            found = found.unionByName(hits.select("page_id", F.lit(in_digits).alias("in_digits"), "needle"))
            continue
        candidates = (
            _text_keys(pages, page_id, haystack[in_digits], groups)
            .join(prepared.places[in_digits], ["group", "key"])
            .where(starts_at >= 1)
            .select("page_id", F.substring("piece", starts_at, F.col("place_length")).alias("needle"))
        )
        hits = candidates.join(needles, "needle", "left_semi")
        found = found.unionByName(hits.select("page_id", F.lit(in_digits).alias("in_digits"), "needle"))
    return found.distinct()


def _with_places(keys: DataFrame, places: DataFrame) -> DataFrame:
    """The key rows that may have a place: those whose bit is set among the bits of the places' keys."""
    slot = F.pmod(F.xxhash64("group", "key"), F.lit(KEY_BITS))
    word, bit = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    own = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bits = places.groupBy(word.alias("word")).agg(F.bit_or(own).alias("bits"))
    marked = keys.withColumn("word", word).join(F.broadcast(bits), "word")
    return marked.where(F.getbit("bits", bit) == 1).drop("word", "bits")


def _fetched_hits(
    pages: DataFrame, page_id: str, text: Column, groups: list[_Group], places: DataFrame, needles: DataFrame, n_places: int
) -> DataFrame:
    """``page_id, needle``: keys without text meet the places; candidates then fetch their characters."""
    owned = FETCH_PIECE_CHARS
    keys = _text_keys(pages, page_id, text, groups, keep_piece=False)
    if n_places < KEY_BITS:  # else most bits are set
        keys = _with_places(keys, places)
    starts_at = F.col("at") - F.col("shift")
    # Keys are cut from short pieces, as reaching into a piece costs its length; the place is counted from the text's start.
    place = F.col("piece_no") * PIECE_CHARS + starts_at - 1
    candidates = (
        keys.join(places, ["group", "key"])
        .where((starts_at >= 1) & (starts_at <= PIECE_CHARS))
        .select(
            "page_id",
            (place / owned).cast("int").alias("piece_no"),
            (place % owned + 1).alias("start"),
            "place_length",
        )
        .distinct()
    )
    fetch = _pieces(pages, page_id, text, owned, owned + max(g.longest for g in groups) - 1)
    cut = candidates.join(fetch, ["page_id", "piece_no"]).select(
        "page_id", F.substring("piece", F.col("start"), F.col("place_length")).alias("needle")
    )
    return cut.join(needles, "needle", "left_semi")


def findings(
    pages: DataFrame,
    terms: DataFrame | PreparedTerms,
    page_id: str = "page_id",
    text: str = "extracted_text",
    phone_mode: str = "page_digits",
) -> DataFrame:
    """``subject_id, page_id, entity_type, entity_value, confidence``, each once.

    Null text has no findings. A term shared by many subjects is searched once
    and spread to its subjects only after its hits are distinct and written, so
    that the join may be split at a term that many pages hold.
    """
    prepared = terms if isinstance(terms, PreparedTerms) else prepare(terms)
    hits = materialise(needle_hits(pages, prepared, page_id, text, phone_mode), "needle-hits")
    columns = ["subject_id", "entity_type", "entity_value", "confidence"]
    return hits.join(prepared.terms, ["in_digits", "needle"]).select("page_id", *columns)


def risk_points(entity_type: Column, points: dict[str, int] = fv.RISK_POINTS) -> Column:
    score = F.lit(0)
    for kind, value in points.items():
        score = F.when(entity_type == kind, value).otherwise(score)
    return score


def risk_scores(found: DataFrame, points: dict[str, int] = fv.RISK_POINTS) -> DataFrame:
    """Additive score per subject and page over the (distinct) findings."""
    return found.groupBy("page_id", "subject_id").agg(
        F.count("*").alias("n_findings"),
        F.sum(risk_points(F.col("entity_type"), points)).alias("risk_score"),
    )


def page_risk(pages: DataFrame, scores: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Scores for every page; a page without findings has one row with score 0."""
    ids = pages.select(F.col(page_id).alias("page_id"))
    return ids.join(scores, "page_id", "left").select(
        "page_id",
        "subject_id",
        F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"),
        F.coalesce("risk_score", F.lit(0)).cast("bigint").alias("risk_score"),
    )
