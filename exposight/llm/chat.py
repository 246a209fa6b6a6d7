"""Chat formatting by quotation linking.

Messages are parsed into passages: paragraphs at one level of quoting, the number of ``>`` signs before a line. A
passage is normalised (white space collapsed, lower-cased) and hashed. A quoted passage is joined to the messages of
its conversation that wrote it themselves, unquoted, at an earlier turn; the latest of these is its origin. A quoted
passage that nobody wrote as a whole is searched by its lines and by its sentences: its origin is the latest message
that wrote the longest run of them, within one passage. A message replies to the origin of its shallowest quoted
passages, whole ones before runs, the latest one if they have several. Conversations then come
in reply order, without quotes: a message follows the one it replies to, by the root of its replies, its depth below
the root, and its turn.

Replies are followed by pointer doubling, with one join per round over (conversation, turn), so chains of any length
take a logarithmic number of rounds. The longest run is found by bisection: whether a run of some length was written
earlier is one more join on the hashes of all runs of that length, for all passages at once. No conversation is
gathered into one task or one row.

Defined cases: a null text has no passage and an empty body; a message without a quote, or whose quotes nobody wrote
earlier, replies to nothing and is its own root; a null role is written as ``unknown``; null conversation ids or
turns never link; repeated rows get one row each and share their links; an empty table gives no rows; other columns
are left out. A line that introduces a quote (it ends in ``wrote:`` and stands right before one) is left out.
With ``keep_unlinked`` a quoted passage stays in the body, with the line that introduces it, unless it was written
earlier as a whole or as one run of lines or sentences; without it, no quote stays.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposight.llm.batches import map_values
from exposight.session import materialise

QUOTED = re.compile(r"^((?:[ \t]?>)+)[ \t]?")
INTRODUCES = re.compile(r"(?i)\bwrote:\s*$")
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
STRETCH = 256  # turns
PASSAGES = "body string, passages array<struct<level:int,hash:string>>, quoting string"
PIECES = "pieces array<struct<level:int,hash:string,kind:string,units:array<string>>>"
RUNS = "runs array<struct<length:int,run:string>>"
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D5DEECE66D5DEECE66D


def quote_level(line: str) -> tuple[int, str]:
    """Number of quote signs before a line, and the line without them."""
    found = QUOTED.match(line)
    return (found[1].count(">"), line[found.end() :]) if found else (0, line)


def normalised(passage: str) -> str:
    return " ".join(passage.split()).lower()


def digest(passage: str) -> str:
    return hashlib.md5(passage.encode()).hexdigest()


def _split(text: str | None) -> tuple[list[tuple[int | None, str]], list[tuple[int, list[str]]]]:
    """Every line with the number of the quoted passage it goes with (None: the message's own), and the passages."""
    raw = (text or "").split("\n")
    lines = [quote_level(line) for line in raw]
    owners: list[int | None] = [None] * len(raw)
    passages: list[tuple[int, list[str]]] = []
    waiting: list[int] = []  # lines before a quoted passage that go with it
    quote = None
    for i, (level, line) in enumerate(lines):
        introduces = False
        if level == 0:
            quote = None
            after = next((x for x, rest in lines[i + 1 : i + 3] if x or rest.strip()), 0)
            introduces = bool(after and INTRODUCES.search(line))
        if introduces:
            waiting.append(i)
            owners[i] = -1
            continue
        if not line.strip():
            passages.append((level, []))
        elif passages and passages[-1][0] == level:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        if level:
            if line.strip():
                quote = len(passages) - 1
                for j in waiting:
                    owners[j] = quote
                waiting = []
            elif quote is None:
                waiting.append(i)
            owners[i] = -1 if quote is None else quote
    return list(zip(owners, raw)), passages


def _keys(passages: list[tuple[int, list[str]]]) -> list[tuple[int, str] | None]:
    found = [(level, normalised(" ".join(part))) for level, part in passages]
    return [(level, digest(p)) if p else None for level, p in found]


def _body(lines: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def parse(text: str | None) -> tuple[str, list[dict]]:
    """Body without quotes, and the passages with their level and hash."""
    lines, passages = _split(text)
    hashes = [{"level": key[0], "hash": key[1]} for key in _keys(passages) if key]
    return _body([line for owner, line in lines if owner is None]), hashes


def body_with(text: str, linked: list[dict] | None) -> str:
    """Body with the quoted passages that are not among the ``linked`` ones."""
    lines, passages = _split(text)
    keys = _keys(passages)
    gone = {(p["level"], p["hash"]) for p in linked or ()}
    return _body([line for owner, line in lines if owner is None or owner >= 0 and keys[owner] not in gone])


def pieces(text: str | None) -> list[dict]:
    """Hashes of the lines and of the sentences of every passage."""
    _, passages = _split(text)
    found = []
    for (_, part), key in zip(passages, _keys(passages)):
        if key:
            for kind, units in (("line", part), ("sentence", SENTENCE_END.split(" ".join(part)))):
                hashes = [digest(u) for u in map(normalised, units) if u]
                found.append({"level": key[0], "hash": key[1], "kind": kind, "units": hashes})
    return found


def runs(units: list[str], lengths: list[int]) -> list[dict]:
    """Hashes of all runs of the given lengths, from hashes of the beginnings."""
    upto = [0]
    for unit in units:
        upto.append((upto[-1] * BASE + int(unit, 16)) % PRIME)
    found = set()
    for length in lengths:
        shift = pow(BASE, length, PRIME)
        found |= {(length, (upto[i + length] - upto[i] * shift) % PRIME) for i in range(len(units) - length + 1)}
    return [{"length": length, "run": f"{run:x}"} for length, run in found]


PASSAGE = ["conv_id", "turn", "level", "hash"]


def _latest(own: DataFrame, quoted: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Rows of ``quoted`` (``key, turn, names``) with ``origin``, the latest earlier turn of ``own`` (``key, turn``)."""
    own = own.distinct().join(quoted.select(*key).distinct(), key, "left_semi")
    quoted = quoted.distinct().select(*key, "turn", F.struct(*names).alias("name"))
    stretch = F.floor(F.col("turn") / STRETCH).alias("stretch")
    both = own.select(*key, "turn", stretch, F.col("turn").alias("origin"), F.lit(None).cast(quoted.schema["name"].dataType).alias("name")).unionByName(
        quoted.select(*key, "turn", stretch, F.lit(None).cast(own.schema["turn"].dataType).alias("origin"), "name")
    )
    # The latest origin before a turn: within a stretch of turns, else the last one of the stretches before.
    within = Window.partitionBy(*key, "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy(*key, "stretch").agg(F.max("origin").alias("top"))
    tops = tops.select(*key, "stretch", F.max("top").over(before).alias("carried"))
    found = both.withColumn("latest", F.max("origin").over(within)).where("name IS NOT NULL").join(tops, [*key, "stretch"])
    return found.select(*key, "turn", "name.*", F.coalesce("latest", "carried").alias("origin")).where("origin IS NOT NULL")


def _longest_runs(rows: DataFrame, missed: DataFrame) -> DataFrame:
    """``missed`` passages with ``origin`` and ``whole``: who wrote their longest run, and if it is all of the passage."""
    talks = missed.select("conv_id").distinct()
    rows = rows.join(talks, F.col("id.conv_id") == talks["conv_id"], "left_semi")
    found = map_values(rows, "id", "text", lambda texts: [(pieces(t),) for t in texts], PIECES, id_name="id")
    found = found.select("id.conv_id", "id.turn", F.explode("pieces").alias("p")).select("conv_id", "turn", "p.*")
    found = materialise(found.where("turn IS NOT NULL"), "chat-pieces")
    own = found.where("level = 0").select("conv_id", "turn", "kind", "units").distinct()
    state = found.where("level > 0").join(missed, PASSAGE, "left_semi").distinct()
    name = [*PASSAGE, "kind", "piece"]
    state = state.withColumn("piece", F.md5(F.array_join("units", " ")))
    state = state.withColumns({"length": F.lit(0), "origin": F.lit(None).cast(found.schema["turn"].dataType)})
    state = materialise(state, "chat-runs")

    def all_runs(asked: DataFrame, names: list[str]) -> DataFrame:
        packed = asked.select(F.struct(*names).alias("id"), F.struct("units", "lengths").alias("asked"))
        every = map_values(packed, "id", "asked", lambda xs: [(runs(x["units"], x["lengths"]),) for x in xs], RUNS, id_name="id")
        return every.select("id.*", F.explode("runs").alias("r")).select(*names, "r.*")

    longest = state.agg(F.max(F.size("units"))).first()[0]
    # Bisection: the length grows by falling powers of two while a run of that length was written earlier.
    for power in reversed(range((longest or 0).bit_length())):
        tried = state.withColumn("tried", F.col("length") + (1 << power)).where(F.col("tried") <= F.size("units"))
        quoted = all_runs(tried.withColumn("lengths", F.array("tried")), name)
        lengths = tried.groupBy("conv_id", "kind").agg(F.collect_set("tried").alias("lengths"))
        written = all_runs(own.join(lengths, ["conv_id", "kind"]), ["conv_id", "turn", "kind"])
        hits = _latest(written, quoted, ["conv_id", "kind", "length", "run"], ["level", "hash", "piece"])
        hits = hits.groupBy(*name).agg(F.max("length").alias("reached"), F.max("origin").alias("by"))
        state = state.join(hits, name, "left").select(
            *name, "units", F.coalesce("reached", "length").alias("length"), F.coalesce("by", "origin").alias("origin")
        )
        state = materialise(state, "chat-runs")
    share = F.col("length") / F.size("units")
    best = state.where("length > 0").groupBy(*PASSAGE).agg(F.max(F.struct(share.alias("share"), "origin")).alias("best"))
    return best.select(*PASSAGE, "best.origin", (F.col("best.share") == 1).alias("whole"))


def _origins(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, level, hash, origin, run, whole`` for each quoted passage with an origin."""
    passages = parsed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.hash")
    quoted = passages.where("level > 0").distinct()
    own = passages.where("level = 0").select("conv_id", "hash", "turn")
    found = _latest(own, quoted, ["conv_id", "hash"], ["level"]).select(*PASSAGE, "origin", F.lit(False).alias("run"), F.lit(True).alias("whole"))
    found = materialise(found, "chat-origins")
    missed = quoted.where("conv_id IS NOT NULL AND turn IS NOT NULL").join(found, PASSAGE, "left_anti")
    missed = materialise(missed, "chat-missed")
    if missed.isEmpty():
        return found
    longest = _longest_runs(rows, missed).select(*PASSAGE, "origin", F.lit(True).alias("run"), "whole")
    return materialise(found.unionByName(longest), "chat-all-origins")


def _keep_unlinked(parsed: DataFrame, origins: DataFrame) -> DataFrame:
    """``parsed`` with the quotes in the body that nobody wrote before."""
    linked = origins.where("whole").groupBy("conv_id", "turn").agg(F.collect_set(F.struct("level", "hash")).alias("linked"))
    quoting = parsed.where("quoting IS NOT NULL").join(linked, ["conv_id", "turn"], "left")
    packed = quoting.select(F.struct("conv_id", "turn", "role").alias("id"), F.struct("quoting", "linked").alias("asked"))
    bodies = map_values(packed, "id", "asked", lambda xs: [(body_with(x["quoting"], x["linked"]),) for x in xs], "body string", id_name="id")
    return parsed.where("quoting IS NULL").select("conv_id", "turn", "role", "body").unionByName(bodies.select("id.*", "body"))


def link(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", keep_unlinked: bool = False) -> DataFrame:
    """One row per row of ``messages``: ``conv_id, turn, role, body, reply_to, root, depth, message``."""
    rows = messages.select(
        F.struct(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role")).alias("id"),
        F.col(text_col).alias("text"),
    )

    def parse_all(texts: list) -> list[tuple]:
        found = [(t, *parse(t)) for t in texts]
        return [(body, passages, t if any(p["level"] for p in passages) else None) for t, body, passages in found]

    parsed = map_values(rows, "id", "text", parse_all, PASSAGES, id_name="id")
    parsed = materialise(parsed.select("id.*", "body", "passages", "quoting"), "chat-parsed")
    origins = _origins(rows, parsed)
    nearest = F.min(F.struct("level", "run", (-F.col("origin")).alias("back")))
    replies = origins.groupBy("conv_id", "turn").agg((-nearest["back"]).alias("parent"))
    replies = materialise(replies, "chat-replies")

    # Pointer doubling: ``up`` is an ancestor ``depth`` replies above, the root once it has no parent itself.
    chains = replies.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        above = chains.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        longer = chains.join(above, ["conv_id", "up"], "left")
        longer = longer.select(
            "conv_id", "turn", F.coalesce("next", "up").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"),
        )
        longer = materialise(longer, "chat-chains")
        chains = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break

    if keep_unlinked:
        parsed = _keep_unlinked(parsed, origins)
    known = replies.join(chains, ["conv_id", "turn"])
    joined = parsed.join(known, ["conv_id", "turn"], "left")
    message = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n<|end|>\n"))
    return joined.select(
        "conv_id", "turn", "role", "body", F.col("parent").alias("reply_to"), F.coalesce("up", "turn").alias("root"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), message.alias("message"),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """The messages sorted for writing: conversation by conversation, replies behind what they reply to."""
    return linked.orderBy("conv_id", "root", "depth", "turn")
