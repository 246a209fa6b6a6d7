"""Substring deduplication with repeated-phrase automata.

A window is ``window`` consecutive words of one document. Words are removed that lie in a window whose words also
start somewhere in a document with a smaller id. All steps cover all windows:

1. *Anchors.* The anchor of a window is its ``gram``-word phrase with the smallest hash, the leftmost of equals.
   Equal windows have equal anchors at equal places, so only windows around an anchor that two documents share can
   recur. One number per anchor and document is shuffled, about one for 20 words.
2. *Segments.* Documents with shared anchors are cut into segments: an anchor with all windows it stands for. Of
   documents that are equal word for word only the smallest is cut; in the others every window recurs.
3. *Confirmed passages.* Windows of a segment are hashed (128 bits); per window the smallest document, the number of
   its places and a checksum over them are gathered, first within a task. Neighbouring windows with the same places
   are one passage: wherever one of them stands, all do.
4. *Automata.* Passages are dealt into shards by their anchor; each shard compiles an Aho-Corasick automaton over
   its passages' words and streams the segments of its anchors through it. A match is equal word for word.
5. Matches in documents with a larger id than the passage's first one are removed.

Anchors are dealt into shards of about ``SHARD_ROWS`` segments. A frequent anchor has one part per ``PART_ROWS`` of
its occurrences, in steps 3 and 4, and a shard one automaton per ``PASSAGES`` of its passages, so neither all
documents nor all passages of an anchor meet in one task.

Defined cases: a null text has no words; a text shorter than a window loses nothing; windows that recur only inside
one document stay; a null id is no smaller document and loses nothing; rows that share an id are taken for repeats of
one row and lose the same words; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposight.llm.batches import map_values
from exposight.session import materialise

WINDOW, GRAM = 50, 8
PART_ROWS = 1_000  # segments
SHARD_ROWS = 20_000
PASSAGES = 10_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEGMENT = "struct<anchor:bigint,parts:bigint,place:bigint,first:bigint,words:string>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of everything but ASCII white space."""
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 12)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= 1 << 22:
            _powers[base] = held
    return held[:n]


def run_hashes(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash for each run of ``length`` consecutive words, alike for equal runs wherever they stand."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _power(base, n), dtype=np.uint64)])
    value = (sums[length:] - sums[:-length]) * _power(inverse, n - length + 1)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def least_places(values: np.ndarray, length: int) -> np.ndarray:
    """Leftmost place of the smallest of each ``length`` consecutive values."""
    place = np.arange(len(values))
    reach = 1
    while 2 * reach <= length:
        a, b = place[:-reach], place[reach:]
        place = np.where(values[a] <= values[b], a, b)
        reach *= 2
    rest = length - reach
    if rest:
        a, b = place[:-rest], place[rest:]
        place = np.where(values[a] <= values[b], a, b)
    return place


def anchors_of(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window of a text the place of its anchor; the hashes of all phrases."""
    phrases = run_hashes(word_hashes(words), gram, BASES[0])
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), phrases
    return least_places(phrases, window - gram + 1), phrases


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, anchors, same``: the anchors of each text and how often they stand there, and a hash of its words."""

    def work(texts: list) -> list[tuple]:
        found = []
        for text in texts:
            words = words_of(text)
            at, phrases = anchors_of(words, window, gram)
            same = hashlib.md5(b" ".join(words)).digest() if len(at) else None
            names, times = np.unique(phrases[np.unique(at)], return_counts=True)
            found.append((names.view(np.int64), times, same))
        return found

    return map_values(docs, "doc_id", "text", work, "anchors array<bigint>, times array<bigint>, same binary")


def _segments(words: list[bytes], shared: np.ndarray, parts: np.ndarray, window: int, gram: int) -> list[dict]:
    """Each shared anchor of a text with the words of all windows it stands for. ``shared`` is sorted."""
    at, phrases = anchors_of(words, window, gram)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts[1:], len(at)]
    names = phrases[at[starts]].view(np.int64)
    index = np.minimum(np.searchsorted(shared, names), len(shared) - 1)
    found = []
    for k in np.flatnonzero(shared[index] == names).tolist():
        first, end, place = int(starts[k]), int(ends[k]), int(at[starts[k]])
        found.append({
            "anchor": int(names[k]), "parts": int(parts[index[k]]), "place": place, "first": first,
            "words": b" ".join(words[first : end + window - 1]).decode(),
        })
    return found


def _cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, text, shared`` → ``doc_id, segments``."""
    whole = [("anchor", pa.int64()), ("parts", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("words", pa.string())]
    kind = pa.list_(pa.struct(whole))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shared = row.column(2)[0].values
                names, parts = (shared.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.argsort(names)
                segments = _segments(words_of(row.column(1)[0].as_py()), names[order], parts[order], window, gram)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([segments], type=kind)], names=["doc_id", "segments"])

    return docs.mapInArrow(cut, f"doc_id bigint, segments array<{SEGMENT}>")


WINDOWS = (
    "anchor bigint, parts bigint, offset bigint, hash_a bigint, hash_b bigint, doc_id bigint, place bigint, last bigint, "
    "n bigint, places bigint"
)


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """Per window of each part of an anchor: where it is first, the last document, and how often and where it stands.
    What an anchor of one part has in one document only is left out."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "doc_id", "place"])
        # All segments in one sequence of words; only runs within a segment count.
        each = word_hashes(" ".join(pdf["words"]).encode().split())
        sizes = pdf["words"].str.count(" ").to_numpy() + 2 - window
        begins = (pdf["first"] - pdf["place"]).to_numpy()
        ends = np.cumsum(sizes + window - 1)
        inside = np.arange(len(each)) < np.repeat(ends - window + 1, sizes + window - 1)
        at = np.flatnonzero(inside)
        a, b = (run_hashes(each, window, base)[at].view(np.int64) for base in BASES)
        row = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.repeat(begins - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(len(row))
        doc, place = pdf["doc_id"].to_numpy()[row], pdf["place"].to_numpy()[row]
        marks = np.array([xxhash.xxh3_64_intdigest(f"{d}:{p}") for d, p in zip(pdf["doc_id"], pdf["place"])], dtype=np.uint64)
        order = np.lexsort((place, doc, b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
        at = np.flatnonzero(new)
        begin, end = order[at], order[np.r_[at[1:], len(order)] - 1]
        out = pd.DataFrame({
            "anchor": pdf["anchor"].to_numpy()[row[begin]], "parts": pdf["parts"].to_numpy()[row[begin]], "offset": offset[begin],
            "hash_a": a[begin], "hash_b": b[begin], "doc_id": doc[begin], "place": place[begin], "last": doc[end],
            "n": np.diff(np.r_[at, len(order)]), "places": np.bitwise_xor.reduceat(marks[row[order]], at).view(np.int64),
        })
        return out[(out["parts"] > 1) | (out["doc_id"] < out["last"])]

    return segments.groupBy("shard", "part").applyInPandas(gather, WINDOWS)


def _passages(windows: DataFrame) -> DataFrame:
    """Windows in two documents or more, joined with their neighbours of the same places."""
    first = F.min(F.struct("doc_id", "place")).alias("first")
    merged = windows.groupBy("anchor", "parts", "offset", "hash_a", "hash_b").agg(
        first, F.max("last").alias("last"), F.sum("n").alias("n"), F.bit_xor("places").alias("places")
    )
    shared = merged.where(F.col("first.doc_id") < F.col("last"))
    return shared.groupBy("anchor", "parts", "first", "n", "places").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))


def _locate(cells: DataFrame) -> DataFrame:
    """Cells of passages and segments → ``doc_id, low, high``: words of later documents that a passage covers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_passage = pdf["passage"].to_numpy(dtype=bool)
        passages, segments = pdf[is_passage], pdf[~is_passage]
        numbers: dict[bytes, int] = {}
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, doc_id in zip(passages["words"], passages["doc_id"]):
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words.encode().split())
            machine.add_word(key, (len(key), min(int(doc_id), machine.get(key, (0, int(doc_id)))[1])))
        found = []
        if len(passages) and len(segments):
            machine.make_automaton()
            for words, doc_id, first in zip(segments["words"], segments["doc_id"], segments["first"]):
                sequence = tuple(numbers.get(w, 0) for w in words.encode().split())
                for end, (n, smallest) in machine.iter(sequence):
                    if smallest < doc_id:
                        found.append((doc_id, first + end + 1 - n, first + end + 1))
        return pd.DataFrame(found, columns=["doc_id", "low", "high"]).astype("int64").drop_duplicates()

    return cells.groupBy("shard", "part", "slice").applyInPandas(run, "doc_id bigint, low bigint, high bigint")


def removed_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text`` → ``doc_id, low, high`` ranges of words to remove, and the ids whose windows all recur."""
    docs = docs.where("doc_id IS NOT NULL")
    rows = materialise(_anchor_rows(docs, window, gram).where("same IS NOT NULL"), "phrase-anchors")
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = materialise(first.where("first < last").drop("last"), "phrase-copied")
    copies = materialise(
        rows.select("doc_id", "same").join(copied, "same").where("first < doc_id").select("doc_id").distinct(), "phrase-copies"
    )

    shared = rows.select("doc_id", F.explode(F.arrays_zip("anchors", "times")).alias("at")).groupBy(F.col("at.anchors").alias("anchor"))
    shared = shared.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.sum("at.times").alias("n"))
    shared = shared.where("a < z").select("anchor", F.ceil(F.col("n") / part_rows).alias("parts"))
    shared = materialise(shared, "phrase-shared")
    placed = rows.join(copies, "doc_id", "left_anti").select("doc_id", F.explode("anchors").alias("anchor"))
    asked = placed.join(shared, "anchor").groupBy("doc_id")
    asked = asked.agg(F.collect_set(F.struct("anchor", "parts")).alias("shared"))  # of one document

    cut = _cut(docs.join(asked, "doc_id").select("doc_id", "text", "shared"), window, gram)
    segments = materialise(cut.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*"), "phrase-segments")
    shards = max(1, -(-segments.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(shards)).alias("shard")
    dealt = segments.select(shard, F.pmod(F.xxhash64("doc_id", "place"), F.col("parts")).alias("part"), "*")
    passages = materialise(_passages(_windows(dealt, window)), "phrase-passages")

    # Words of a passage, from the segment where it stands first.
    source = segments.select(
        "anchor", F.struct("doc_id", "place").alias("first"), F.col("first").alias("begin"), F.col("place"), "words"
    ).dropDuplicates(["anchor", "first"])
    found = passages.join(source, ["anchor", "first"])
    start = F.col("low") + F.col("place") - F.col("begin")
    run = F.slice(F.split("words", " "), (start + 1).cast("int"), (F.col("high") - F.col("low") + window).cast("int"))
    found = found.select("anchor", "parts", F.col("first.doc_id").alias("doc_id"), F.array_join(run, " ").alias("words"))
    found = materialise(found, "phrase-words")

    slices = found.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / PASSAGES).alias("slices"))
    slices = materialise(slices, "phrase-slices")
    of_slice = F.pmod(F.xxhash64("words"), F.col("slices"))
    texts = found.select(shard, "*").join(slices, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), of_slice.alias("slice"),
        F.lit(True).alias("passage"), "doc_id", F.lit(0).cast("bigint").alias("first"), "words",
    )
    streams = dealt.join(slices, "shard").select(
        "shard", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"),
        F.lit(False).alias("passage"), "doc_id", "first", "words",
    )
    return _locate(texts.unionByName(streams)), copies


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept`` (the words that stay, joined by a space)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ranges, copies = removed_ranges(rows, window, gram, part_rows)
    gone = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))  # of one document
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")))
    gone = gone.unionByName(copies.select("doc_id", whole.alias("ranges")))
    joined = rows.join(gone, "doc_id", "left").select("doc_id", F.struct("text", "ranges").alias("value"))

    def work(values: list) -> list[tuple]:
        found = []
        for value in values:
            words = words_of(value["text"])
            keep = np.ones(len(words), dtype=bool)
            for span in value["ranges"] or ():
                keep[span["low"] : span["high"]] = False
            left = b" ".join(w for w, k in zip(words, keep) if k)
            found.append((len(words), len(words) - int(keep.sum()), left.decode()))
        return found

    return map_values(joined, "doc_id", "value", work, "n_words bigint, n_removed bigint, kept string")
