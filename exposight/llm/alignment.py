"""Cross-tokenizer alignment: which token of one vocabulary covers which token of another, counted corpus-wide.

Each text is encoded by both tokenizers inside Arrow batches (tokenizer A sees ' ' + text, B adds its own leading
space). Byte offsets where an A token and a B token both end cut a text into groups; all A x B token occurrences of a
group are linked. A document's links become pair-document records (a, b, m), m being how many of its links join a to
b, so a document adds each id pair once.

Counting is the external spill count of these records, done by Spark's own sort-based shuffle: the records of a block
of texts (up to ``USES_AT_ONCE``) are combined into one record per id pair before the exchange, dealt into hash
partitions of (a, b), spilled as compressed sorted runs and merged, which gives each pair's number of documents; a
second aggregation, A-side major, gives each A id's largest count. The counts go back to the blocks by one join, and
each block adds up its texts' contributions from them. So only a block's distinct pairs are shuffled; what a text
needs to find its counts again (the places of its pairs in its block, and m) stays with the text. Copies of one text
(same SHA-256 of the text, null as empty) are aligned once and weigh by their number; their rows get its results by
one join. No list of a group or an id is gathered in one place.

Tokenizer A cuts before a space between two characters that are no white space, so the ids of a text are those of its
words; words are remembered, and the new words of a slice are encoded together.

Defined cases: a null, empty or whitespace-only text, or one whose A or B token bytes do not join to ' ' + text, has
no tokens: zeros and an empty groups string; a null id is an id like any other; repeated rows are separate documents
(each counts); extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposight.session import materialise

# A text's row holds its key, and per id pair its place among the block's pairs and its links (uint32, little-endian);
# a pair's row holds its place, ids and number of documents in the block.
ALIGNED = (
    "block long, key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, "
    "links binary, place int, a int, b int, docs long"
)
SCORED = "key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
TEXTS_AT_ONCE = 256
CHARS_AT_ONCE = 1 << 20  # a slice of texts holds at most this many characters, or one text
LINKS_AT_ONCE = 1 << 21  # links held at once, or those of one text
USES_AT_ONCE = 1 << 20  # a block of texts ends with the slice that reaches this many pair-document records
TEXTS_A_BLOCK = 1 << 14
CACHED_WORDS = 1 << 18
CACHED_BYTES = 64
WORD_BORDER = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
PLAIN_ENDS = re.compile(r"[\w!-~](?:.*[\w!-~])?", re.DOTALL)


def byte_level_table() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the other bytes for 256 + their order."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    extra = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(extra)}


@functools.cache
def tokenizers(a_path: str, b_path: str):
    import sentencepiece
    from tokenizers import Tokenizer

    # A task has its core; the library's own thread pool would add threads, and their memory, to every worker.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True  # their strings in a text are plain text
    table = byte_level_table()
    a_bytes = [bytes(table[c] for c in a.id_to_token(i)) for i in range(a.get_vocab_size())]
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_byte(i):
            b_bytes.append(bytes([int(piece[3:5], 16)]))
        elif b.is_control(i) or b.is_unknown(i):
            b_bytes.append(b"")
        else:
            b_bytes.append(piece.replace("▁", " ").encode())
    return a, a_bytes, b, b_bytes


class Words:
    """Tokenizer A over texts: ids of ' ' + text as uint32 bytes, from the words of the text.

    The byte-level pre-tokeniser always cuts before a single space between two characters that are no white space, and
    no alternative of its pattern looks across that place, so the words between such places are encoded on their own.
    """

    def __init__(self, a, a_table: Table):
        self.a, self.sizes = a, a_table.sizes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [WORD_BORDER.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        kept = {w: self.older[w] for w in new if w in self.older}
        self.known.update(kept)
        fresh = self._fresh([w for w in new if w not in kept])
        self.known.update(fresh)
        found = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for word in fresh:
            if len(word) > CACHED_BYTES:
                del self.known[word]
        if len(self.known) > CACHED_WORDS:
            self.older, self.known = self.known, {}
        return found

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of ' ' + word. Words with plain ends are encoded as one text, each cut out by its bytes."""
        plain = [w for w in words if PLAIN_ENDS.fullmatch(w)]
        found: dict[str, bytes] = {}
        if plain:
            ids = np.array(self.a.encode(" " + " ".join(plain), add_special_tokens=False).ids, dtype="<u4")
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(w.encode()) + 1 for w in plain])
            at = np.searchsorted(ends, wanted)
            if at[-1] == len(ids) - 1 and np.array_equal(ends[at], wanted):
                raw, upto = ids.tobytes(), ((at + 1) * 4).tolist()
                found = {w: raw[i:j] for w, i, j in zip(plain, [0, *upto], upto)}
        rest = [w for w in words if w not in found]
        encoded = self.a.encode_batch([" " + w for w in rest], add_special_tokens=False)
        return found | {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(rest, encoded)}


@functools.cache
def encoders(a_path: str, b_path: str) -> tuple[Words, Table, object, Table]:
    """Those of this process: tasks that a worker runs one after the other share what A's words have learned."""
    a, a_bytes, b, b_bytes = tokenizers(a_path, b_path)
    a_table = Table(a_bytes)
    return Words(a, a_table), a_table, b, Table(b_bytes)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(","))])


def _lengths(table: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, table), dtype=np.int64, count=len(table))


class Table:
    """The bytes of each token, laid out to be gathered for many tokens at once."""

    def __init__(self, entries: list[bytes]):
        self.sizes = _lengths(entries)
        self.flat = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at]


@functools.cache
def _decimals(n: int) -> Table:
    return Table([b"%d," % i for i in range(n)])


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive entries adding up to at most ``most``, or one entry."""
    reach = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = reach[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(reach, before + most, side="right")))
        yield start, end
        start = end


class Slice:
    """A slice of texts aligned by whole-array steps: per text its numbers and digest, and its distinct linked id pairs
    (``a * size of B + b``) with how many links each has, text after text in rising order of pairs."""

    def __init__(self, texts: list[str], a_ids: list[bytes], b_ids: list[list[int]], a_table: Table, b_table: Table):
        n = len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.digests = [""] * n
        self.uses = np.zeros(n, np.int64)
        self.pairs, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = [(" " + t).encode() if t else b"" for t in texts]
        lengths = _lengths(whole)
        ai = np.frombuffer(b"".join(a_ids), dtype="<u4").astype(np.int64)
        bi = np.fromiter(chain.from_iterable(b_ids), dtype=np.int64)
        n_a = np.array([len(x) // 4 for x in a_ids], dtype=np.int64)
        n_b = np.array([len(x) for x in b_ids], dtype=np.int64)
        fits = (lengths > 0) & self._same(ai, n_a, a_table, whole, lengths) & self._same(bi, n_b, b_table, whole, lengths)
        self.at = np.flatnonzero(fits)  # the texts that have tokens
        if not len(self.at):
            return
        if len(self.at) < n:
            ai, bi = ai[np.repeat(fits, n_a)], bi[np.repeat(fits, n_b)]
        self.n_a[fits], self.n_b[fits] = n_a[fits], n_b[fits]
        self._align(ai, bi, np.cumsum(n_a[fits]), np.cumsum(lengths[fits]), a_table.sizes, b_table.sizes)

    @staticmethod
    def _same(ids: np.ndarray, counts: np.ndarray, table: Table, whole: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Per text: do the bytes of its tokens join to it?"""
        upto = np.cumsum(counts)
        reach = np.concatenate([[0], np.cumsum(table.sizes[ids])])
        same = reach[upto] - reach[upto - counts] == lengths
        if not same.all():
            ids = ids[np.repeat(same, counts)]
        wanted = np.frombuffer(b"".join(w for w, s in zip(whole, same.tolist()) if s), dtype=np.uint8)
        wrong = np.flatnonzero(table.joined(ids) != wanted)
        held = np.flatnonzero(same)
        same[held[np.searchsorted(np.cumsum(lengths[held]), wrong, side="right")]] = False
        return same

    def _align(self, ai, bi, upto_a, text_ends, a_sizes, b_sizes) -> None:
        # The texts one after the other are one long text: each ends where an A and a B token end.
        ends_a, ends_b = np.cumsum(a_sizes[ai]), np.cumsum(b_sizes[bi])
        ended = np.zeros(text_ends[-1] + 1, dtype=bool)
        ended[ends_b] = True
        cut_a = ended[ends_a]
        ended[ends_b] = False
        ended[ends_a] = True
        cut_b = ended[ends_b]
        ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        groups_upto = np.searchsorted(ends_a[cut_a], text_ends) + 1
        first_group = np.concatenate([[0], groups_upto[:-1]])
        self.n_groups[self.at] = groups_upto - first_group
        links = np.add.reduceat(na * nb, first_group)
        self.n_links[self.at] = links
        after_a, after_b = np.cumsum(na), np.cumsum(nb)
        self._digest(ai, bi, ga, gb, after_a, after_b, nb, groups_upto, max(len(a_sizes), len(b_sizes)))

        n_b = len(b_sizes)
        space = len(a_sizes) * n_b
        first_a = np.concatenate([[0], upto_a[:-1]])
        text_of_a = np.repeat(np.arange(len(self.at)), upto_a - first_a)
        pairs, counts = [], []
        for start, end in _runs(links, LINKS_AT_ONCE):
            mine = slice(first_a[start], upto_a[end - 1])
            # Each A token with every B token of its group.
            g = ga[mine]
            per_a = nb[g]
            offsets = np.repeat(np.cumsum(per_a) - per_a - (after_b - nb)[g], per_a)
            b_at = np.arange(len(offsets)) - offsets
            keys = np.repeat(text_of_a[mine] * space + ai[mine] * n_b, per_a) + bi[b_at]
            distinct, m = np.unique(keys, return_counts=True)
            pairs.append(distinct)
            counts.append(m)
        keys, self.links = np.concatenate(pairs), np.concatenate(counts)
        text, self.pairs = np.divmod(keys, space)
        self.uses[self.at] = np.bincount(text, minlength=len(self.at))

    def _digest(self, ai, bi, ga, gb, after_a, after_b, nb, groups_upto, vocabulary: int) -> None:
        """a1,a2|b1;a3|b2,b3 : per group its A ids, then its B ids; ids joined by commas, then those at borders replaced."""
        ordered = np.empty(len(ai) + len(bi), np.int64)
        ordered[np.arange(len(ai)) + (after_b - nb)[ga]] = ai
        ordered[np.arange(len(bi)) + after_a[gb]] = bi
        decimals = _decimals(vocabulary)
        shown = decimals.joined(ordered)
        ends = np.cumsum(decimals.sizes[ordered])
        shown[ends[after_a + after_b - nb - 1] - 1] = ord("|")
        group_ends = ends[after_a + after_b - 1]
        shown[group_ends - 1] = ord(";")
        text_ends = group_ends[groups_upto - 1].tolist()
        for i, start, end in zip(self.at.tolist(), [0, *text_ends], text_ends):
            self.digests[i] = hashlib.sha256(shown[start : end - 1]).hexdigest()


def _block(
    number: int, keys: list[pa.Array], copies: list[np.ndarray], slices: list[Slice], b_size: int
) -> Iterator[pa.RecordBatch]:
    """Rows of the texts of ``slices``, and of their distinct pairs."""
    schema = _arrow(ALIGNED)
    uses, weight = np.concatenate([s.uses for s in slices]), np.concatenate(copies)
    pairs, places = np.unique(np.concatenate([s.pairs for s in slices]), return_inverse=True)
    links = np.concatenate([s.links for s in slices])
    # Exact: sums of whole numbers far below 2^53.
    docs = np.bincount(places, weights=np.repeat(weight, uses), minlength=len(pairs)).astype(np.int64)
    raw_places, raw_links = places.astype("<u4").tobytes(), links.astype("<u4").tobytes()
    upto = (np.cumsum(uses) * 4).tolist()

    def cut(raw: bytes) -> pa.Array:
        return pa.array([raw[i:j] for i, j in zip([0, *upto], upto)], pa.binary())

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    numbers = {name: np.concatenate([getattr(s, name) for s in slices]) for name in ("n_a", "n_b", "n_groups", "n_links")}
    yield rows(
        len(uses), block=np.full(len(uses), number), key=pa.concat_arrays(keys), places=cut(raw_places), links=cut(raw_links),
        groups_sha256=list(chain.from_iterable(s.digests for s in slices)), **numbers,
    )
    a, b = np.divmod(pairs, b_size)
    yield rows(len(pairs), block=np.full(len(pairs), number), place=np.arange(len(pairs)), a=a, b=b, docs=docs)


def _slices(texts: pa.Array, most_rows: int, most_chars: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of consecutive texts with at most ``most_rows`` rows and ``most_chars`` characters, or one text."""
    lengths = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(lengths):
        reach = np.cumsum(lengths[start : start + most_rows])
        size = max(1, int(np.searchsorted(reach, most_chars, side="right")))
        yield start, size
        start += size


def _per_batch(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, a_table, b, b_table = encoders(a_path, b_path)
        first = TaskContext.get().partitionId() << 32
        blocks, keys, copies, slices, texts_held, uses_held = 0, [], [], [], 0, 0
        for whole in batches:
            for start, size in _slices(whole.column(2), TEXTS_AT_ONCE, CHARS_AT_ONCE):
                batch = whole.slice(start, size)
                texts = [t if t else "" for t in batch.column(2).to_pylist()]
                aligned = Slice(texts, words.encode(texts), b.encode(texts, num_threads=1), a_table, b_table)
                keys.append(batch.column(0))
                copies.append(batch.column(1).to_numpy())
                slices.append(aligned)
                texts_held += size
                uses_held += len(aligned.pairs)
                if uses_held >= USES_AT_ONCE or texts_held >= TEXTS_A_BLOCK:
                    yield from _block(first + blocks, keys, copies, slices, len(b_table.sizes))
                    blocks, keys, copies, slices, texts_held, uses_held = blocks + 1, [], [], [], 0, 0
        if slices:
            yield from _block(first + blocks, keys, copies, slices, len(b_table.sizes))

    return run


def _contributions(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of a block's texts from the corpus-wide counts of its pairs."""
    docs, top = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    place = pairs["place"].to_numpy()
    docs[place] = pairs["docs"].to_numpy()
    top[place] = pairs["top"].to_numpy()
    raw = texts["places"].to_pylist()
    upto = np.cumsum([len(x) // 4 for x in raw])
    places = np.frombuffer(b"".join(raw), dtype="<u4")
    links = np.frombuffer(b"".join(texts["links"].to_pylist()), dtype="<u4").astype(np.int64)

    def per_text(values: np.ndarray) -> np.ndarray:
        reach = np.concatenate([[0], np.cumsum(values)])[upto]
        return np.diff(reach, prepend=0)

    found = {"n_best": per_text(links * top[places]), "count_sum": per_text(links * docs[places])}
    schema = _arrow(SCORED)
    return pa.table([pa.array(found[f.name]) if f.name in found else texts[f.name] for f in schema], schema=schema)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best``: links whose id pair's document count is the largest of its A id; ``count_sum``: the document counts
    of its links, added up.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    keyed = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "text")
    # Copies of one text are aligned once and count with their number (partial counts before the shuffle).
    texts = keyed.groupBy("key").agg(F.first("text", ignorenulls=True).alias("text"), F.count(F.lit(1)).alias("copies"))
    aligned = materialise(
        texts.select("key", "copies", "text").mapInArrow(_per_batch(a_path, b_path), ALIGNED), "align-texts"
    )
    records = aligned.where(F.col("key").isNull()).select("block", "place", "a", "b", "docs")
    counts = records.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    best = counts.groupBy("a").agg(F.max("docs").alias("best"))
    top = (F.col("docs") == F.col("best")).cast("long")
    scored = materialise(counts.join(best, "a").select("a", "b", "docs", top.alias("top")), "align-counts")
    back = records.drop("docs").join(scored, ["a", "b"]).select(F.col("block").alias("of_block"), "place", "docs", "top")
    per_text = aligned.where(F.col("key").isNotNull()).drop("place", "a", "b", "docs")
    found = per_text.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_contributions, SCORED)
    joined = keyed.select("doc_id", "key").join(found, "key")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
