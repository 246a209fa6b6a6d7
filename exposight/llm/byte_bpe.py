"""Byte-level BPE: pre-tokenise overlapping chunks in parallel, stitch them where their borders agree, encode the pieces.

A text longer than ``CHUNK`` characters is cut into chunks that overlap. Each chunk is pre-tokenised from its first
character, which may lie inside a piece; as the pattern looks ahead one character and never back, two scans that
share one piece border agree on all later ones. The first border that a chunk and its predecessor both find in their
overlap is where the text is cut. Chunks without such a border (one piece longer than the overlap) are joined to
their predecessor and scanned as one. A shorter text is a chunk by itself and needs no stitching.

Pieces are encoded one by one by tiktoken's merge ranks, and those a worker has met are remembered. ids are
little-endian unsigned 32-bit integers in a binary column. Decoding joins the bytes of the ids.

Defined cases: a null text is empty and has no ids; empty texts have no ids; null ids of documents and repeated rows
get one row each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposight.llm.batches import map_values
from exposight.session import materialise

CHUNK = 1 << 16
OVERLAP = 1 << 10


class Encoder:
    """Merge ranks and a pattern, by the path of a rank file."""

    LIMIT = 200_000
    LONG = 64  # characters; longer pieces are not kept

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        self._pieces: dict[str, bytes] = {}
        self._model = self._match = self._bytes = None

    def __reduce__(self):
        return encoder_of, (self.path, self.pattern)

    def _load(self) -> None:
        if self._model is None:
            with open(self.path, "rb") as source:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}
            self._model = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            self._match = regex.compile(self.pattern)
            self._bytes = {rank: token for token, rank in ranks.items()}

    def borders(self, text: str) -> list[int]:
        """Ends of the pieces of ``text``, in order."""
        self._load()
        return [m.end() for m in self._match.finditer(text)]

    def encode(self, text: str, start: int = 0, end: int | None = None) -> bytes:
        """ids of the pieces from ``start``, a border, to ``end``, another; what follows ``end`` is only looked at."""
        self._load()
        if start == 0 and end is None:
            pieces = self._match.findall(text)
        else:
            pieces = []
            for m in self._match.finditer(text, start):
                if end is not None and m.start() >= end:
                    break
                pieces.append(m[0])
        known = self._pieces
        if len(known) > self.LIMIT:
            known.clear()
        found = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self._model._encode_single_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= self.LONG:
                    known[piece] = ids
            found.append(ids)
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        self._load()
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def encoder_of(path: str, pattern: str) -> Encoder:
    """The one of this process: tasks that a worker runs one after the other share the pieces it has met."""
    return Encoder(path, pattern)


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``key, text`` → ``key, i, last, text``: characters from i * chunk, and the overlap and one more behind."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                n = max(1, -(-len(text) // chunk))
                for i in range(n):
                    part = text[i * chunk : (i + 1) * chunk + overlap + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([i], pa.int64()), pa.array([i == n - 1]), pa.array([part])],
                        names=["key", "i", "last", "text"],
                    )

    return texts.select("key", "text").mapInArrow(cut, "key string, i bigint, last boolean, text string")


def _long_texts(texts: DataFrame, encoder: Encoder, chunk: int, overlap: int) -> DataFrame:
    """Distinct ``key, text`` → ``key, ids``."""
    chunks = materialise(_chunks(texts, chunk, overlap).repartition("key", "i"), "bpe-chunks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, text = row["i"] * chunk, row["text"]
                ends = [0, *encoder.borders(text)]
                if not row["last"]:
                    ends = [e for e in ends if e < len(text)]  # the last piece may go on behind the chunk
                head = [base + e for e in ends if e <= overlap]
                tail = [base + e for e in ends if chunk <= e <= chunk + overlap]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]]), pa.array([row["i"]], pa.int64()),
                     pa.array([head], pa.list_(pa.int64())), pa.array([tail], pa.list_(pa.int64()))],
                    names=["key", "i", "head", "tail"],
                )

    borders = chunks.select("key", "i", "last", "text").mapInArrow(scan, "key string, i bigint, head array<bigint>, tail array<bigint>")
    borders = materialise(borders, "bpe-borders")
    tails = borders.select("key", (F.col("i") + 1).alias("i"), F.col("tail").alias("before"))
    starts = borders.join(tails, ["key", "i"], "left").select(
        "key", "i", F.when(F.col("i") == 0, F.lit(0).cast("bigint")).otherwise(F.array_min(F.array_intersect("before", "head"))).alias("start")
    )
    # A run: a chunk that begins at an agreed border, and those behind it that don't. Rows are a few numbers per chunk.
    ordered = Window.partitionBy("key").orderBy("i")
    runs = starts.withColumn("run", F.sum(F.col("start").isNotNull().cast("bigint")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    later = ordered.rowsBetween(1, Window.unboundedFollowing)
    runs = runs.withColumn("end", F.first("start", ignorenulls=True).over(later))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        texts = pdf["text"].tolist()
        whole = "".join([*(t[:chunk] for t in texts[:-1]), texts[-1]])
        base = int(pdf["i"].iloc[0]) * chunk
        start, end = pdf["start"].iloc[0], pdf["end"].iloc[-1]
        ids = encoder.encode(whole, int(start) - base, None if pd.isna(end) else int(end) - base)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "run": [pdf["run"].iloc[0]], "ids": [ids]})

    pieces = chunks.drop("last").join(runs, ["key", "i"]).groupBy("key", "run").applyInPandas(encode, "key string, run bigint, ids binary")
    joined = lambda pdf: pd.DataFrame({"key": [pdf["key"].iloc[0]], "ids": [b"".join(pdf.sort_values("run")["ids"])]})
    return pieces.groupBy("key").applyInPandas(joined, "key string, ids binary")


def encode(
    docs: DataFrame, encoder: Encoder, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, ids``."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be within a chunk")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    short = map_values(rows.where(~is_long), "doc_id", "text", lambda texts: [(encoder.encode(t),) for t in texts], "ids binary")
    keyed = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    found = _long_texts(keyed.select("key", "text").distinct(), encoder, chunk, overlap)
    return short.unionByName(keyed.select("doc_id", "key").join(found, "key").select("doc_id", "ids"))


def decode(encoded: DataFrame, encoder: Encoder, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: ``doc_id, decoded``, the raw bytes."""
    return map_values(encoded, id_col, ids_col, lambda values: [(encoder.decode(v or b""),) for v in values], "decoded binary")


def encode_digests(
    docs: DataFrame, encoder: Encoder, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row, as ``encode`` then ``decode`` give them.

    A text of at most ``chunk`` characters is encoded, decoded and digested in one worker; longer ones go through the
    chunked encoding and are decoded after it.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk

    def digests(ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = map_values(rows.where(~is_long), "doc_id", "text", lambda texts: [digests(encoder.encode(t)) for t in texts], schema)
    long_ids = encode(rows.where(is_long), encoder, chunk=chunk, overlap=overlap)
    long = map_values(long_ids, "doc_id", "ids", lambda values: [digests(v or b"") for v in values], schema)
    return short.unionByName(long)
