"""Token ids in binary files: fixed-width bit packing with block offsets.

Documents are sorted by range on their id; each range becomes one file. In a file every id takes the minimum number
of bits that the vocabulary needs, little end first:

    blocks     of BLOCK ids each, packed; a block starts on a byte
    index      int64 per document: its id; uint8: 1 if it has one; int64: ids before it in this file; then the total
    offsets    int64 per block: its first byte; then the end of the last one
    footer     6 int64: bits, BLOCK, ids, documents, place of the index, place of the offsets; then MAGIC

A reader finds any span of ids from the footer, the offsets and the blocks that hold it, and unpacks a block with
array operations. Files get a name of their own per attempt, and the manifest, written by Spark, lists those of the
attempts that counted: a lost executor or a second attempt leaves at most a file that nobody reads. Files are opened
through pyarrow's file systems, by the address of the folder.

Defined cases: a null text is empty and has the end id alone; null ids come first; repeated rows are written one by
one; an empty table makes no file and gives no rows; other columns are left out.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposight.session import materialise, work_folder

MAGIC = b"IDPACK01"
BLOCK = 1 << 16
TEXTS_AT_ONCE = 256
MANIFEST = "part int, path string, docs bigint, ids bigint"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """uint32 ids → ``bits`` bits each, little end first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), dtype=np.uint8)
    full[:, :bits] = flat
    return np.packbits(full.ravel(), bitorder="little").view("<u4")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """One file, written block by block."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.held: list[np.ndarray] = []
        self.n_held = self.ids = self.place = 0
        self.offsets, self.docs, self.known, self.starts = [0], [], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.known.append(doc_id is not None)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 8 * BLOCK:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if whole else len(ids) // BLOCK * BLOCK
        for k in range(0, end, BLOCK):
            data = pack(ids[k : min(k + BLOCK, end)], self.bits)
            self.sink.write(data)
            self.place += len(data)
            self.offsets.append(self.place)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole=True)
        parts = [np.array(self.docs, "<i8"), np.array(self.known, np.uint8), np.array(self.starts, "<i8")]
        index = self.place
        for part in parts:
            self.sink.write(part.tobytes())
        offsets = index + sum(p.nbytes for p in parts)
        self.sink.write(np.array(self.offsets, "<i8").tobytes())
        self.sink.write(np.array([self.bits, BLOCK, self.ids, len(self.docs), index, offsets], "<i8").tobytes() + MAGIC)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        footer = self._read(size - 48 - len(MAGIC), 48 + len(MAGIC))
        if footer[48:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.ids, docs, index, offsets = map(int, np.frombuffer(footer[:48], "<i8"))
        data = self._read(index, offsets - index)
        self.docs = np.frombuffer(data, "<i8", count=docs)
        self.known = np.frombuffer(data, np.uint8, count=docs, offset=8 * docs).astype(bool)
        self.starts = np.frombuffer(data, "<i8", count=docs + 1, offset=9 * docs)
        self.offsets = np.frombuffer(self._read(offsets, size - 48 - len(MAGIC) - offsets), "<i8")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def span(self, start: int, end: int) -> np.ndarray:
        """ids ``start`` to ``end`` (excluded) of the file."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        data = self._read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        found = []
        for b in range(first, last + 1):
            n = min(self.block, self.ids - b * self.block)
            part = data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]]
            found.append(unpack(part, self.bits, n))
        return np.concatenate(found)[start - first * self.block : end - first * self.block]

    def documents(self, docs_at_once: int = TEXTS_AT_ONCE) -> Iterator[tuple[list, list[int], list[np.ndarray]]]:
        """Document ids, starts in the file and ids, a few documents at a time."""
        for k in range(0, len(self.docs), docs_at_once):
            starts = self.starts[k : k + docs_at_once + 1]
            ids = self.span(int(starts[0]), int(starts[-1]))
            names = [int(d) if known else None for d, known in zip(self.docs[k : k + docs_at_once], self.known[k : k + docs_at_once])]
            yield names, starts[:-1].tolist(), np.split(ids, starts[1:-1] - starts[0])


def write_token_files(
    docs: DataFrame, encode: Callable[[list[str]], list[bytes]], vocabulary: int, end_id: int,
    id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
) -> DataFrame:
    """Write the ids of all texts in ascending order of their documents; returns the manifest of the files.

    ``encode`` returns the ids of each text as little-endian uint32 bytes."""
    folder = folder or work_folder(docs.sparkSession, "token-files")
    bits = width(vocabulary)
    end = np.array([end_id], "<u4")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                if writer is None:
                    part = batch.column(0)[0].as_py()
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                    store, place = open_folder(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(place)
                    writer = Writer(sink, bits)
                for doc_id, data in zip(batch.column(1).to_pylist(), encode(batch.column(2).to_pylist())):
                    writer.add(doc_id, np.concatenate([np.frombuffer(data, "<u4"), end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [path], "docs": [len(writer.docs)], "ids": [writer.ids]}
            )

    return materialise(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files. ``start`` counts over all files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = open_folder(row["path"])
                with store.open_input_file(place) as source:
                    for docs, starts, ids in Reader(source).documents():
                        columns = [docs, [row["base"] + s for s in starts], [len(i) for i in ids], [i.tobytes() for i in ids]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, READ)], schema=READ)

    return files.repartition(n, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


# What the fast way of WordCache relies on, as tokenizers files write it.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Letters, digits and signs of Latin-1 that composing leaves alone and lower-casing maps one to one;
# no apostrophe (contractions) and no "<" (special tokens).
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\\[-`{-~]+")
# Byte-level models write a byte that is no visible Latin-1 character as the next one from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLING = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _VISIBLE)}
_PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class _Pieces(dict):
    """Lower-cased pieces of plain words and their ids."""

    def __init__(self, merge: Callable[[str], list], longest: int):
        super().__init__()
        self.merge, self.longest = merge, longest

    def __missing__(self, piece: str) -> bytes:
        ids = _uint32([token.id for token in self.merge(piece.encode().decode("latin-1").translate(SPELLING))])
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids


class WordCache(dict):
    """A tokenizers file as an ``encode`` function. The model drops white space and never joins over it, so ids of
    a text are the ids of its words in order. A word is encoded when it is met first, and remembered while there is
    room. Plain words go to the library's BPE model piece by piece, as its pre-tokeniser would cut them, if the file
    asks for that normaliser and pre-tokeniser; all others go through the whole library."""

    LIMIT = 1_000_000
    PIECES = 600_000
    LONG = 24  # bytes; longer words are not kept

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self._model = None

    def __reduce__(self):
        return word_cache, (self.path,)

    @property
    def model(self):
        if self._model is None:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.path)
            spec = json.loads(self._model.to_str())
            self._plain = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
            self._pieces = _Pieces(self._model.model.tokenize, self.LONG)
        return self._model

    @property
    def vocabulary(self) -> int:
        return self.model.get_vocab_size()

    def __missing__(self, word: bytes) -> bytes:
        model, text = self.model, word.decode()
        if self._plain and _PLAIN.fullmatch(text):
            ids = b"".join(map(self._pieces.__getitem__, _PIECE.findall(text.lower())))
        else:
            ids = _uint32(model.encode(text, add_special_tokens=False).ids)
        if len(word) <= self.LONG:
            self[word] = ids
        return ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        found, _ = [], self.model
        for text in texts:
            if len(self) > self.LIMIT:
                self.clear()
            if len(self._pieces) > self.PIECES:
                self._pieces.clear()
            found.append(b"".join(map(self.__getitem__, text.encode().split())))
        return found


@functools.cache
def word_cache(path: str) -> WordCache:
    """The one of this process: tasks that a worker runs one after the other share what it has learned."""
    return WordCache(path)


def _uint32(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)
