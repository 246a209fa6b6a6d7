"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, everything but letters becomes a word border, and its letter n-grams (borders included at
either end) are hashed into buckets. The mean of the buckets' vectors goes through a linear softmax. Vectors and
weights are trained together by stochastic gradient descent on the cross-entropy, on at most ``PER_LANGUAGE``
labelled documents per language; the rows are chosen by a hash of their id, and features are counted in tasks, so
the driver holds at most 2^BUCKET_BITS counts for each. A quarter of the sample is kept from training: it sets the
temperature of the softmax (calibration) and the score below which a text is rejected, the smallest one at which the
accepted rest is wrong in at most ``MAX_ERROR`` of cases, and at least a little above chance (``ABOVE_CHANCE``).

Prediction sees the whole text and nothing else. As the model is linear after the mean, bucket vectors are
multiplied by the weights once, and a text costs one table lookup per n-gram.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; null labels and null texts
are not learned from; ties go to the language first in code-point order; an empty table gives no rows; no labelled
rows give ``und`` for every row; repeated rows get one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposight.llm.batches import TEXTS_AT_ONCE, map_values

PER_LANGUAGE = 500  # bound of the training sample, documents per language
BUCKET_BITS = 15
DIMENSIONS = 16
STEPS, BATCH, RATE = 800, 16, 2.0
LENGTHS = (2, 3)
MAX_ERROR = 0.01
ABOVE_CHANCE = 1.25  # a best language less likely than this times 1 / languages is no answer
UNKNOWN = "und"
CHARS_AT_ONCE = 1 << 20

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a whole text, a piece at a time; nothing if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    longest = max(LENGTHS)
    for start in range(0, max(len(codes), 1), CHARS_AT_ONCE):
        # Pieces overlap by one n-gram less a character; each n-gram belongs to the piece it starts in.
        piece = codes[max(start - 1, 0) : start + CHARS_AT_ONCE + longest]
        letter = _is_letter()[piece]
        if not letter.any():
            continue
        signs = np.where(letter, piece, 0).astype(np.uint64)
        first, last = start == 0, start + CHARS_AT_ONCE >= len(codes)
        border = np.zeros(1, dtype=np.uint64)
        signs = np.concatenate([border if first else signs[:0], signs, border if last else signs[:0]])
        found = []
        for n in LENGTHS:
            size = len(signs) - n + 1
            if size <= 0:
                continue
            value = np.zeros(size, dtype=np.uint64)
            whole = np.ones(size, dtype=bool)
            for k in range(n):
                value = value * np.uint64(0x100000001B3) + signs[k : k + size] + np.uint64(n)
                if 0 < k < n - 1:
                    whole &= signs[k : k + size] != 0
            if n == 2:
                whole &= (signs[:size] != 0) | (signs[1 : 1 + size] != 0)
            if not last:
                whole[CHARS_AT_ONCE:] = False
            value ^= value >> np.uint64(29)
            value = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
            found.append(value[whole].astype(np.int64))
        yield np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    """``table``: per bucket the score of each language (vectors times weights)."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(len(self.languages)), 0
        for found in subwords(text):
            total += self.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, rejected or not."""
        logits = self.logits(text) if self.languages else None
        if logits is None:
            return UNKNOWN, 0.0, True
        p = softmax(logits[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_sample(labelled: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> list:
    """At most ``per_language`` rows of each language as (lang, rank, buckets, counts), chosen and ranked by hash."""
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    # Thin out first, so that no task ranks all rows of a language.
    order = F.xxhash64("id")
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4 * per_language / n))])
    thin = rows.where(F.pmod(order, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, F.xxhash64("text")))
    chosen = thin.withColumn("rank", rank).where(F.col("rank") <= per_language)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = [sum((np.bincount(x, minlength=1 << BUCKET_BITS) for x in subwords(t)), np.zeros(1 << BUCKET_BITS, dtype=np.int64)) for t in batch["text"]]
            found = [np.flatnonzero(c) for c in total]
            yield pd.DataFrame({
                "lang": batch["lang"], "rank": batch["rank"],
                "buckets": [f.astype(np.int32) for f in found], "counts": [c[f] for c, f in zip(total, found)],
            })

    sample = chosen.select("lang", "rank", "text").mapInPandas(counted, "lang string, rank int, buckets array<int>, counts array<bigint>")
    frame = sample.toPandas().sort_values(["rank", "lang"])
    return [(r.lang, r.rank, np.asarray(r.buckets), np.asarray(r.counts, dtype=float)) for r in frame.itertuples() if len(r.buckets)]


def train(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", seed: int = 7,
) -> Model:
    return fit(training_sample(labelled, per_language, id_col, text_col, lang_col), seed)


def fit(sample: list, seed: int = 7) -> Model:
    languages = sorted({x[0] for x in sample})
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    held = [x for x in sample if x[1] % 4 == 0]
    learned = [x for x in sample if x[1] % 4 != 0]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    number = {lang: i for i, lang in enumerate(languages)}
    queue: list[int] = []
    for done in range(STEPS):
        rate = RATE * (1 - done / STEPS)
        while len(queue) < min(BATCH, len(learned)):
            queue += rng.permutation(len(learned)).tolist()
        batch, queue = [learned[i] for i in queue[:BATCH]], queue[BATCH:]
        buckets = np.concatenate([b for _, _, b, _ in batch])
        share = np.concatenate([c / c.sum() for _, _, _, c in batch])
        starts = np.cumsum([0, *[len(b) for _, _, b, _ in batch[:-1]]])
        mean = np.add.reduceat(vectors[buckets] * share[:, None], starts, axis=0)
        error = softmax(mean @ weights + bias)
        error[np.arange(len(batch)), [number[lang] for lang, *_ in batch]] -= 1
        error /= len(batch)
        down = error @ weights.T
        weights -= rate * mean.T @ error
        bias -= rate * error.sum(axis=0)
        # Scaled so that a step moves a text's mean as far as if it were one bucket, however long the text.
        scale = 1 / np.add.reduceat(share * share, starts)
        owner = np.repeat(np.arange(len(batch)), [len(b) for _, _, b, _ in batch])
        np.add.at(vectors, buckets, -rate * (share * scale[owner])[:, None] * down[owner])
    model = Model(languages, (vectors @ weights).astype(np.float32), bias)
    return calibrate(model, held or learned)


def calibrate(model: Model, held: list) -> Model:
    """Temperature by the likelihood of the held-out rows, threshold by their errors."""
    logits = np.array([(model.table[b] * c[:, None]).sum(axis=0) / c.sum() + model.bias for _, _, b, c in held])
    truth = np.array([model.languages.index(lang) for lang, _, _, _ in held])
    at = np.arange(len(held))
    grid = np.geomspace(0.25, 8, 50)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[at, truth] + 1e-12).mean()))
    p = softmax(logits / model.temperature)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != truth
    order = np.argsort(-score, kind="stable")
    errors = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= MAX_ERROR)
    accepted = score[order[fine[-1]]] if len(fine) else 1.0
    if len(fine) == len(order) or (len(fine) and fine[-1] == len(order) - 1):
        accepted = 0.0  # no held-out row has to be rejected
    model.threshold = float(max(min(0.5, ABOVE_CHANCE / len(model.languages)), accepted))
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score, rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BUCKET_BITS rows of one number per language
    schema = "lang_pred string, score double, rejected boolean"
    return map_values(docs, id_col, text_col, lambda texts: [shared.value.predict(t) for t in texts], schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject; all columns kept. Rows are judged in Arrow slices of
    TEXTS_AT_ONCE, in the one worker of the task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                fits = [not shared.value.predict(t)[2] for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(fits, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


