"""Words to features: vocabulary, TF-IDF, fixed-length id sequences.

The vocabulary is the only thing gathered over the corpus; it is bounded by its
size (10,000 terms). Weights and ids meet the words of the texts by joins; only
the transformer of the classifier holds the vocabulary itself.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions.text import words


# Characters of text whose word counts one task holds: about 200 MB.
DEAL_CHARS = 1 << 22


def _dealt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text`` dealt by key to as many partitions as the texts need, so a task's word counts do not grow with them."""
    chars = docs.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    return docs.select(key, text).repartition(chars // DEAL_CHARS + 1, key)


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, word, n`` per text. Texts are dealt by their key once, and counted where they are."""
    exploded = _dealt(docs, key, text).select(key, F.explode(words(F.col(text))).alias("word"))
    return exploded.groupBy(key, "word").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame, text: str, size: int = fv.VOCABULARY_SIZE) -> DataFrame:
    """``word, n_total, n_docs, place``: the most frequent words (ties by word), ``place`` from 1.

    Each word of a text is sent as one row, flagged at its first use in the text,
    and summed on the map side, so totals and document counts come from one pass.
    """
    tokens = docs.select(words(F.col(text)).alias("tokens"))
    every = F.transform("tokens", lambda w: F.struct(w.alias("word"), F.lit(1).alias("uses"), F.lit(0).alias("docs")))
    once = F.transform(
        F.array_distinct("tokens"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("uses"), F.lit(1).alias("docs"))
    )
    counted = (
        tokens.select(F.inline(F.concat(every, once)))
        .groupBy("word")
        .agg(F.sum("uses").alias("n_total"), F.sum("docs").alias("n_docs"))
    )
    by_use = [F.desc("n_total"), F.asc("word")]
    chosen = counted.orderBy(*by_use).limit(size)
    # One window over ``size`` rows at most.
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by_use)))


def tfidf_model(docs: DataFrame, text: str, size: int = fv.VOCABULARY_SIZE) -> PipelineModel:
    """Fitted transformer from text to unit-length vectors of ``tf * (ln((1+n)/(1+df)) + 1)``."""
    chosen = vocabulary(docs, text, size).collect()  # at most ``size`` rows
    n_docs = docs.count()
    terms = [r["word"] for r in chosen] or [""]
    weights = [math.log((1 + n_docs) / (1 + r["n_docs"])) + 1 for r in chosen] or [0.0]
    pattern = fv.WORD_PATTERN.replace("\\", "\\\\")
    tokenise = SQLTransformer(
        statement=f"SELECT *, regexp_extract_all(lower({text}), '{pattern}', 0) AS tokens FROM __THIS__"
    )
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="term_counts")
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(weights), inputCol="term_counts", outputCol="weighted_counts"
    )
    unit = Normalizer(p=2.0, inputCol="weighted_counts", outputCol="features")
    return PipelineModel([tokenise, counter, scale, unit])


def tfidf(docs: DataFrame, key: str, text: str, size: int = fv.VOCABULARY_SIZE) -> DataFrame:
    """``key, word, weight`` for every vocabulary word of every text; keys are unique.

    The texts dealt for their counts need no other shuffle for the length of a text's vector.
    """
    chosen = vocabulary(docs, text, size)
    n_docs = docs.count()  # reads no column
    rarity = F.log((1 + n_docs) / (1 + F.col("n_docs")).cast("double")) + 1
    weighted = (
        word_counts(docs, key, text)
        .join(chosen.select("word", rarity.alias("_rarity")), "word")
        .select(key, "word", (F.col("n") * F.col("_rarity")).alias("_x"))
    )
    # A window holds the vocabulary words of one text, so no more than ``size`` rows.
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))
    return weighted.select(key, "word", (F.col("_x") / length).alias("weight"))


def encode_fixed(
    docs: DataFrame, key: str, text: str, vocab: DataFrame, length: int = fv.SEQUENCE_LENGTH
) -> DataFrame:
    """``key, input_ids, attention_mask``: word ids cut or padded to ``length``; keys are unique.

    Id 0 is padding, 1 an unknown word, 2 the vocabulary's most frequent word.
    The first ``length`` words of a text meet the vocabulary by a join; they are gathered again per text.
    """
    numbered = vocab.select("word", (F.col("place") + 1).cast("int").alias("_id"))
    cut = docs.select(key, F.slice(words(F.col(text)), 1, length).alias("_tokens"))
    placed = cut.select(key, F.posexplode_outer("_tokens").alias("_pos", "word"))
    known = placed.join(numbered, "word", "left")
    # A text without words has one row, without a place.
    found = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_id", F.lit(1)).alias("_id")))
    ids = known.groupBy(key).agg(F.array_sort(F.collect_list(found)).alias("_found"))
    n_real = F.size("_found")
    padding = F.array_repeat(F.lit(0), F.lit(length) - n_real)
    return ids.select(
        key,
        F.concat(F.transform("_found", lambda x: x["_id"]), padding).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n_real), padding).alias("attention_mask"),
    )
