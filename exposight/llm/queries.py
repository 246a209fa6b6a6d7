"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposight.llm import (
    alignment, byte_bpe, chat, embedding_dedup, exact_dedup, language_id, mixing, phrase_dedup, piece_bpe, simhash,
    token_files, url_filter, whitening,
)

URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]
MIX_WEIGHTS = (5, 2, 1)
END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def learned_languages(docs: DataFrame) -> language_id.Model:
    """Trained on the labelled documents outside the held-out fold."""
    return language_id.train(docs.where(~F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))))


def byte_encoder() -> byte_bpe.Encoder:
    return byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, learned_languages(docs))
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = token_files.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), encode, encode.vocabulary, END_ID)
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = byte_encoder()
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), encoder)
    return bpe_digests(ids, encoder)


def bpe_digests(encoded: DataFrame, encoder: byte_bpe.Encoder) -> DataFrame:
    """``doc_id, ids`` → numbers and digests of the ids and of what they decode to."""
    row = F.struct("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    decoded = byte_bpe.decode(encoded.select(row.alias("doc_id"), "ids"), encoder)
    return decoded.select("doc_id.*", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"), keep_unlinked=True)


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"), keep="largest")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), a, b)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_mixing, op3_embedding_dedup, op4_url_filter, op5_token_files, op6_byte_bpe, op7_simhash,
        op8_chat_formatting, op9_phrase_dedup, op10_exact_dedup, op11_whitening,
        op12_piece_bpe, op13_alignment,
    )
}

ORACLES = {
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))) AS shuffle FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank,
         ([5, 2, 1])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM sources
), levelled AS (
  SELECT *, source_size * 3 / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size * 3 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), reached AS (
  SELECT level FROM levelled WHERE level <= ratio ORDER BY ratio, rank LIMIT 1
), targets AS (
  SELECT source, source_size, rank, coalesce(least(CAST(source_size * 3 AS DOUBLE), (SELECT level FROM reached) * weight), 0.0) AS target FROM levelled
), queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank,
         CAST(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.shuffle, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS position
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT q.*, c.copy, (c.copy * q.source_size + q.position) / q.target AS finish
  FROM queued q, (SELECT unnest([0, 1, 2]) AS copy) c WHERE q.size > 0
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, position, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies
), taken AS (
  SELECT rank, position, sum(size) AS taken FROM cut WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY rank, position
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(CASE WHEN q.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON t.rank = q.rank AND t.position = q.position
""",
    "op3_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS least FROM v
  UNION
  SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node
), found AS (
  SELECT node, min(least) AS component_id FROM reach GROUP BY node
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, f.component_id, v.vec_id = f.component_id AS kept
FROM v JOIN found f ON f.node = v.vec_id
""",
    "op4_url_filter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts
), rules(h, p, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT s.page_id, s.host, s.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.h || r.p DESC) AS nth
  FROM split s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.nth = 1
""",
    "op9_phrase_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM w, unnest(generate_series(1, len(words) - 49)) AS g(i)
), first AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
  SELECT w.doc_id, list_distinct(flatten(list(generate_series(w.i, w.i + 49)))) AS places
  FROM windows w JOIN first f ON f.h = w.h AND f.least < w.doc_id GROUP BY w.doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE
         list_transform(list_filter(list_zip(words, generate_series(1, len(words))), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id
""",
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256 FROM t JOIN g ON g.body = t.body
""",
}
