"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, exact_dedup, exact_topk, jaccard_join, language_id, lm_scoring, packing, secret_scan,
               token_count, token_files)
from .common import table

#: Folder of the public vocabularies; the default is the installed package's.
TOKENIZERS = os.environ.get("DATEWISE_TOKENIZERS", os.path.dirname(public_tokenizers.path("x")))


def vocabulary_path(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"), words=3, similarity=90)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_index(
        table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = language_id.language_profiles(docs.where(~held_out))
    return language_id.identify(docs, profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_lm_scoring, op2_secret_scan, op3_jaccard_join, op4_exact_dedup, op5_byte_bpe, op6_token_files,
        op7_language_id, op8_packing, op9_exact_topk, op10_token_count)}


def spans_sql(source: str = "documents") -> str:
    """Spans of the base rules as DuckDB SQL: doc_id, text, spans (list of structs by start and kind)."""
    kinds = [
        ("assign", 1, "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
                      "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", 2, "AKIA[A-Z0-9]+", 0, 16),
        ("hex", 3, "[0-9a-f]+", 0, 32)]
    parts = ", ".join(
        f"regexp_extract_all(text, '{p}', 0) AS m{k}, regexp_extract_all(text, '{p}', {g}) AS g{k}, "
        f"string_split_regex(text, '{p}') AS b{k}" for _, k, p, g, _ in kinds)
    lens = ", ".join(f"list_transform(m{k}, lambda x: length(x)) AS lm{k}, list_transform(b{k}, lambda x: length(x)) AS lb{k}, g{k}"
                     for _, k, *_ in kinds)
    spans = " || ".join(
        f"list_filter(list_transform(range(1, len(lm{k}) + 1), lambda i: {{'s': CAST(coalesce(list_sum(lb{k}[1:i]), 0) + "
        f"coalesce(list_sum(lm{k}[1:i - 1]), 0) AS BIGINT), 'k': {k}, 'e': CAST(coalesce(list_sum(lb{k}[1:i]), 0) + "
        f"list_sum(lm{k}[1:i]) AS BIGINT), 'n': '{kind}', 'ok': length(g{k}[i]) >= {least}}}), lambda x: x.ok)"
        for kind, k, _, _, least in kinds)
    return (f"SELECT doc_id, text, list_sort({spans}) AS spans FROM (SELECT doc_id, text, {lens} FROM "
            f"(SELECT doc_id, text, {parts} FROM (SELECT doc_id, coalesce(text, '') AS text FROM {source})))")


def oracle_sql() -> dict:
    dedup = """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents"""
    topk = """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                          CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
                          vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
    secrets = f"""
        WITH f AS ({spans_sql()}),
             j AS (SELECT doc_id, spans AS a, array_to_string(list_transform(spans, lambda x: x.n || ':' || x.s || ':' || x.e), ',') AS spans FROM f)
        SELECT doc_id, CAST(len(list_filter(a, lambda x: x.k = 1)) AS BIGINT) AS n_assign,
               CAST(len(list_filter(a, lambda x: x.k = 2)) AS BIGINT) AS n_access,
               CAST(len(list_filter(a, lambda x: x.k = 3)) AS BIGINT) AS n_hex,
               sha256(spans) AS base_sha256, spans
        FROM j"""
    return {"op2_secret_scan": secrets, "op4_exact_dedup": dedup, "op9_exact_topk": topk}
