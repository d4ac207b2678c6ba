"""The corpus pipeline: five stages from raw documents to packed batches.

Part of the training-data subpackage. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datewise.llm import exact_dedup, jaccard_join, language_id, packing, secret_scan
from datewise.llm.common import Scratch, table


def _restore(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set `lang` to the predicted language; documents without any letter go.

    Profiles are learned from every document of the stage that has a language.
    If none has one, nothing can be learned and `lang` stays null; documents
    without a letter still go.
    """
    profiles = language_id.language_profiles(docs)
    found = language_id.identify(docs, profiles, keep=("text", "source", "n_chars"))
    if not profiles:
        return _restore(docs.where(F.col("text").rlike(r"\p{L}")))
    return _restore(found.where(F.col("lang_pred") != language_id.UNDETERMINED).withColumnRenamed("lang_pred", "lang"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; of repeated rows of one id and text, one.

    Null and empty texts are equal. A null id is the smallest. Rows of one id
    with other texts are judged by themselves.
    """
    work, text_hash = Scratch(spark, "exact-copies"), F.sha2(F.coalesce("text", F.lit("")), 256)
    found = work.put(exact_dedup.exact_dedup(docs).where("group_size > 1"), "found")
    gone = found.where(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("text_hash")).distinct()
    kept = _without(docs.withColumn("text_hash", text_hash), work.put(gone, "gone"))
    again = work.put(found.where("kept").groupBy("doc_id", F.col("text_sha256").alias("text_hash")).agg(
        F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    if again.isEmpty():
        return _restore(kept)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = kept.join(again, _same(kept, again), "left_semi").groupBy("doc_id", "text_hash").agg(
        F.min("text").alias("text"), F.min(F.struct(*rest)).alias("rest"))
    return _restore(_without(kept, again)).unionByName(_restore(one.select("doc_id", "text", "rest.*")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle sets that are 0.8 similar or more, the smallest id stays.

    Null ids go before any other; if the smallest id has several texts of the
    component, or all ids are null, the least text hash stays. Documents without
    words all stay.
    """
    work = Scratch(spark, "near-copies")
    found = work.put(jaccard_join.similar_components(docs), "found").where("component IS NOT NULL")
    smallest = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ties = smallest.groupBy("component").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where(
        "least <> most").select("component", "least")
    lost = smallest.join(ties, "component").where("text_hash <> least")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").unionByName(
        lost.select("doc_id", "text_hash")).distinct()
    return _restore(_without(docs.withColumn("text_hash", F.xxhash64("text")), work.put(gone, "gone")))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id and text hash are not in the written table `gone`."""
    held = gone.agg(F.count("*"), F.max(F.octet_length(F.col("text_hash").cast("string")))).first()
    if held[0] * (48 + (held[1] or 0)) <= 64 << 20:
        gone = F.broadcast(gone)
    return docs.join(gone, _same(docs, gone), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; every document stays and n_chars follows the text, null for null."""
    known = docs.withColumn("has_text", F.col("text").isNotNull())
    masked = secret_scan.redact(secret_scan.secret_scan(known, keep=("lang", "source", "has_text")))
    text = F.when(F.col("has_text"), F.col("text"))
    return _restore(masked.withColumns({"text": text, "n_chars": F.length(text).cast("long")}))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign every document a slot of a batch."""
    return packing.pack(docs, keep=("lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mask_secrets", mask_secrets),
    ("packing", pack_batches),
]

#: Language ID, the similarity join and the dynamic program of packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each over what its predecessor wrote."""
    docs, work = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = work.put(out, f"{n}-{name}") if n + 1 < len(STAGES) else out
        if n > 1:
            work.drop(f"{n - 2}-{STAGES[n - 2][0]}")
    return docs
