"""Exact duplicate removal by progressive refinement, in DataFrame operations only.

Rows are told apart by byte length first, then by a hash of the leading
characters, and only groups that still hold several rows have their whole text
hashed for grouping. Lengths and prefix hashes travel as narrow rows; the text
itself stays where it was scanned as long as the surviving groups fit the
checked broadcast bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Characters hashed in the second step.
PREFIX_CHARS = 128
#: Bytes of (length, prefix hash) groups that may be broadcast.
BROADCAST_BYTES = 64 << 20


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, refined.

    Equal texts form a group; the row with the largest id stays. A null text is
    an empty text; empty texts are equal to each other. A null id counts as
    smallest: it stays only when every id of its group is null. Repeated rows of
    one id and text count towards group_size and all carry kept = true.
    `refined` says that the row reached the full-hash step. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "exact-dedup")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.withColumns({
        "len": F.octet_length("text"),
        "prefix": F.xxhash64(F.substring("text", 1, prefix_chars)),
    })

    shared_len = keyed.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len")
    shared = work.put(
        keyed.select("len", "prefix")
        .join(shared_len, "len", "left_semi")
        .groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1")
        .select("len", "prefix", F.lit(True).alias("refined")),
        "shared",
    )

    if shared.count() * 24 <= broadcast_bytes:
        # Only rows of surviving groups have their whole text hashed for grouping.
        marked = keyed.join(F.broadcast(shared), ["len", "prefix"], "left")
        full = F.when(F.col("refined"), F.sha2("text", 256))
        hashed = marked.select(
            "doc_id", full.alias("full"), F.sha2("text", 256).alias("text_sha256"))
    else:
        # More groups than may be broadcast: moving a 32-byte hash is cheaper than moving texts.
        narrow = keyed.select("doc_id", "len", "prefix", F.sha2("text", 256).alias("text_sha256"))
        hashed = narrow.join(shared, ["len", "prefix"], "left").select(
            "doc_id", F.when(F.col("refined"), F.col("text_sha256")).alias("full"), "text_sha256")
    hashed = work.put(hashed, "hashed")

    alone = hashed.where(F.col("full").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", F.lit(False).alias("refined"))
    several = hashed.where(F.col("full").isNotNull())
    groups = several.groupBy("full").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = several.join(groups, "full").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", F.lit(True).alias("refined"))
    return alone.unionByName(grouped)
