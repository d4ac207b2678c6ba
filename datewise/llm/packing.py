"""Length-bucketed batch packing with boundaries chosen by dynamic programming.

The histogram of lengths over all documents, a row per distinct length at every
size, is reduced to K boundaries that minimise padding exactly. Inside a bucket,
batches hold as many documents as the token budget allows at the bucket's padded
length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Number of length buckets.
BUCKETS = 16
#: Tokens a batch may hold, padding included.
TOKEN_BUDGET = 32_768
#: Rows of one bucket numbered by a single task, on average.
ROWS_PER_SLICE = 50_000


def word_count(text: Column) -> Column:
    """Whitespace-separated words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding.

    cost(i, j) of putting lengths i..j into one bucket is length_j times their
    count minus their tokens. The cost is Monge, so the best split point never
    moves left as j grows and each layer is solved by divide and conquer.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    m = len(lengths)
    if m == 0:
        return []
    seen = np.concatenate([[0.0], np.cumsum(counts)])
    best = lengths * seen[1:]  # one bucket; the tokens themselves are the same in every choice
    choice = [np.zeros(m, dtype=np.int64)]
    for _ in range(min(buckets, m) - 1):
        layer, split = np.empty(m), np.zeros(m, dtype=np.int64)
        work = [(0, m - 1, 0, m - 1)]
        while work:
            lo, hi, left, right = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            starts = np.arange(left, min(mid, right) + 1)
            before = np.where(starts > 0, best[starts - 1], 0.0)
            totals = before + lengths[mid] * (seen[mid + 1] - seen[starts])
            k = int(np.argmin(totals))
            layer[mid], split[mid] = totals[k], starts[k]
            work += [(lo, mid - 1, left, int(starts[k])), (mid + 1, hi, int(starts[k]), right)]
        best = layer
        choice.append(split)
    bounds, end = [], m - 1
    for split in reversed(choice):
        if end < 0:
            break
        bounds.append(int(lengths[end]))
        end = int(split[end]) - 1
    return sorted(set(bounds))


def pack(
    docs: DataFrame,
    length: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket, padded_len, batch_id, slot, padding, then `keep`.

    Every row gets exactly one slot of one batch. Rows of a bucket are taken in
    the order of slices of their id and then of id; ties are told apart by the
    text's hash, and equal rows are interchangeable. A batch holds
    floor(token_budget / padded_len) rows and at least one: a document longer
    than the budget is a batch of its own and is never cut. Null and empty texts
    have length 0 and go to the bucket of the smallest bound. A null id sorts
    first. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "packing")
    tokens = word_count(F.col(text_col)) if length is None else length
    rows = work.put(docs.select(
        F.col(id_col).alias("doc_id"), tokens.cast("long").alias("n_tokens"),
        F.xxhash64(F.col(text_col)).alias("tie"), *[F.col(c).alias(f"keep_{c}") for c in keep]), "rows")

    histogram = rows.groupBy(F.col("n_tokens").alias("len")).count().toArrow()
    bounds = optimal_boundaries(histogram["len"].to_numpy(), histogram["count"].to_numpy(), buckets)
    total = int(histogram["count"].to_numpy().sum())
    slices = max(1, -(-total // ROWS_PER_SLICE))

    bucket = F.lit(0)
    padded = F.lit(bounds[0] if bounds else 0).cast("long")
    for k in range(1, len(bounds)):
        above = F.col("n_tokens") > bounds[k - 1]
        bucket = F.when(above, F.lit(k)).otherwise(bucket)
        padded = F.when(above, F.lit(bounds[k]).cast("long")).otherwise(padded)
    placed = rows.withColumns({
        "bucket": bucket, "padded_len": padded,
        "slice": F.pmod(F.xxhash64("doc_id", "tie"), F.lit(slices)).cast("int"),
    })
    # Rows before a slice of its bucket: a table of buckets x slices, one per 50,000 rows at most.
    sizes = placed.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.withColumn("rn", F.row_number().over(
        Window.partitionBy("bucket", "slice").orderBy("doc_id", "tie")) - 1)
    per_batch = F.greatest(F.floor(F.lit(token_budget) / F.greatest(F.col("padded_len"), F.lit(1))), F.lit(1))
    at = F.col("rn") + F.col("before")
    return numbered.join(before.select("bucket", "slice", "before"), ["bucket", "slice"]).select(
        "doc_id", "n_tokens", "bucket", "padded_len",
        F.concat_ws("-", F.col("bucket"), F.floor(at / per_batch).cast("long")).alias("batch_id"),
        (at % per_batch).cast("int").alias("slot"),
        (F.col("padded_len") - F.col("n_tokens")).alias("padding"),
        *[F.col(f"keep_{c}").alias(c) for c in keep])
