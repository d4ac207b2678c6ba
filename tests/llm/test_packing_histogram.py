"""Bounds are those of the true histogram however many distinct lengths there are."""

import numpy as np
from pyspark.sql import functions as F

from datewise.llm import packing


def test_many_distinct_lengths(spark):
    m = (1 << 17) + 2000
    docs = spark.range(m).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = packing.pack(docs, length=F.col("doc_id") * 2 + 1, buckets=3)
    bounds = sorted(r["padded_len"] for r in got.select("padded_len").distinct().collect())
    assert bounds == packing.optimal_boundaries(np.arange(m) * 2 + 1, np.ones(m, np.int64), 3)
    assert got.count() == m and got.where("padding < 0 OR padded_len % 2 = 0").count() == 0
