"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt into shards of bounded size and each shard gets a KD-tree with
median splits and tight bounding boxes. A query visits nodes best first by the
largest inner product its box allows, and stops when no box can beat its k-th
score. That score travels: it starts from a seed shard and goes on from shard to
shard inside a task.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a shard, on average.
SHARD_VECTORS = 4096
#: Vectors of a leaf, at most.
LEAF_VECTORS = 64
#: Queries searched in one pass over the shards; bounds what is broadcast.
QUERY_BLOCK = 16_384


class KDTree:
    """Median-split tree over integer vectors; nodes are ranges of a permuted matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_VECTORS):
        order = np.arange(len(ids))
        spans: list[tuple[int, int]] = []
        kids: list[tuple[int, int]] = []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []

        def build(lo: int, hi: int) -> int:
            node = len(spans)
            own = vectors[order[lo:hi]]
            low, high = own.min(0), own.max(0)
            spans.append((lo, hi))
            kids.append((-1, -1))
            boxes.append((low, high))
            if hi - lo > leaf:
                mid = (hi - lo) // 2
                axis = int(np.argmax(high - low))
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
                kids[node] = (build(lo, lo + mid), build(lo + mid, hi))
            return node

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.spans, self.kids = np.array(spans), np.array(kids)
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest possible inner product of each query with each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: list[list], k: int) -> None:
        """Improve `best`, a min-heap of (score, -vec_id) for each query, by this tree's vectors."""
        spans, kids, ids, vectors = self.spans.tolist(), self.kids.tolist(), self.ids, self.vectors
        limits = self.bounds(queries)
        for q in range(len(queries)):
            heap, row, own, query = best[q], limits[q].tolist(), query_ids[q], queries[q]
            frontier = [(-row[0], 0)]
            while frontier:
                bound, node = heapq.heappop(frontier)
                if len(heap) == k and -bound < heap[0][0]:
                    break
                left, right = kids[node]
                if left >= 0:
                    for kid in (left, right):
                        if len(heap) < k or row[kid] >= heap[0][0]:
                            heapq.heappush(frontier, (-row[kid], kid))
                    continue
                lo, hi = spans[node]
                scores = vectors[lo:hi] @ query
                near = np.flatnonzero(scores >= heap[0][0]) if len(heap) == k else np.arange(hi - lo)
                for i in near.tolist():
                    vec = int(ids[lo + i])
                    if vec == own:
                        continue
                    item = (int(scores[i]), -vec)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double; null where the vector can take no part."""
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                               & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def _pack_tree(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    # Float products are exact below 2^53 and use fast kernels; larger ones stay integers.
    limit = float(np.abs(vectors).max(initial=0)) ** 2 * max(1, vectors.shape[1])
    return pickle.dumps(KDTree(ids, vectors.astype(np.float64) if limit < 2 ** 52 else vectors))


def exact_topk(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id",
               vector_col: str = "embedding", shard_vectors: int = SHARD_VECTORS,
               query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k highest inner products of each query row with all other rows: query_id, rank, vec_id, score.

    `query` is a condition on `doc`-level columns of `vectors` that picks the
    queries. Components are quantised to floor(256 * x). Ties go to the smaller
    vec_id. Vectors that are null, empty, or hold null or non-finite components
    take no part, nor do rows with a null id. Rows that share the query's id are
    its own. Vectors are compared with those of their own dimension only. Fewer
    than k candidates give fewer rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    work = Scratch(spark, "exact-topk")
    rows = work.put(vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v"),
        F.coalesce(query, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND size(v) > 0"), "rows")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if("asks").alias("asking")).collect()
    shards = max(1, -(-sum(r["n"] for r in sizes) // shard_vectors))

    def plant(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = _pack_tree(group["vec_id"].to_numpy(np.int64), np.array(group["v"].tolist(), dtype=np.int64))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [tree]})

    trees = work.put(
        rows.select("vec_id", "v", F.size("v").alias("dim"),
                    F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
        .groupBy("dim", "shard").applyInPandas(plant, "dim int, shard int, tree binary"), "trees")

    found = None
    for r in sorted(sizes, key=lambda r: r["dim"]):
        own = trees.where(F.col("dim") == r["dim"]).select("shard", "tree")
        blocks = -(-r["asking"] // query_block)
        for b in range(blocks):
            asked = rows.where(F.col("asks") & (F.size("v") == r["dim"])
                               & (F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)) == b)).select("vec_id", "v").collect()
            if not asked:
                continue
            part = work.put(_search_block(own, asked, k), f"block-{r['dim']}-{b}")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_block(trees: DataFrame, asked: list, k: int) -> DataFrame:
    """Search one block of queries in every shard; each task returns its best k of a query."""
    query_ids, at = np.unique(np.array([r["vec_id"] for r in asked], dtype=np.int64), return_index=True)
    queries = np.array([asked[i]["v"] for i in at], dtype=np.int64)
    seed_row = trees.orderBy("shard").limit(1).collect()[0]
    exact = float(np.abs(queries).max(initial=0))
    seed: list[list] = [[] for _ in query_ids]

    def fit(tree: KDTree) -> np.ndarray:
        top = exact * float(np.abs(tree.vectors).max(initial=0)) * queries.shape[1]
        if top >= 2 ** 52 and tree.vectors.dtype != np.int64:
            for name in ("vectors", "low", "high"):
                setattr(tree, name, getattr(tree, name).astype(np.int64))
        return queries.astype(tree.vectors.dtype)

    tree = pickle.loads(seed_row["tree"])
    tree.search(query_ids, fit(tree), seed, k)
    spark = trees.sparkSession
    sent = spark.sparkContext.broadcast((query_ids, queries, seed))

    def search(batches):
        ids, _, start = sent.value
        best = [list(h) for h in start]
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard == seed_row["shard"]:
                    continue
                tree = pickle.loads(blob)
                tree.search(ids, fit(tree), best, k)
        # The seed's finds come once, from the driver below; a task adds only what is new.
        new = [(int(q), -v, s) for q, h, old in zip(ids, best, start) for s, v in set(h) - set(old)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in new], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    schema = "query_id long, vec_id long, score long"
    from_seed = [(int(q), -v, s) for q, h in zip(query_ids, seed) for s, v in h]
    tasks = min(max(1, math.ceil(trees.count() / 2)), 4096)
    return trees.repartition(tasks, "shard").mapInArrow(search, schema).unionByName(
        spark.createDataFrame(from_seed, schema))
