"""N-gram Jaccard join by grouped prefixes, reported as connected components.

A document is the set of its word shingles. Sets are ordered by an estimated
corpus frequency, rarest first; two sets that are similar enough share a member
of their prefixes. Documents with one and the same set form a class, and
classes with identical prefixes and size form a group. Group pairs are filtered
by size and by what their prefixes can still reach, then expanded to classes
that are verified on whole sets.

Only connectivity is asked for, so classes that are already connected need not
be paired. Linear rounds first link each group with its most promising pivot;
the exact last step pairs whatever is still in different components.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, slices

#: Words of a shingle and similarity of a link (in hundredths) where a caller names none.
SHINGLE_WORDS = 5
SIMILARITY = 80
#: Counters of the frequency estimate; it steers the order of tokens, never the result.
SKETCH_BITS = 21
SKETCH_BLOCK = 1 << 13
#: Linear rounds before the exact step.
PIVOT_ROUNDS = 2
#: Bytes of ids that may be broadcast to pick texts.
BROADCAST_BYTES = 64 << 20
#: Nodes that a task joins to a forest before it sends them on.
FOREST_NODES = 400_000
#: Distinct words whose hashes a task remembers.
CACHE_WORDS = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def shingle_set(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased and words are runs between ASCII white space. Fewer
    words than a shingle has make one shingle of the whole sequence; a text
    without words has the empty set.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(parts))
    out = np.full(len(parts) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k:len(h) - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def least_common(size: np.ndarray | int, similarity: int):
    """Members that a set of this size must share with any similar set."""
    return (similarity * size + 99) // 100


def _similar(common: int, a: int, b: int, similarity: int) -> bool:
    return 100 * common >= similarity * (a + b - common)


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents (doc_id, n, class, text_hash) and, per task, blocks of the frequency sketch."""
    size = 1 << SKETCH_BITS

    def run(batches):
        hashes, sketch = _WordHashes(), np.zeros(size, dtype=np.int64)
        lane = TaskContext.get().partitionId() % 1024
        for batch in slices(batches):
            sets = [shingle_set(t, words, hashes) for t in batch.column(1).to_pylist()]
            joined = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            if len(joined) > size // 8:
                sketch += np.bincount((joined & np.uint64(size - 1)).astype(np.int64), minlength=size)
            else:
                np.add.at(sketch, (joined & np.uint64(size - 1)).astype(np.int64), 1)
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 batch.column(2), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        for block, part in enumerate(sketch.reshape(-1, SKETCH_BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()),
                     pa.array([lane], pa.int32()), pa.array([zlib.compress(part.astype("<u4").tobytes(), 1)], pa.binary())], names)

    names = ["doc_id", "n", "class", "text_hash", "block", "lane", "counts"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, n long, class binary, text_hash long, block int, lane int, counts binary")


def _sum_sketch(blocks: DataFrame) -> np.ndarray:
    """Add the tasks' sketches in two steps of bounded groups; the driver gets 2^SKETCH_BITS counters."""
    def add(group: pd.DataFrame) -> bytes:
        total = np.zeros(SKETCH_BLOCK, dtype=np.int64)
        for x in group["counts"]:
            total += np.frombuffer(zlib.decompress(x), "<u4")
        return zlib.compress(np.minimum(total, 2 ** 32 - 1).astype("<u4").tobytes(), 1)

    def lanes(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "counts": [add(group)]})

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "counts": [add(group)]})

    summed = blocks.groupBy("block", "lane").applyInPandas(lanes, "block int, counts binary").groupBy(
        "block").applyInPandas(whole, "block int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for r in summed.collect():
        sketch[r["block"] * SKETCH_BLOCK:(r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), "<u4")
    return sketch


def _prefixes(docs: DataFrame, words: int, similarity: int, sketch: np.ndarray) -> DataFrame:
    """class, n, group, prefix (rarest first) and the order key of its last token, one row per document."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        hashes, freq = _WordHashes(), sent.value
        mask = np.uint64(len(freq) - 1)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words, hashes)
                if not len(s):
                    continue
                count = freq[(s & mask).astype(np.int64)]
                take = len(s) - int(least_common(len(s), similarity)) + 1
                order = np.lexsort((s, count))[:take]
                prefix = s[order]
                rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s),
                             hashlib.blake2b(len(s).to_bytes(8, "little") + prefix.tobytes(), digest_size=16).digest(),
                             prefix.astype(np.int64),
                             int(count[order[-1]]).to_bytes(8, "big") + int(prefix[-1]).to_bytes(8, "big")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()))],
                ["class", "n", "group", "prefix", "last"])

    return docs.mapInArrow(run, "class binary, n long, group binary, prefix array<long>, last binary")


def _forest(batches):
    """Links of a task as a forest: each node with the smallest node that the task's links reach from it."""
    root: dict[bytes, bytes] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def flush():
        rows = [(x, find(x)) for x in root]
        rows = [(x, y) for x, y in rows if x != y]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.binary())], ["a", "b"])

    for batch in slices(batches):
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = sorted((find(x), find(y)))
            root.setdefault(x, x)
            root[y] = x
        if len(root) > FOREST_NODES:
            yield flush()
    yield flush()


def connected_components(work: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label) with the smallest node of its component, for every node but the smallest itself.

    `links` has binary columns a and b. A task first joins its own links to a
    forest; then large-star and small-star steps alternate until every tree is a
    star. Every round is written out; the number of links never grows.
    """
    edges = work.put(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a binary, b binary").distinct(), f"{name}-edges-0")
    step = 0
    while not _stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                            F.col("m").alias("b"))
        step += 1
        edges = work.put(small.where("a <> b").mapInArrow(_forest, "a binary, b binary").distinct(), f"{name}-edges-{step}")
        work.drop(f"{name}-edges-{step - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none of its own; each star is then a component."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where(
        F.col("out") + F.col("in") > 1).isEmpty()


class _Join:
    def __init__(self, docs: DataFrame, words: int, similarity: int):
        self.spark, self.work = docs.sparkSession, Scratch(docs.sparkSession, "jaccard-join")
        self.docs, self.words, self.similarity = docs, words, similarity

    def prepare(self) -> None:
        profile = self.work.put(_profile(self.docs, self.words), "profile")
        self.members = profile.where("block IS NULL").select("doc_id", "n", "class", "text_hash")
        sketch = _sum_sketch(profile.where("block IS NOT NULL"))
        rows = _prefixes(self.docs, self.words, self.similarity, sketch)
        # One row per class; the rows of a class are equal.
        self.classes = self.work.put(rows.groupBy("class").agg(
            F.first("n").alias("n"), F.first("group").alias("group"), F.first("prefix").alias("prefix"),
            F.first("last").alias("last")), "classes")
        self.groups = self.work.put(self.classes.groupBy("group").agg(
            F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("last").alias("last"),
            F.min("class").alias("head"), F.count("*").alias("members")), "groups")
        # Tokens that one group alone has can pair nothing.
        tokens = self.groups.select(F.posexplode("prefix").alias("before", "token"), "group", "n")
        counts = tokens.groupBy("token").agg(F.count("*").alias("lists")).where("lists > 1").select("token")
        self.postings = self.work.put(tokens.join(counts, "token", "left_semi"), "postings")
        self.labels = self.classes.select(F.col("class").alias("node"), F.col("class").alias("label"))

    def within_reach(self, na: str, nb: str, left_a: str, left_b: str):
        """Size and place filter of two sets that share a token.

        `left` counts a set's members from the shared token on. A similar pair
        passes at its first shared token: nothing before it is common.
        """
        t = self.similarity
        return F.expr(f"100 * {na} >= {t} * {nb} AND 100 * {nb} >= {t} * {na} AND "
                      f"{100 + t} * least({left_a}, {left_b}) >= {t} * ({na} + {nb})")

    def pivot_round(self, turn: int) -> None:
        """Link each group with the pivot that leads most of its posting lists."""
        heads = self.groups.select("group", F.col("head").alias("node")).join(self.labels, "node").select("group", "node", "label")
        lists = self.postings.join(heads, "group")
        # The set whose shared token stands earliest has the fewest members of its own.
        order = F.struct("before", F.xxhash64("group", F.lit(turn)).alias("o"), "group", "n", "node", "label")
        pivots = lists.groupBy("token").agg(F.min(order).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        asked = lists.join(pivots, "token").where(
            (F.col("label") != F.col("p.label")) & self.within_reach("n", "p.n", "n - before", "p.n - p.before"))
        scored = asked.groupBy("node", F.col("p.node").alias("pivot")).agg(F.count("*").alias("c"))
        best = scored.groupBy("node").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot"))
        inside = None
        if turn == 0:  # classes of one group against the group's head
            inside = self.classes.join(self.groups.where("members > 1").select("group", "head"), "group").where(
                "class <> head").select(F.col("class").alias("node"), F.col("head").alias("pivot"))
        pairs = best if inside is None else best.unionByName(inside)
        self.verify(self.plausible(pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b"))), f"pivot-{turn}")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Drop pairs whose prefixes already rule a link out."""
        side = self.classes.select("class", "n", "prefix", "last")
        both = pairs.join(side.toDF("a", "na", "pa", "la"), "a").join(side.toDF("b", "nb", "pb", "lb"), "b")
        return both.where(self.reachable(F.size(F.array_intersect("pa", "pb")))).select("a", "b")

    def reachable(self, common):
        """Whether `common` shared prefix tokens leave room for a link.

        Tokens of the prefix that ends first are all within reach of the other
        prefix, so those that are not shared are not in the other set at all.
        """
        need = F.ceil((F.col("na") + F.col("nb")) * self.similarity / (100 + self.similarity) - 1e-9)
        first = F.col("la") <= F.col("lb")
        n = F.when(first, F.col("na")).otherwise(F.col("nb"))
        held = n - F.ceil(n * self.similarity / 100 - 1e-9) + 1
        return n - (held - common) >= need

    def verify(self, pairs: DataFrame, name: str) -> None:
        """Compare whole sets of class pairs, add the links, and relabel."""
        work, words, similarity = self.work, self.words, self.similarity
        pairs = work.put(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-pairs")
        if pairs.isEmpty():
            return
        needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        ids = work.put(self.members.join(needed, "class").groupBy("class").agg(
            F.min("doc_id").alias("wanted")).select("wanted").distinct(), f"{name}-ids")
        ids = checked_broadcast(ids, ids.count(), 16, BROADCAST_BYTES)
        texts = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["wanted"]), "left_semi").select("text")

        def hash_sets(batches):
            hashes = _WordHashes()
            for batch in slices(batches):
                sets = [shingle_set(t, words, hashes) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "members"])

        sets = work.put(texts.mapInArrow(hash_sets, "class binary, members binary"), f"{name}-sets")

        def compare(batches):
            for batch in slices(batches):
                a, b, left, right = (c.to_pylist() for c in batch.columns)
                good = []
                for x, y in zip(left, right):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    good.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        links = work.put(both.mapInArrow(compare, "a binary, b binary").distinct(), f"{name}-links")
        work.drop(f"{name}-sets", f"{name}-ids", f"{name}-pairs")
        if links.isEmpty():
            return
        # Only components that the new links join are labelled anew, on the graph of their labels.
        named = self.labels.select("node", "label")
        ends = links.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        moved = connected_components(work, ends, name).toDF("label", "to")
        self.labels = work.put(named.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")

    def exact_round(self) -> None:
        """Pair all classes that share a prefix token and are in different components yet."""
        named = self.classes.join(self.labels, self.classes["class"] == self.labels["node"]).select("class", "group", "label")
        by_label = self.work.put(named.groupBy("group", "label").agg(F.count("*").alias("k")), "group-labels")
        lists = self.postings.join(by_label, "group").select("token", "group", "label", "n", (F.col("n") - F.col("before")).alias("rest"))
        # Classes of one group share its whole prefix: the group itself serves as a token.
        split = by_label.groupBy("group").agg(F.count("*").alias("labels")).where("labels > 1").select("group")
        own = self.groups.join(split, "group", "left_semi").join(by_label, "group").select(
            F.xxhash64("group").alias("token"), "group", "label", "n", F.col("n").alias("rest"))
        lists = lists.unionByName(own)
        # Lists under one label alone, as those of large groups of near copies now are, go before any pairing.
        heads = lists.groupBy("token", "label").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
        open_ = heads.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        heads = self.work.put(heads.join(open_, "token", "left_semi"), "heads")
        t = self.similarity
        fits = F.expr(f"x.label < y.label AND 100 * x.most >= {t} * y.least AND 100 * y.most >= {t} * x.least AND "
                      f"{100 + t} * least(x.rest, y.rest) >= {t} * (x.least + y.least)")
        label_pairs = heads.alias("x").join(heads.alias("y"), (F.col("x.token") == F.col("y.token")) & fits).select(
            "x.token", F.col("x.label").alias("lx"), F.col("y.label").alias("ly"))
        left = lists.toDF("token", "ga", "lx", "na", "ra")
        right = lists.toDF("token", "gb", "ly", "nb", "rb")
        hits = label_pairs.join(left, ["token", "lx"]).join(right, ["token", "ly"]).where(
            self.within_reach("na", "nb", "ra", "rb")).select("ga", "lx", "gb", "ly").distinct()
        ends = self.groups.select("group", "n", "prefix", "last")
        kept = hits.join(ends.toDF("ga", "na", "pa", "la"), "ga").join(ends.toDF("gb", "nb", "pb", "lb"), "gb").where(
            self.reachable(F.size(F.array_intersect("pa", "pb")))).select("ga", "lx", "gb", "ly")
        members = self.work.put(named, "named")
        expanded = kept.join(members.toDF("a", "ga", "lx"), ["ga", "lx"]).join(members.toDF("b", "gb", "ly"), ["gb", "ly"])
        self.verify(expanded.select("a", "b"), "exact")


def similar_components(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: int = SIMILARITY,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id, component, text_hash.

    Documents link when 100 * |intersection| >= similarity * |union| of their
    shingle sets. `component_id` is the smallest doc_id reachable by links, the
    document's own included; `class_id` is the smallest doc_id with the same
    set. `component` tells components apart where ids are null or repeat, and
    `text_hash` rows of one id. Null, empty and blank texts have no shingles and
    link with nothing, each being its own component; their `component` is null. Ids are integers; null ids are passed over
    when a smallest id is sought and stay null when there is no other. Repeated
    rows are equal documents and share a class. An empty table gives an empty
    result; other columns are ignored, whatever their names.

    Sets are compared by 64-bit hashes of shingles and classes by 128-bit hashes
    of sets. At worst (many dissimilar documents whose rarest shingles are
    common ones) the exact step is quadratic in a posting list's components.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run = _Join(base, words, similarity)
    run.prepare()
    for turn in range(PIVOT_ROUNDS):
        run.pivot_round(turn)
    run.exact_round()
    full = run.members.where("n > 0")
    by_class = full.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = by_class.join(run.labels, by_class["class"] == run.labels["node"]).select("class", "class_id", "label")
    smallest = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = named.join(smallest, "label").select("class", "class_id", "component_id", "label")
    linked = full.join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id",
                                              F.col("label").alias("component"), "text_hash")
    own = F.col("doc_id")
    empty = run.members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), own.alias("class_id"),
                                              own.alias("component_id"), F.lit(None).cast("binary").alias("component"), "text_hash")
    return linked.unionByName(empty)
