"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

The rank file becomes literal arrays: a perfect hash from a pair of adjacent
ids to the rank of their concatenation. A fold over a word's bytes merges the
lowest-ranked pair, leftmost first, until none is left. Distinct words are
encoded once, as many as a bounded dictionary holds, most frequent first; the
dictionary is broadcast as flat arrays. Any other word is folded by the same
expression in the slice of texts that holds it. Decoding concatenates the
tokens' binary pieces, in the same expressions. Only words of more than
FOLD_BYTES bytes, whose fold would take time with the square of their length,
are merged from a heap of their pairs instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .units import gather, matches, slices

#: Words of the broadcast dictionary, at most: 16 bytes each, their bytes and 2 or 4 more a token. A word that
#: occurs once gains nothing from it and is left to the slice that holds it.
DICTIONARY_WORDS = 1_000_000
#: Longest word of the dictionary, in bytes; with it the bound above is one in bytes.
DICTIONARY_BYTES = 64
#: Steps between one power of two and the next, of the counts among which the dictionary's threshold is chosen.
COUNT_STEPS = 16
#: Bytes of text that share one look-up.
LOOK_UP_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and Python; a batch holds one row at least.
BATCH_BYTES = 8 << 20
#: Longest word that is folded, in bytes.
FOLD_BYTES = 512
#: "No such pair" among ranks; ids and ranks take 20 bits, the place of a byte 22.
NO_PAIR = (1 << 20) - 1
ID_LIMIT = 1 << 20
RANK_UNIT = 1 << 42
#: Characters of a plan that Spark keeps as text.
PLAN_CHARS = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line; every single byte must be there."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)) or max(ranks.values()) >= NO_PAIR:
        raise ValueError("the rank file must hold every byte and ids below 2^20")
    return ranks


class RankMap:
    """Literal arrays of a rank file and the Column expressions that use them."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {ranks[t[:i]] * ID_LIMIT + ranks[t[i:]]: rank for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys, self.values, self.shifts, self.prime = _perfect_hash(pairs)
        token_of = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            token_of[rank] = token.hex()
        self.token_hex = token_of
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]

    def _literal(self, values, kind: str) -> Column:
        # A constant string is split and cast once, by the optimiser's constant folding.
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    def encode(self, words: Column) -> Column:
        """array<array<int>>: the ids of each of an array's words, by folding the ranked merges over its bytes.

        The state is one array with a number per token: the rank of its pair
        with the next token, then the place of its first byte, then its id. The
        least number is therefore the leftmost pair of the lowest rank.
        """
        tables = F.struct(self._literal(self.keys, "bigint").alias("keys"), self._literal(self.values, "int").alias("values"),
                          self._literal(self.shifts, "int").alias("shifts"), self._literal(self.byte_ids, "int").alias("bytes"))
        return _let(tables, lambda t: F.transform(words, lambda word: self._encode(word, t)))

    def _encode(self, word: Column, tables: Column) -> Column:
        keys, values, shifts = tables["keys"], tables["values"], tables["shifts"]
        slots, buckets = len(self.keys), len(self.shifts)

        def rank(key: Column) -> Column:
            place = (key % self.prime + F.get(shifts, (key % buckets).cast("int"))) % slots
            return _let(place.cast("int"), lambda at: F.when(F.get(keys, at) == key, F.get(values, at)).otherwise(F.lit(NO_PAIR)))

        def merge(acc, least):
            def at(p):
                """Put the merged token at place p, drop the next one, and rank the pairs on either side anew."""
                merged = F.shiftright(least, 42)

                def fresh(e, i):
                    before = rank((e % ID_LIMIT) * ID_LIMIT + merged).cast("bigint") * RANK_UNIT + e % RANK_UNIT
                    own = (rank(merged * ID_LIMIT + F.get(acc, p + 1) % ID_LIMIT).cast("bigint") * RANK_UNIT
                           + e % RANK_UNIT - e % ID_LIMIT + merged)
                    return F.when((i < p - 2) | (i > p), e).when(i == p - 2, before).when(i == p - 1, own)

                return F.filter(F.transform(acc, fresh), lambda e: e.isNotNull())

            return _let(F.array_position(acc, least).cast("int"), at)

        def step(acc, _):
            return _let(F.array_min(acc), lambda least: F.when(least >= NO_PAIR * RANK_UNIT, acc).otherwise(merge(acc, least)))

        def fold(ids):
            begin = F.transform(ids, lambda x, i: rank(x.cast("bigint") * ID_LIMIT + F.get(ids, i + 1)).cast("bigint")
                                * RANK_UNIT + i.cast("bigint") * ID_LIMIT + x)
            return F.aggregate(F.slice(ids, 2, F.size(ids)), begin, step,
                               lambda acc: F.transform(acc, lambda e: (e % ID_LIMIT).cast("int")))

        # One character per byte: ISO-8859-1 maps bytes to the first 256 code points.
        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        ids = F.transform(chars, lambda c: F.get(tables["bytes"], F.ascii(c)))
        return _let(ids, lambda x: F.when(F.size(x) > 1, fold(x)).otherwise(x))

    def decode(self, words: Column) -> Column:
        """array<binary>: the bytes of each of an array's words of ids, their tokens' binary pieces concatenated."""
        def joined(pieces):
            return F.transform(words, lambda ids: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))

        return _let(self._literal(self.token_hex, "string"), joined)


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def _perfect_hash(pairs: dict[int, int]) -> tuple[list[int], list[int], list[int], int]:
    """Slots, values and bucket shifts: key k is at (k % prime + shift[k % buckets]) % slots."""
    def is_prime(n):
        return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))

    slots = max(11, int(len(pairs) * 1.6))
    while not is_prime(slots):
        slots += 1
    buckets = max(7, len(pairs) // 3)
    while not is_prime(buckets):
        buckets += 1
    prime = slots * 2 + 1
    while not is_prime(prime) or prime == buckets:
        prime += 2
    members: dict[int, list[int]] = {}
    for key in pairs:
        members.setdefault(key % buckets, []).append(key)
    keys, values = np.full(slots, -1, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    taken, shifts = np.zeros(slots, dtype=bool), [0] * buckets
    for bucket, own in sorted(members.items(), key=lambda x: -len(x[1])):
        base = np.array([k % prime for k in own], dtype=np.int64)
        for shift in range(slots):
            at = (base + shift) % slots
            if not taken[at].any() and len(set(at.tolist())) == len(own):
                break
        else:
            raise ValueError("no perfect hash found")
        taken[at] = True
        keys[at] = own
        values[at] = [pairs[k] for k in own]
        shifts[bucket] = shift
    return keys.tolist(), values.tolist(), shifts, prime


@lru_cache(maxsize=4)
def rank_map(path: str) -> RankMap:
    return RankMap(load_ranks(path))


class LongWords:
    """Ranked merges of long words, leftmost pair of the lowest rank first, from a heap of pairs: O(n log n)."""

    def __init__(self, tokens: list[bytes]):
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.tokens = tokens

    def encode(self, word: bytes) -> list[int]:
        ids: list[int | None] = [self.ranks[word[i:i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))

        def rank(at):
            end = after[at]
            return self.ranks.get(self.tokens[ids[at]] + self.tokens[ids[end]]) if end < len(ids) else None

        pairs = [(r, at) for at in range(len(ids)) if (r := rank(at)) is not None]
        heapq.heapify(pairs)
        while pairs:
            r, at = heapq.heappop(pairs)
            if ids[at] is None or rank(at) != r:  # one of its tokens has been merged since
                continue
            gone = after[at]
            ids[at], ids[gone], after[at] = r, None, after[gone]
            if after[at] < len(ids):
                before[after[at]] = at
            for place in (before[at], at):
                if place >= 0 and (fresh := rank(place)) is not None:
                    heapq.heappush(pairs, (fresh, place))
        return [i for i in ids if i is not None]


def _word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """How often each word occurs over all texts, combined per slice and by Spark before the shuffle."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 0):
                found, codes, _ = matches(part.column(0), pattern)
                n = np.bincount(codes, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([found, pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").where(
        F.octet_length("word") <= DICTIONARY_BYTES).groupBy("word").agg(F.sum("n").alias("n"))


class Dictionary:
    """Ids and bytes of words in flat arrays, found by a 64-bit hash and confirmed by the bytes."""

    def __init__(self, hashes: np.ndarray, words: pa.Array, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words = hashes[order], words.take(pa.array(order))
        self.sizes = sizes[order].astype(np.uint16)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        kind = np.uint16 if not len(ids) or ids.max() < 65536 else np.uint32
        self.ids = gather(starts, sizes, ids.astype(kind), order)
        self.starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes).astype(np.int32)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 where the dictionary lacks it."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        raw = words.cast(pa.binary())
        want = np.fromiter(map(_hash, raw.to_pylist()), np.uint64, len(raw)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, want), len(self.hashes) - 1)
        same = pc.equal(self.words.take(pa.array(at)), raw).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of the words at these places, their ids one word after another)"""
        return self.sizes[at].astype(np.int32), gather(self.starts, self.sizes, self.ids, at).astype(np.int32)


def _hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, 42)


def build_dictionary(docs: DataFrame, ranks: RankMap, pattern: str, most: int, work: Scratch) -> Dictionary:
    """Fold the distinct words of all texts, the most frequent ones that fit `most` words.

    The threshold is chosen among steps of the counts' logarithm, so the driver
    takes at most 64 * COUNT_STEPS of them.
    """
    step = F.floor(F.log2("n") * COUNT_STEPS)
    words = work.put(_word_counts(docs, pattern).where("n >= 2").select("word", step.alias("step")), "words")
    least, held = None, 0
    for r in words.groupBy("step").count().orderBy(F.desc("step")).collect():
        if held + r["count"] > most:
            break
        least, held = r["step"], held + r["count"]
    if least is None:
        return Dictionary(np.empty(0, np.int64), pa.array([], pa.binary()), *[np.empty(0, np.int64)] * 2)
    chosen = words.where(F.col("step") >= least).repartition(max(1, -(-held // 20_000)), "word")
    folded = chosen.select(ranks.encode(F.array("word")).alias("words"))
    got = work.put(folded.select(F.col("words")[0].alias("ids"), ranks.decode(F.col("words"))[0].alias("bytes")),
                   "dictionary").toArrow()
    ids, raw = got.column("ids").combine_chunks(), got.column("bytes").combine_chunks()
    hashes = np.fromiter(map(_hash, raw.to_pylist()), np.uint64, len(raw)).astype(np.int64)
    out = Dictionary(hashes, raw, np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy())
    work.drop("words", "dictionary")
    return out


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Each match of `pattern` is encoded by itself, without special tokens.
    `ids_sha256` is of the decimal ids joined by one space, `decoded_sha256` of
    the bytes that the ids decode to. A null text is empty and has no ids. Texts
    are read whole; ids may be null or repeat; other columns are ignored,
    whatever their names; an empty table gives an empty result.

    The dictionary holds the most frequent words, so its broadcast is bounded by
    `dictionary_words`; every other word is folded once in each slice of texts
    that holds it, at a cost of O(n^2) for n bytes. A word of more than
    FOLD_BYTES bytes takes O(n log n), so one of many megabytes is no trouble.
    """
    spark = docs.sparkSession
    ranks = rank_map(rank_path)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    work = Scratch(spark, "byte-bpe")
    with _settings(spark):
        dictionary = build_dictionary(base, ranks, pattern, dictionary_words, work)
    tokens = [bytes.fromhex(x) for x in ranks.token_hex]
    sent, sent_tokens = spark.sparkContext.broadcast(dictionary), spark.sparkContext.broadcast(tokens)
    del dictionary

    def look_up(batches):
        """One row a slice of texts: its words by number, those of the dictionary first, then long ones, then the rest."""
        known, long_words = sent.value, None
        for batch in batches:
            for part in slices(batch, 1, LOOK_UP_BYTES):
                found, codes, starts = matches(part.column(1), pattern)
                at = known.find(found)
                length = pc.binary_length(found).to_numpy(zero_copy_only=False)
                kind = np.where(at >= 0, 0, np.where(length > FOLD_BYTES, 1, 2))
                order = np.argsort(kind, kind="stable")
                number = np.empty(len(order), np.int32)
                number[order] = np.arange(len(order))
                n_known, n_long = int((kind == 0).sum()), int((kind == 1).sum())
                sizes, ids = known.ids_of(at[order[:n_known]])
                own = [found[k].as_py().encode() for k in order[n_known:n_known + n_long].tolist()]
                raw = known.words.take(pa.array(at[order[:n_known]]))
                if own:
                    long_words = long_words or LongWords(sent_tokens.value)
                    coded = [long_words.encode(w) for w in own]
                    sizes = np.concatenate([sizes, np.array([len(c) for c in coded], np.int32)])
                    ids = np.concatenate([ids, *[np.array(c, np.int32) for c in coded]])
                    raw = pa.concat_arrays([raw, pa.array([b"".join([long_words.tokens[i] for i in c]) for c in coded], pa.binary())])
                rest = found.take(pa.array(order[n_known + n_long:]))
                yield pa.RecordBatch.from_arrays(
                    [_one(part.column(0)), _one(pa.array(starts.astype(np.int32))), _one(pa.array(number[codes])),
                     _one(pa.array(sizes)), _one(pa.array(ids)), _one(raw), _one(rest)],
                    ["doc_ids", "starts", "codes", "sizes", "ids", "raw", "rest"])
                del found, codes, starts, at, length, kind, order, number, sizes, ids, raw, rest
                pa.default_memory_pool().release_unused()

    def assemble(batches):
        """Join the ids and bytes of each text's words; a row has all that its texts need."""
        decimal = pa.array([f"{i} " for i in range(n_tokens)], pa.large_string())
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, starts, codes, sizes, ids, raw, folded, decoded = (c[k].values for c in batch.columns)
                if len(folded):
                    sizes = pa.concat_arrays([sizes, folded.value_lengths()])
                    ids = pa.concat_arrays([ids, folded.flatten()])
                    raw = pa.concat_arrays([raw, decoded])
                sizes, written = sizes.to_numpy(), decimal.take(ids)
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                words = pa.Array.from_buffers(pa.large_string(), len(sizes), [
                    None, pa.py_buffer(_offsets(written)[ends]), written.buffers()[2]])
                starts, counts = starts.to_numpy(), sizes[codes.to_numpy()]
                total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[starts]
                lines = _hashes(words, codes, starts, 1)
                plain = _hashes(raw.cast(pa.large_binary()), codes, starts, 0)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(np.diff(total)), pa.array(lines, pa.string()), pa.array(plain, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            pa.default_memory_pool().release_unused()

    n_tokens = len(tokens)
    kind = docs.schema[id_col].dataType.simpleString()
    asked = base.mapInArrow(
        look_up, f"doc_ids array<{kind}>, starts array<int>, codes array<int>, sizes array<int>, ids array<int>, "
                 "raw array<binary>, rest array<string>")
    folded = asked.withColumn("folded", ranks.encode(F.col("rest"))).drop("rest").withColumn(
        "decoded", ranks.decode(F.col("folded")))
    coded = folded.mapInArrow(
        assemble, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    with _settings(spark):  # written here, so that the session's settings need not stay changed
        return work.put(coded, "coded")


@contextmanager
def _settings(spark):
    """Short texts of plans, which the rank literals would fill with megabytes, and small Arrow batches, while this runs."""
    own = {"spark.sql.maxPlanStringLength": str(PLAN_CHARS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _offsets(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]


def _hashes(words: pa.Array, codes: pa.Array, starts: np.ndarray, cut: int) -> list[str]:
    """sha256 of each text's words, one after another, without the last `cut` bytes."""
    joined = words.take(codes)
    data, ends = joined.buffers()[2], _offsets(joined)[starts].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(data[a:max(a, b - cut)]).hexdigest() for a, b in zip(ends, ends[1:])]
