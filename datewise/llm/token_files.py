"""Token files with directly addressable codes.

A shard stores its ids in levels of eight bits. Level 0 holds the low chunk of
every token; a continuation bitmap marks the tokens that go on, and the next
level holds only their next chunks. A rank directory with one entry per 512
bits turns a token's place into its place on the next level, so any token is
read without decoding those before it.

A shard is one row of a Parquet dataset with binary columns, so the writer's
commit protocol makes it safe against lost executors on any file system.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .units import SLICE_ROWS, Runs, matches, slices

#: Bits between two entries of a rank directory.
RANK_STEP = 512
#: Characters of text that one shard takes, on average.
SHARD_CHARS = 8_000_000
#: Distinct pieces, and their ids, that a worker remembers from task to task.
CACHE_PIECES = 700_000
CACHE_IDS = 8_000_000

SHARD_SCHEMA = ("shard int, n_docs long, n_tokens long, doc_ids binary, null_ids long, doc_starts binary, "
                "levels array<binary>, bitmaps array<binary>, ranks array<binary>")


@dataclass
class DirectlyAddressableCodes:
    """ids split into 8-bit levels with continuation bitmaps and rank directories."""

    n: int
    levels: list[np.ndarray]
    bitmaps: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def encode(cls, ids: np.ndarray) -> DirectlyAddressableCodes:
        rest = np.asarray(ids).astype(np.uint32)
        n, levels, bitmaps, ranks = len(rest), [], [], []
        while True:
            levels.append(rest.astype(np.uint8))
            rest = rest >> np.uint32(8)
            more = rest > 0
            if not more.any():
                return cls(n, levels, bitmaps, ranks)
            padded = np.zeros(-(-len(more) // RANK_STEP) * RANK_STEP, dtype=bool)
            padded[:len(more)] = more
            bitmaps.append(np.packbits(padded, bitorder="little"))
            ranks.append(np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_STEP).sum(1))]).astype(np.int64))
            rest = rest[more]

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, at: int) -> int:
        block = at // RANK_STEP
        bits = np.unpackbits(self.bitmaps[level][block * RANK_STEP // 8:at // 8 + 1], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[:at - block * RANK_STEP].sum())

    def __getitem__(self, at: int) -> int:
        """One token, read from one chunk a level."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value, shift = 0, 0
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[at]) << shift
            if level == len(self.bitmaps) or not self.bitmaps[level][at // 8] >> (at % 8) & 1:
                break
            at, shift = self._rank(level, at), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens start..end, touching only their own chunks on every level."""
        out = np.zeros(max(0, end - start), dtype=np.uint64)
        place = np.arange(len(out))
        for level, chunks in enumerate(self.levels):
            out[place] |= chunks[start:end].astype(np.uint64) << np.uint64(8 * level)
            if level == len(self.bitmaps) or start >= end:
                break
            first = start // 8
            more = np.unpackbits(self.bitmaps[level][first:(end + 7) // 8], bitorder="little").astype(bool)
            place = place[more[start - first * 8:end - first * 8]]
            start, end = self._rank(level, start), self._rank(level, end)
        return out

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        out, place = self.levels[0].astype(np.uint32), None
        for level, chunks in enumerate(self.levels[1:], 1):
            bits = np.unpackbits(self.bitmaps[level - 1], bitorder="little", count=len(self.levels[level - 1]))
            more = np.flatnonzero(bits)
            place = more if place is None else place[more]
            out[place] |= chunks.astype(np.uint32) << np.uint32(8 * level)
        return out

    def to_binary(self) -> tuple[list[bytes], list[bytes], list[bytes]]:
        return ([x.tobytes() for x in self.levels], [x.tobytes() for x in self.bitmaps],
                [x.astype("<i8").tobytes() for x in self.ranks])

    @classmethod
    def from_binary(cls, n, levels, bitmaps, ranks) -> DirectlyAddressableCodes:
        return cls(n, [np.frombuffer(x, np.uint8) for x in levels], [np.frombuffer(x, np.uint8) for x in bitmaps],
                   [np.frombuffer(x, "<i8") for x in ranks])


class PieceEncoder:
    """Ids of whole texts by the tokenizers library with its defaults, which sees each distinct piece once.

    Merges never cross the pieces of the vocabulary's split pattern, so a
    piece's ids do not depend on its surroundings. What is remembered of pieces
    starts afresh beyond a bound in their number or their ids.
    """

    def __init__(self, tokenizer_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = {i: name for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.token_bytes = np.array([len(names.get(i, "")) for i in range(max(names) + 1)], np.int64)
        self.pattern, self.pieces, self.runs = pattern, {}, Runs()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        which, starts = self.runs_of(pa.array(texts, pa.string()))
        return [self.runs.of(which[a:b]) for a, b in zip(starts, starts[1:])]

    def runs_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the runs of ids, one text after another; the first place of each text and the end)

        A text that holds an added token's string is one run, by the library from its whole text.
        """
        whole = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False).astype(bool)
        if not whole.any():
            return self._runs_of(texts)
        which, starts = self._runs_of(pc.if_else(pa.array(whole), "", texts))
        rows = np.flatnonzero(whole)
        coded = [self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids for k in rows.tolist()]
        numbers = self.runs.n + np.arange(len(rows))
        self.runs.add(np.array([len(c) for c in coded]), np.concatenate([np.array(c, np.uint32) for c in coded]))
        return np.insert(which, starts[rows], numbers), starts + np.concatenate([[0], np.cumsum(whole)])

    def _runs_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, codes, starts = matches(texts, self.pattern)
        found = found.to_pylist()
        if len(self.pieces) > CACHE_PIECES or self.runs.filled > CACHE_IDS:
            self.pieces, self.runs = {}, Runs()
        known = list(map(self.pieces.get, found))
        first, new = self.runs.n, [p for p, n in zip(found, known) if n is None]
        self._encode(new)
        numbers = np.array([-1 if n is None else n for n in known], dtype=np.int64)
        numbers[numbers < 0] = first + np.arange(len(new))
        return numbers[codes], starts

    def _encode(self, new: list[str]) -> None:
        if not new:
            return
        # One call for all new pieces, each a word of its own. A byte-level token stands for as many bytes as its name
        # has characters, which tells whose a token is; where that does not add up, word_ids does.
        ids = np.array(self.tokenizer.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        piece_ends, token_ends = np.cumsum([len(p.encode()) for p in new]), np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(token_ends, piece_ends)
        if len(ids) and token_ends[-1] == piece_ends[-1] and (token_ends[last] == piece_ends).all():
            sizes = np.diff(last, prepend=-1)
        else:
            got = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, dtype=np.uint32)
            sizes = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(new))
        self.pieces.update(zip(new, range(self.runs.n, self.runs.n + len(new))))
        self.runs.add(sizes, ids)


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def _encoder(path: str, pattern: str) -> PieceEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PieceEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int | None,
                 id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> None:
    """Encode every text and write shards in ascending id order to `path`.

    Ids must be integers. A null text is empty and holds only the end id; null
    ids come first; rows that share an id stand next to each other, ordered by
    their tokens. An empty table writes an empty dataset. Other columns are
    ignored, whatever their names. Shard limits come from percentiles of the
    ids over all rows, so a shard holds a bounded share of the rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = base.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-chars // shard_chars))
    cuts = [i / shards for i in range(1, shards)]
    limits = (base.agg(F.percentile_approx("doc_id", cuts, 100 * shards).alias("q")).first()["q"] if cuts else []) or []
    limits = np.unique(np.array(limits, dtype=np.int64))

    def encode(batches):
        encoder = _encoder(tokenizer_path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                which, starts = encoder.runs_of(part.column(1))
                for at in range(0, part.num_rows, SLICE_ROWS):
                    yield rows(part.column(0).slice(at, SLICE_ROWS), encoder.runs, which, starts[at:at + SLICE_ROWS + 1])

    def rows(doc_ids, runs, which, starts):
        which = which[starts[0]:starts[-1]]
        ids, tail = runs.of(which), 0 if end_id is None else 1
        ends = np.concatenate([[0], np.cumsum(runs.sizes[which], dtype=np.int64)])[starts - starts[0]]
        ends += tail * np.arange(len(ends))
        tokens = np.full(int(ends[-1]), end_id or 0, dtype="<u4" if max(ids.max(initial=0), end_id or 0) > 65535 else "<u2")
        own = np.ones(len(tokens), dtype=bool)
        if tail:
            own[ends[1:] - 1] = False
        tokens[own] = ids
        packed = pa.Array.from_buffers(pa.large_binary(), len(doc_ids), [
            None, pa.py_buffer((ends * tokens.itemsize).astype(np.int64)), pa.py_buffer(tokens)]).cast(pa.binary())
        places = np.searchsorted(limits, doc_ids.fill_null(0).to_numpy(), side="right")
        places[doc_ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return pa.RecordBatch.from_arrays(
            [pa.array(places.astype(np.int32)), doc_ids, pa.array(np.full(len(doc_ids), tokens.itemsize, np.int32)), packed],
            ["shard", "doc_id", "width", "ids"])

    def build(batches):
        shard, ids, rows = None, [], []

        def close():
            tokens = np.concatenate(rows)
            codes = DirectlyAddressableCodes.encode(tokens)
            levels, bitmaps, ranks = codes.to_binary()
            starts = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype("<i8")
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(tokens)], pa.int64()),
                 pa.array([np.array(known, dtype="<i8").tobytes()], pa.binary()),
                 pa.array([len(ids) - len(known)], pa.int64()), pa.array([starts.tobytes()], pa.binary()),
                 pa.array([levels], pa.list_(pa.binary())), pa.array([bitmaps], pa.list_(pa.binary())),
                 pa.array([ranks], pa.list_(pa.binary()))],
                ["shard", "n_docs", "n_tokens", "doc_ids", "null_ids", "doc_starts", "levels", "bitmaps", "ranks"])

        for batch in batches:
            for s, i, w, x in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is not None and s != shard:
                    yield close()
                    ids, rows = [], []
                shard = s
                ids.append(i)
                rows.append(np.frombuffer(x, "<u2" if w == 2 else "<u4"))
        if rows:
            yield close()

    encoded = base.mapInArrow(encode, "shard int, doc_id long, width int, ids binary")
    ordered = encoded.repartition(int(len(limits)) + 1, "shard").sortWithinPartitions(
        "shard", F.asc_nulls_first("doc_id"), "ids")
    # Codes lie in the files as they are, without compression, so a token is read and not decompressed.
    ordered.mapInArrow(build, SHARD_SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def _offsets(shards: DataFrame) -> DataFrame:
    """shard and the ids of all shards before it; one row a shard is ordered globally."""
    return shards.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(
            Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "offset")


def read_span(spark, path: str, start: int, end: int) -> DataFrame:
    """(place, id) of the corpus' tokens start..end, end exclusive, by random access.

    Only shards that hold some of them are read, and of their codes only the
    chunks of these tokens are looked at.
    """
    shards = spark.read.parquet(path)
    asked = shards.join(_offsets(shards), "shard").where((F.col("offset") < end) & (F.col("offset") + F.col("n_tokens") > start)).select(
        "offset", "n_tokens", "levels", "bitmaps", "ranks")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = DirectlyAddressableCodes.from_binary(row["n_tokens"], row["levels"], row["bitmaps"], row["ranks"])
                lo, hi = max(0, start - row["offset"]), min(row["n_tokens"], end - row["offset"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(lo, hi) + row["offset"], pa.int64()), pa.array(codes.slice(lo, hi).astype(np.int64))], ["place", "id"])

    return asked.mapInArrow(run, "place long, id long")


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32 and, if asked, ids, all from the files.

    `start` counts the ids of all documents before it in ascending id order.
    Only one row a shard is ordered globally.
    """
    shards = spark.read.parquet(path)
    offsets = _offsets(shards)

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = DirectlyAddressableCodes.from_binary(row["n_tokens"], row["levels"], row["bitmaps"], row["ranks"])
                starts = np.frombuffer(row["doc_starts"], "<i8")
                ids = [None] * row["null_ids"] + np.frombuffer(row["doc_ids"], "<i8").tolist()
                tokens = codes.all().astype("<u4", copy=False)
                for at in range(0, len(ids), 2000):
                    end = min(at + 2000, len(ids))
                    docs = [tokens[starts[k]:starts[k + 1]] for k in range(at, end)]
                    raw = [d.tobytes() for d in docs]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * len(docs), pa.int32()), pa.array(ids[at:end], pa.int64()),
                         pa.array(starts[at:end], pa.int64()), pa.array([len(d) for d in docs], pa.int64()),
                         pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                         pa.array(raw if with_ids else [None] * len(raw), pa.binary())],
                        ["shard", "doc_id", "local", "n_tokens", "ids_crc32", "ids"])

    rows = shards.mapInArrow(decode, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(offsets, "shard").select(
        "doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def token_file_index(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int) -> DataFrame:
    """Write the corpus to a scratch token dataset and return what its files say of each document."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'token-files').root}/shards"
    write_tokens(docs, path, tokenizer_path, pattern, end_id)
    return read_tokens(spark, path, with_ids=False)
