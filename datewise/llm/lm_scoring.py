"""Masked pseudo-likelihood scoring with a bidirectional window network in numpy.

The network predicts every token of a text from the tokens on both sides of it
and never sees the token itself. Each task trains on all of its texts by
mini-batch gradient steps from the same start; the tasks' steps are averaged by
tokens, in fixed-point numbers so that the sum has no order. A document's score
is the sum of the log-probabilities of all its tokens given their contexts.

The most frequent words have ids of their own; every other word belongs to one
of UNKNOWN classes, whose probability the network gives. Within its class it has
a log-probability of its own, from a table of all words of the corpus that stays
distributed and grows with it. The table's most frequent words are broadcast, a
bounded number of them; the others meet it in a join.

Texts are dealt to shards by hash, and a shard is trained by one task, so scores
do not depend on how the table is partitioned.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .units import slices as byte_slices

#: Tokens seen on either side.
WINDOW = 2
#: Length of an embedding.
WIDTH = 16
#: Output words are split into SIDE classes of SIDE words, so a softmax takes 2 * SIDE scores.
SIDE = 32
#: Classes of words outside the vocabulary, by hash; id 0 is the edge of a text.
UNKNOWN = 63
#: Tokens of a gradient step.
BATCH = 4096
LEARNING_RATE = 0.08
#: Rounds of training; the steps of all shards are averaged after each. A round takes its share of the texts, so all
#: rounds are one pass over the corpus. A corpus of fewer than ROUNDS * STEPS * BATCH tokens is passed up to ROUNDS times.
ROUNDS = 4
#: Steps of a shard and round, about.
STEPS = 256
#: Words of the tail whose log-probabilities are broadcast, at most, 16 bytes each.
HOT_WORDS = 1_000_000
#: Steps between one power of two and the next, of the counts among which the threshold of hot words is chosen.
COUNT_STEPS = 16
#: Bytes of text whose words are put together.
SLICE_BYTES = 8 << 20
FIXED_POINT = 2.0 ** 32
#: Words of a class that occur this often have a share of their own; the others share what is left by their bytes.
MIN_COUNT = 2
#: What every such word cedes of its count to the words that are rarer.
DISCOUNT = 0.75
TAIL_POINT = 2.0 ** 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the word at each place, the first place of each text and the end), as `words_of` finds them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    words, codes, starts = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]
    if b"" in words:  # beside white space at either end
        there = codes != words.index(b"")
        starts = np.concatenate([[0], np.cumsum(there)])[starts]
        codes = codes[there]
    return words, codes, starts


def word_counts(docs: DataFrame) -> DataFrame:
    """Every word of all texts and its count, as a written table; Spark adds a task's counts up before the shuffle."""

    def count(batches):
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                words, codes, _ = _coded_words(part.column(1))
                n = np.bincount(codes, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    counts = docs.mapInArrow(count, "word binary, n long").where("n > 0")
    return Scratch(docs.sparkSession, "lm-words").put(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> dict[bytes, int]:
    """Ids of the most frequent words over all texts; the words beyond them are left to `tail_log_probs`."""
    counts = word_counts(docs) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(SIDE * SIDE - UNKNOWN - 1).collect()
    return {bytes(r["word"]): UNKNOWN + 1 + i for i, r in enumerate(top)}


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(byte trigrams of all words, start of each word's); a word starts after two line breaks and ends at one."""
    s = np.frombuffer(b"\n\n" + b"\n\n".join(words) + b"\n\n", np.uint8).astype(np.int32)
    tri = s[:-2] << 16 | s[1:-1] << 8 | s[2:]
    within = ~((s[1:-1] == 10) & (s[:-2] != 10))
    sizes = np.array([len(w) + 1 for w in words])
    return tri[within], np.cumsum(sizes) - sizes


def tail_log_probs(counts: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """key (hash of a word), logp, n: log p(word | its class) in steps of 1 / TAIL_POINT, for every word without an id.

    A word of count n >= MIN_COUNT has (n - DISCOUNT) / N, where N counts its
    class; what is left of a class is spread over all words by a byte trigram
    model of the corpus' distinct words, so that no word is without probability.
    The table has a row per distinct word and is never gathered; the driver
    takes UNKNOWN sums and the trigrams.
    """
    sent = counts.sparkSession.sparkContext.broadcast(known)

    def classes(batches):
        for batch in slices(batches):
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            tail = np.array([w not in sent.value for w in words], dtype=bool)
            group = np.array([TokenIds.of(w) for w in words], dtype=np.int64)[tail]
            n = n[tail]
            if len(n):
                own = n >= MIN_COUNT
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(UNKNOWN + 1), pa.int32()),
                     pa.array(np.bincount(group, n, UNKNOWN + 1).astype(np.int64)),
                     pa.array(np.bincount(group[own], n[own], UNKNOWN + 1).astype(np.int64)),
                     pa.array(np.bincount(group[own], minlength=UNKNOWN + 1))], ["class", "n", "own", "kinds"])

    def spell(batches):
        for batch in slices(batches):
            words = [w for w in batch.column(0).to_pylist() if w not in sent.value]
            if words:
                tri, n = np.unique(_trigrams(words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tri, pa.int32()), pa.array(n, pa.int64())], ["tri", "n"])

    size, left = np.ones(UNKNOWN + 1), np.ones(UNKNOWN + 1)
    for r in counts.mapInArrow(classes, "class int, n long, own long, kinds long").groupBy("class").agg(
            F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("kinds").alias("kinds")).collect():
        if r["n"]:
            size[r["class"]] = r["n"]
            left[r["class"]] = max((r["n"] - r["own"] + DISCOUNT * r["kinds"]) / r["n"], 1e-9)
    seen = counts.mapInArrow(spell, "tri int, n long").groupBy("tri").agg(F.sum("n").alias("n")).toArrow()
    tri, times = seen.column(0).to_numpy(), seen.column(1).to_numpy()
    order = np.argsort(tri)
    tri, times = tri[order], times[order]
    pairs, at = np.unique(tri >> 8, return_inverse=True)
    after = np.bincount(at, times, len(pairs))
    shape = counts.sparkSession.sparkContext.broadcast(
        (tri, np.log((times + 1) / (after[at] + 256)), size, left))

    def run(batches):
        tri, logs, size, left = shape.value
        for batch in slices(batches):
            pairs = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     if w not in sent.value]
            if not pairs:
                continue
            words = [w for w, _ in pairs]
            n = np.array([n for _, n in pairs], dtype=np.float64)
            group = np.array([TokenIds.of(w) for w in words])
            grams, starts = _trigrams(words)
            bytewise = np.add.reduceat(logs[np.searchsorted(tri, grams)], starts)
            p = np.where(n >= MIN_COUNT, n - DISCOUNT, 0) / size[group]
            logp = np.logaddexp(np.log(np.maximum(p, 1e-300)), np.log(left[group]) + bytewise)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(_key, words)), pa.int64()), pa.array(np.rint(logp * TAIL_POINT).astype(np.int64)),
                 pa.array(n.astype(np.int64))], ["key", "logp", "n"])

    return counts.mapInArrow(run, "key long, logp long, n long")


def _key(word: bytes) -> int:
    """The same number as Spark's xxhash64 of the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def hot_words(tail: DataFrame, most: int = HOT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their logp) of the tail's most frequent words, as many as fit `most`.

    The threshold is chosen among steps of the counts' logarithm, so the driver
    takes at most 64 * COUNT_STEPS of them.
    """
    step = F.floor(F.log2("n") * COUNT_STEPS)
    least, held = None, 0
    for r in tail.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if held + r["count"] > most:
            break
        least, held = r["step"], held + r["count"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    got = tail.where(step >= least).select("key", "logp").toArrow()
    keys, logp = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], logp[order]


class TokenIds(dict):
    """Word to id; words outside the vocabulary share UNKNOWN ids by hash."""

    @staticmethod
    def of(word: bytes) -> int:
        return 1 + zlib.crc32(word) % UNKNOWN

    def __missing__(self, word: bytes) -> int:
        return self.of(word)

    def __call__(self, text: str | None) -> np.ndarray:
        parts = words_of(text)
        return np.fromiter(map(self.__getitem__, parts), dtype=np.int64, count=len(parts))


def contexts(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, their 2 * WINDOW neighbours, row of each target); edges of a text are id 0."""
    if not rows:
        return np.empty(0, np.int64), np.empty((0, 2 * WINDOW), np.int64), np.empty(0, np.int64)
    gap = np.zeros(WINDOW, dtype=np.int64)
    lengths = np.array([len(r) for r in rows])
    stream = np.concatenate([x for r in rows for x in (gap, r)] + [gap])
    owner = np.repeat(np.arange(len(rows)), lengths)
    at = np.arange(len(owner)) + WINDOW * (owner + 1)
    offsets = np.array([k for k in range(-WINDOW, WINDOW + 1) if k])
    return stream[at], stream[at[:, None] + offsets], owner


@dataclass
class WindowNetwork:
    """log p(token | neighbours) = log p(class) + log p(word in class), from position-wise context embeddings."""

    embed: np.ndarray  # (2 * WINDOW, words, WIDTH)
    to_class: np.ndarray  # (WIDTH + 1, SIDE)
    to_word: np.ndarray  # (SIDE, WIDTH + 1, SIDE)

    @classmethod
    def start(cls) -> WindowNetwork:
        rng = np.random.default_rng(20_240_101)
        words = SIDE * SIDE
        return cls(rng.normal(0, 0.1, (2 * WINDOW, words, WIDTH)).astype(np.float32),
                   np.zeros((WIDTH + 1, SIDE), np.float32), np.zeros((SIDE, WIDTH + 1, SIDE), np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.to_class.ravel(), self.to_word.ravel()])

    @classmethod
    def from_flat(cls, x: np.ndarray) -> WindowNetwork:
        base = cls.start()
        cut = np.cumsum([base.embed.size, base.to_class.size])
        a, b, c = np.split(x.astype(np.float32), cut)
        return cls(a.reshape(base.embed.shape), b.reshape(base.to_class.shape), c.reshape(base.to_word.shape))

    def hidden(self, near: np.ndarray) -> np.ndarray:
        h = np.empty((len(near), WIDTH + 1), np.float32)
        h[:, WIDTH] = 1
        total = self.embed[0][near[:, 0]]
        for k in range(1, near.shape[1]):
            total = total + self.embed[k][near[:, k]]
        np.tanh(total, out=h[:, :WIDTH])
        return h

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        """Over the first axis, which leaves whole rows to be combined."""
        scores -= scores.max(0)
        np.exp(scores, out=scores)
        scores /= scores.sum(0)
        return scores

    @staticmethod
    def _log_softmax_at(scores: np.ndarray, which: np.ndarray) -> np.ndarray:
        top = scores.max(0)
        own = scores[which, np.arange(scores.shape[1])] - top
        scores -= top
        np.exp(scores, out=scores)
        return own - np.log(scores.sum(0))

    def _by_class(self, group: np.ndarray):
        order = np.argsort(group.astype(np.uint8), kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=SIDE))])
        return order, edges

    def log_prob(self, target: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its neighbours."""
        group, word = target // SIDE, target % SIDE
        order, edges = self._by_class(group)
        h, word = self.hidden(near)[order], word[order]
        out = self._log_softmax_at(self.to_class.T @ h.T, group[order]).astype(np.float64)
        for c in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[c], edges[c + 1])
            out[own] += self._log_softmax_at(self.to_word[c].T @ h[own].T, word[own])
        back = np.empty(len(target))
        back[order] = out
        return back

    def step(self, target: np.ndarray, near: np.ndarray, rate: float) -> None:
        """One gradient step of the mean negative log-probability; rows of rare ids take larger steps."""
        n = len(target)
        order, edges = self._by_class(target // SIDE)
        target, near = target[order], near[order]
        h, group, word = self.hidden(near), target // SIDE, target % SIDE
        p = self._softmax(self.to_class.T @ h.T)
        p[group, np.arange(n)] -= 1
        back = p.T @ self.to_class.T
        grad_class = (p @ h).T / n
        for c in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[c], edges[c + 1])
            hc = h[own]
            q = self._softmax(self.to_word[c].T @ hc.T)
            q[word[own], np.arange(len(hc))] -= 1
            back[own] += q.T @ self.to_word[c].T
            self.to_word[c] -= rate * 8 * (q @ hc).T / max(len(hc), 32)
        self.to_class -= rate * 8 * grad_class
        back = back[:, :WIDTH] * (1 - h[:, :WIDTH] ** 2)
        for k in range(near.shape[1]):
            order = np.argsort(near[:, k].astype(np.uint16), kind="stable")
            ids = near[order, k]
            starts = np.flatnonzero(np.diff(ids, prepend=-1))
            times = np.diff(starts, append=n)
            total = np.add.reduceat(back[order], starts, axis=0)
            self.embed[k][ids[starts]] -= (rate * total / np.sqrt(times * 8.0)[:, None]).astype(np.float32)


def encode(docs: DataFrame, known: dict[bytes, int], hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """One row per input row, written: row, doc_id, ids (16-bit numbers), at (a hash), tail, rest.

    `tail` sums the hot words' log-probabilities, `rest` has the keys of the
    other words without an id of their own.
    """
    hot = (np.empty(0, np.int64), np.empty(0, np.int64)) if hot is None else hot
    sent = docs.sparkSession.sparkContext.broadcast((known, *hot))

    def run(batches):
        known, keys, logp = sent.value
        numbers = TokenIds(known)
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                words, codes, starts = _coded_words(part.column(1))
                number = np.fromiter(map(numbers.__getitem__, words), np.int16, len(words))
                unknown = np.flatnonzero(number <= UNKNOWN)
                own = np.zeros(len(words), np.int64)
                own[unknown] = np.fromiter((_key(words[k]) for k in unknown.tolist()), np.int64, len(unknown))
                value, missing = np.zeros(len(words), np.int64), number <= UNKNOWN
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own[unknown]), len(keys) - 1)
                    hit = keys[at] == own[unknown]
                    value[unknown[hit]] = logp[at[hit]]
                    missing[unknown[hit]] = False
                ids = number[codes]
                sums = np.concatenate([[0], np.cumsum(value[codes])])
                lacking = missing[codes]
                ends = np.concatenate([[0], np.cumsum(lacking)])[starts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary()),
                     pa.array(np.diff(sums[starts])),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(own[codes[lacking]]))],
                    ["doc_id", "ids", "tail", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.mapInArrow(run, f"doc_id {kind}, ids binary, tail long, rest array<long>")
    return Scratch(docs.sparkSession, "lm-ids").put(
        coded.withColumns({"row": F.monotonically_increasing_id(), "at": F.xxhash64("doc_id", "ids")}), "ids")


def _token_batches(batches, size: int):
    """(targets, neighbours) of about `size` tokens, over all texts of a task and every token of each."""
    rows, held = [], 0
    for batch in slices(batches):
        for coded in batch.column(0).to_pylist():
            r = np.frombuffer(coded, np.int16).astype(np.int64)
            if len(r):
                rows.append(r)
                held += len(r)
            if held >= size:
                target, near, _ = contexts(rows)
                for at in range(0, len(target), size):
                    yield target[at:at + size], near[at:at + size]
                rows, held = [], 0
    if rows:
        target, near, _ = contexts(rows)
        for at in range(0, len(target), size):
            yield target[at:at + size], near[at:at + size]


def train(docs: DataFrame, known: dict[bytes, int], rounds: int = ROUNDS) -> WindowNetwork:
    """Train on every token of every text.

    A task sends one number per parameter, whatever its texts' size; the sums
    are taken in whole numbers by Spark's aggregation and only one network
    reaches the driver.
    """
    return _train_ids(encode(docs, known), rounds)


def _train_ids(coded: DataFrame, rounds: int) -> WindowNetwork:
    network = WindowNetwork.start()
    context = coded.sparkSession.sparkContext
    tokens = (coded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 2
    passes = min(rounds, max(1, -(-rounds * STEPS * BATCH // max(1, tokens))))
    shards = max(1, tokens * passes // (rounds * STEPS * BATCH))
    texts = coded.select("ids", "at").where(F.octet_length("ids") > 0)
    for turn in range(rounds):
        shares = [(turn * passes + k) % rounds for k in range(passes)]
        own = texts.where(F.pmod("at", F.lit(rounds)).isin(shares))
        # Dealt by hash and sorted, so that the network follows from the texts alone and not from the table's partitions.
        # Should a cluster deal out more partitions than were asked for, they are put together: each task sends a network.
        own = own.repartition(shards, "at").coalesce(shards).sortWithinPartitions("at", "ids").select("ids")
        sent = context.broadcast(network.flat())

        def learn(batches):
            start = sent.value
            moving, tokens = WindowNetwork.from_flat(start), 0
            for target, near in _token_batches(batches, BATCH):
                moving.step(target, near, LEARNING_RATE)
                tokens += len(target)
            if tokens:
                moved = np.rint((moving.flat().astype(np.float64) - start) * FIXED_POINT / 1024).astype(np.int64)
                weight = max(1, tokens // 1024)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(-1, len(moved)), pa.int32()),
                     pa.array(np.concatenate([[weight], moved * weight]), pa.int64())], ["place", "total"])

        sums = own.mapInArrow(learn, "place int, total long").groupBy("place").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        if not sums:
            continue
        totals = {r["place"]: int(r["total"]) for r in sums}
        step = np.zeros(len(totals) - 1)
        for place, total in totals.items():
            if place >= 0:
                step[place] = total / totals[-1]
        network = WindowNetwork.from_flat(network.flat() + step * 1024 / FIXED_POINT)
    return network


def _totals(rows: list[np.ndarray], own: WindowNetwork) -> np.ndarray:
    totals = np.zeros(len(rows))
    at = 0
    while at < len(rows):  # some texts at a time, so memory follows BATCH and the longest text
        end, held = at, 0
        while end < len(rows) and (held == 0 or held + len(rows[end]) <= BATCH):
            held += len(rows[end])
            end += 1
        target, near, owner = contexts(rows[at:end])
        for k in range(0, len(target), BATCH):
            totals[at:end] += np.bincount(
                owner[k:k + BATCH], weights=own.log_prob(target[k:k + BATCH], near[k:k + BATCH]), minlength=end - at)
        at = end
    return totals


def score(docs: DataFrame, known: dict[bytes, int], network: WindowNetwork) -> DataFrame:
    """One row per input row: doc_id, n_tokens, pll (sum of log-probabilities), pll_mean.

    The network's part alone: of a word without an id, the probability of its
    class. Null, empty and blank texts have no tokens, pll 0 and pll_mean null.
    """
    return _with_mean(_score_ids(encode(docs, known), network))


def _score_ids(coded: DataFrame, network: WindowNetwork) -> DataFrame:
    sent = coded.sparkSession.sparkContext.broadcast(network.flat())

    def run(batches):
        own = WindowNetwork.from_flat(sent.value)
        for batch in slices(batches):
            rows = [np.frombuffer(x, np.int16).astype(np.int64) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array(_totals(rows, own), pa.float64())], ["row", "doc_id", "tail", "n_tokens", "pll"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("row", "doc_id", "tail", "ids").mapInArrow(
        run, f"row long, doc_id {kind}, tail long, n_tokens long, pll double")


def _with_mean(scored: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "pll", mean.alias("pll_mean"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      rounds: int = ROUNDS) -> DataFrame:
    """Train on all rows and score all rows: doc_id, n_tokens, pll, pll_mean.

    Texts are read whole. A word without an id of its own adds the
    log-probability of its class in its context and its own within the class;
    words that are not hot meet their table by 64-bit hash in a shuffle,
    whatever its size. Ids may be null or repeat; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = word_counts(base)
    known = vocabulary(base, counts)
    tail = Scratch(docs.sparkSession, "lm-tail").put(tail_log_probs(counts, known), "tail")
    coded = encode(base, known, hot_words(tail))
    network = _train_ids(coded, rounds)
    rest = coded.select("row", F.explode("rest").alias("key")).join(
        tail.select("key", "logp").hint("shuffle_hash"), "key").groupBy("row").agg(F.sum("logp").alias("more"))
    return _with_mean(_score_ids(coded, network).join(rest, "row", "left").withColumn(
        "pll", F.col("pll") + (F.col("tail") + F.coalesce("more", F.lit(0))) / TAIL_POINT))
