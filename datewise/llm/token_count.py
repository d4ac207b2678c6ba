"""Greedy longest-match token counts by a linear automaton.

A trie of the vocabulary gets failure links; every node knows how many tokens
are popped when its link is followed. A word is counted in one pass over its
bytes, whatever the vocabulary, and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Distinct words whose counts a task remembers; the memory is emptied beyond it.
CACHE_WORDS = 200_000


def load_tokens(path: str) -> list[bytes]:
    """Tokens of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatchAutomaton:
    """Counts greedy longest-match tokens of byte strings.

    `missing` in count()'s result is the number of bytes that no token covers;
    each is counted as one token of its own.
    """

    def __init__(self, tokens: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            node = 0
            for b in token:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = len(children)
                    children[node][b] = nxt
                    children.append({})
                    final.append(False)
                node = nxt
            if node:
                final[node] = True
        n = len(children)
        link, pops = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, node in children[parent].items():
                queue.append(node)
                if final[node]:
                    link[node], pops[node] = 0, 1
                    continue
                # The longest token before this byte is what the parent pops; carry on until the byte fits.
                at, popped = link[parent], pops[parent]
                while at >= 0 and b not in children[at]:
                    popped += pops[at]
                    at = link[at]
                if at >= 0:
                    link[node], pops[node] = children[at][b], popped
        self.children, self.link, self.pops = children, link, pops

    def count(self, data: bytes) -> tuple[int, int]:
        """(tokens, missing bytes among them) of one string."""
        children, link, pops = self.children, self.link, self.pops
        tokens = missing = node = i = 0
        n = len(data)
        while i < n:
            nxt = children[node].get(data[i])
            if nxt is not None:
                node, i = nxt, i + 1
                continue
            if node and link[node] >= 0:
                tokens += pops[node]
                node = link[node]
                continue
            if node == 0:
                tokens, missing, i = tokens + 1, missing + 1, i + 1
                continue
            return self._slow(data)
        while node:
            if link[node] < 0:
                return self._slow(data)
            tokens += pops[node]
            node = link[node]
        return tokens, missing

    def _slow(self, data: bytes) -> tuple[int, int]:
        """Plain longest match, for vocabularies that lack some single bytes."""
        tokens = missing = at = 0
        while at < len(data):
            node, end, i = 0, 0, at
            while i < len(data) and (node := self.children[node].get(data[i], -1)) >= 0:
                i += 1
                if self.link[node] == 0 and self.pops[node] == 1:
                    end = i
            if end:
                at = end
            else:
                missing, at = missing + 1, at + 1
            tokens += 1
        return tokens, missing


_AUTOMATA: dict[str, LongestMatchAutomaton] = {}


def _automaton(path: str) -> LongestMatchAutomaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = LongestMatchAutomaton(load_tokens(path))
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens, n_missing.

    Words are the runs between ASCII white space; each is matched with a leading
    space, as the vocabulary's word-initial tokens have it. Null, empty and
    blank texts have 0 words and 0 tokens. Texts are read whole, of any length.
    Null or repeated ids pass through. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """

    def count(batches):
        automaton, known = _automaton(vocabulary_path), {}
        for batch in slices(batches):
            n_words, n_tokens, n_missing = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                tokens = missing = 0
                for w in words:
                    got = known.get(w)
                    if got is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        got = automaton.count(b" " + w)
                        if len(w) <= 64:
                            known[w] = got
                    tokens += got[0]
                    missing += got[1]
                n_words.append(len(words))
                n_tokens.append(tokens)
                n_missing.append(missing)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array(n_missing, pa.int64())], ["doc_id", "n_words", "n_tokens", "n_missing"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_words long, n_tokens long, n_missing long")
