"""A repeated word of 64 four-byte letters has 256 tokens."""

import hashlib
import random

import public_tokenizers
import tiktoken

from datewise.llm import byte_bpe
from datewise.llm.queries import vocabulary_path


def test_word_of_256_tokens_on_two_rows(spark):
    ranks, text = vocabulary_path("byte_bpe_50k.tiktoken"), "\U00020000" * 64
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(ranks), special_tokens={})
    ids = enc.encode_ordinary(text)
    assert len(ids) == 256
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert [r["ids_sha256"] for r in byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()] == [want] * 2


def test_words_beyond_the_fold(spark):
    """A word of two million bytes and one just beyond the fold's bound, alone and twice."""
    ranks, pattern = vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(ranks), special_tokens={})
    texts = ["abcdefghij" * 220_000, "q" * 513 + " q", "q" * 513 + " q", "é" * 400, "x" * 512]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in byte_bpe.encode_documents(docs, ranks, pattern).collect()}
    for k, text in enumerate(texts):
        # The library takes time with the square of a word's length, so the long word is held to LongWords alone.
        long = len(text) > 100_000
        ids = byte_bpe.LongWords(TOKENS(ranks)).encode(text.encode()) if long else enc.encode_ordinary(text)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def TOKENS(path):
    by_rank = {i: t for t, i in byte_bpe.load_ranks(path).items()}
    return [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]


def test_heap_merges_like_the_library():
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    words = byte_bpe.LongWords(TOKENS(path))
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "th", "e", " ", "ing", "é", "\n", "1", "zz"]) for _ in range(rng.randint(1, 60)))
        # The library takes a word that is itself a token whole.
        ids = enc.encode_ordinary(text)
        assert words.encode(text.encode()) == ids
