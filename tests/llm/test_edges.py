"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from datewise.llm import (byte_bpe, exact_dedup, exact_topk, jaccard_join, language_id, lm_scoring, packing,
                          secret_scan, token_count, token_files)
from datewise.llm.queries import vocabulary_path

from .conftest import TEXTS, as_set

RANKS = vocabulary_path("byte_bpe_50k.tiktoken")


def test_exact_dedup(odd_docs, no_docs):
    got = as_set(exact_dedup.exact_dedup(odd_docs).where("group_size > 1"), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (4, 5, 2, False), (5, 5, 2, True), (7, 8, 2, False), (8, 8, 2, True)]
    assert exact_dedup.exact_dedup(odd_docs).count() == len(TEXTS)
    beyond = exact_dedup.exact_dedup(odd_docs, broadcast_bytes=0)
    assert as_set(beyond.na.fill(-1), "doc_id", "keep_id", "text_sha256") == as_set(
        exact_dedup.exact_dedup(odd_docs).na.fill(-1), "doc_id", "keep_id", "text_sha256")
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    again = exact_dedup.exact_dedup(odd_docs.where("doc_id = 1").union(odd_docs.where("doc_id = 1")))
    assert as_set(again, "doc_id", "keep_id", "group_size", "kept") == [(1, 1, 2, True)] * 2


def test_secret_scan(odd_docs, no_docs):
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
           for r in secret_scan.secret_scan(odd_docs).collect() if r["spans"]}
    text = dict(TEXTS[:11])
    assert got == {
        9: [("assign", 0, 18), ("access", 23, 43), ("hex", 49, 81)],
        10: [("assign", text[10].index("password"), text[10].index("99") + 2)]}
    assert secret_scan.secret_scan(no_docs).count() == 0
    assert secret_scan.secret_scan(odd_docs, broadcast_bytes=0).where("size(spans) > 0").count() == 2
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(secret_scan.secret_scan(odd_docs)).collect()}
    assert masked[9] == "[SECRET] and [SECRET] then [SECRET]"
    assert masked[11] == "1234 5678 !!! ---"


def test_trigram_queries():
    access, hexa = (secret_scan.trigram_query(r.pattern) for r in secret_scan.BASE_RULES[1:])
    assert access == {frozenset({"aki", "kia"})} and not hexa
    assign = secret_scan.trigram_query(secret_scan.BASE_RULES[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in assign and len(assign) == 6
    assert not secret_scan.trigram_query("ab|cdef") and not secret_scan.trigram_query("[a-z]+")


@pytest.mark.parametrize("words", [3, 5])
def test_jaccard(odd_docs, no_docs, words):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"]
           for r in jaccard_join.similar_components(odd_docs, words, 90).collect()}
    n = 12 - words + 1
    assert got[1, n] == got[2, n] == got[3, n] == 1 and got[7, 1] == got[8, 1] == 7
    assert got[4, 0] == 4 and got[5, 0] == 5 and got[6, 0] == 6
    assert got[12, 30_000 - words + 1] == 12 and sum(i is None for i, _ in got) == 1
    assert jaccard_join.similar_components(no_docs).count() == 0


def test_jaccard_large_group_of_near_copies(spark):
    """Chains and stars of near copies around shared passages, against all pairs."""
    from .test_against_brute_force import components

    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(4000)]
    shared = rng.choice(vocabulary, 60).tolist()
    items = []
    base = rng.choice(vocabulary, 240).tolist()
    for i in range(150):
        copy = list(base)
        for at in rng.choice(len(copy), int(rng.integers(0, 9)), replace=False):
            copy[at] = f"edit{i}-{at}"
        items.append((i, " ".join(copy)))
    chain = rng.choice(vocabulary, 200).tolist()
    for i in range(150, 180):  # each differs a little from the one before
        chain = list(chain)
        chain[int(rng.integers(200))] = f"c{i}"
        items.append((i, " ".join(chain)))
    for i in range(180, 240):
        items.append((i, " ".join(rng.choice(vocabulary, 100).tolist() + shared)))
    want = components(items, 3, 90)
    docs = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs, 3, 90).collect()}
    assert got == want


def test_byte_bpe(odd_docs, no_docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    want = sorted((len(enc.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in TEXTS)
    for size in (0, 200_000):
        got = byte_bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN, dictionary_words=size)
        assert as_set(got, "n_tokens", "decoded_sha256") == want
    assert byte_bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", [
    "don't we'll I'D it's  two   spaces \n\n tabs\t\tend  ", "\x1c\x1d\x1e\x1f \x85\xa0 x ​", "́a \U0001F468‍\U0001F469 ½ ² ٣",
    "<|endoftext|> a<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 70 + "\r\n" + "-" * 33])
def test_byte_bpe_odd_characters(spark, text):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    ids = enc.encode_ordinary(text)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).first()
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert token_files.PieceEncoder(path, public_tokenizers.PATTERN)([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(odd_docs, path, vocabulary_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2, shard_chars=50_000)
    got = token_files.read_tokens(spark, path).collect()
    assert len(got) == len(TEXTS) and sum(r["doc_id"] is None for r in got) == 1
    ordered = sorted(got, key=lambda r: r["start"])
    assert ordered[0]["doc_id"] is None and [r["doc_id"] for r in ordered[1:]] == sorted(i for i, _ in TEXTS if i is not None)
    at = 0
    for r in ordered:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    assert spark.read.parquet(path).count() > 1
    every = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in ordered])
    for a, b in ((0, 5), (at // 3, at // 3 + 1000), (at - 3, at), (at, at + 5)):
        span = sorted((r["place"], r["id"]) for r in token_files.read_span(spark, path, a, b).collect())
        assert span == [(k, int(every[k])) for k in range(a, min(b, at))]
    token_files.write_tokens(no_docs, f"{path}-none", vocabulary_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2)
    assert token_files.read_tokens(spark, f"{path}-none").count() == 0


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["x", "a<|endoftext|>b  c", "", "<|endoftext|>", "plain  text", "<|endoftext|><|endoftext|> <|endoftext", "y"]
    got = token_files.PieceEncoder(path, public_tokenizers.PATTERN)(texts)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in got[1]


def test_numbers_are_no_letters():
    for text in ("½ ²", "① Ⅷ", "12 _ ,", ""):
        assert not len(language_id.ngrams(text))
    assert len(language_id.ngrams("½ é"))


def test_directly_addressable_codes():
    rng = np.random.default_rng(2)
    for high in (1, 200, 70_000, 2 ** 31):
        ids = rng.integers(0, high, 5000)
        codes = token_files.DirectlyAddressableCodes.from_binary(
            len(ids), *token_files.DirectlyAddressableCodes.encode(ids).to_binary())
        assert [codes[i] for i in (0, 511, 512, 513, 4999)] == ids[[0, 511, 512, 513, 4999]].tolist()
        for a, b in ((0, 5000), (7, 8), (511, 1030), (9, 9), (4000, 5000)):
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()
    assert token_files.DirectlyAddressableCodes.encode(np.array([], dtype=int)).slice(0, 0).tolist() == []


def test_language_id(spark, odd_docs, no_docs):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)],
                                  "text string, lang string")
    profiles = language_id.language_profiles(train)
    assert set(profiles) == {"en", "de"}
    got = language_id.identify(odd_docs, profiles)
    assert got.count() == len(TEXTS)
    assert {r["doc_id"] for r in got.where("lang_pred = 'und' AND score = 0").collect()} == {4, 5, 6, 11}
    assert language_id.identify(no_docs, profiles).count() == 0
    assert language_id.language_profiles(odd_docs) == {}
    assert language_id.identify(odd_docs, {}).where("lang_pred <> 'und'").count() == 0


def test_packing(odd_docs, no_docs):
    got = packing.pack(odd_docs, buckets=3, token_budget=20, keep=("n", "kept"))
    rows = got.collect()
    assert len(rows) == len(TEXTS) and len({(r["batch_id"], r["slot"]) for r in rows}) == len(TEXTS)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0} and max(r["n_tokens"] for r in rows) == 30_000
    assert packing.pack(no_docs).count() == 0


def test_token_counts(odd_docs, no_docs):
    got = token_count.token_counts(odd_docs, RANKS)
    assert got.count() == len(TEXTS) and as_set(got.where("doc_id IN (4, 5, 6)"), "n_words", "n_tokens") == [(0, 0)] * 3
    assert token_count.token_counts(no_docs, RANKS).count() == 0
    automaton = token_count.LongestMatchAutomaton([b"a", b"b", b"ab", b"abcde", b"cd"])
    assert automaton.count(b"abcdf") == (3, 1) and automaton.count(b"abcdeab") == (2, 0) and automaton.count(b"") == (0, 0)


def test_topk(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, []), (None, [9.0, 9.0]), (50, [1.0, 0.5]), (51, [1.0, 0.5, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    for shard in (2, 4096):
        got = as_set(exact_topk.exact_topk(df, F.col("vec_id") % 50 == 0, shard_vectors=shard), "query_id", "rank", "vec_id", "score")
        s = 256 * 256 + 128 * 128
        assert got == [(0, 1, 1, s), (0, 2, 50, s), (0, 3, 2, -256 * 256), (50, 1, 0, s), (50, 2, 1, s), (50, 3, 2, -256 * 256)]
    assert exact_topk.exact_topk(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    data = rng.integers(-3, 4, (700, 6)) / 4
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = exact_topk.exact_topk(df, F.col("vec_id") % 7 == 0, shard_vectors=90, query_block=40).collect()
    q = np.floor(data * 256).astype(np.int64)
    want = []
    for i in range(0, 700, 7):
        scores = q @ q[i]
        order = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    assert sorted(map(tuple, got)) == want


def test_lm_scoring(odd_docs, no_docs):
    got = lm_scoring.pseudo_likelihood(odd_docs)
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    assert all(r["pll"] == 0 and r["pll_mean"] is None for r in rows if r["doc_id"] in (4, 5, 6))
    assert all(r["pll"] < 0 for r in rows if r["n_tokens"])
    assert lm_scoring.pseudo_likelihood(no_docs).count() == 0


def test_components_of_paths_and_hubs(spark, monkeypatch):
    """A path over many partitions, a hub and pairs, with forests that are cut often."""
    from datewise.llm.common import Scratch

    monkeypatch.setattr(jaccard_join, "FOREST_NODES", 3)
    name = lambda i: i.to_bytes(4, "big")
    links = [(i, i + 1) for i in range(0, 120)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 900), (7, 7)]
    df = spark.createDataFrame([(bytearray(name(b)), bytearray(name(a))) for a, b in links], "a binary, b binary").repartition(5)
    got = {bytes(r["node"]): bytes(r["label"]) for r in jaccard_join.connected_components(Scratch(spark, "paths"), df, "t").collect()}
    want = {name(i): name(0) for i in range(1, 121)} | {name(i): name(500) for i in range(501, 560)} | {name(901): name(900)}
    assert got == want
