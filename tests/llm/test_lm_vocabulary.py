"""Words beyond those with an id of their own are predicted one by one."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from datewise.llm import lm_scoring as lm


def test_rare_words_of_one_class_differ(spark):
    head = " ".join(f"h{i} h{i} h{i} h{i} h{i} h{i}" for i in range(lm.SIDE * lm.SIDE))
    one = [w for w in (f"rare{i}" for i in range(5000)) if lm.TokenIds.of(w.encode()) == 7][:3]
    rows = [(0, head), (1, one[0])] + [(2, one[1])] * 5 + [(3, one[2] + " " + one[1])]
    got = {r["doc_id"]: r["pll"] for r in lm.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] > got[1] + 1


def test_tail_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = lm.word_counts(docs)
    known = lm.vocabulary(docs, counts)
    texts = docs.toPandas()
    n = Counter(w for t in texts.text for w in lm.words_of(t))
    assert counts.count() == len(n)
    tail = {w: k for w, k in n.items() if w not in known}
    assert len(tail) > 50_000
    table = {r["key"]: r["logp"] / lm.TAIL_POINT for r in lm.tail_log_probs(counts, known).collect()}
    assert len(table) == len(tail)
    words = spark.createDataFrame([(bytearray(w),) for w in tail], "word binary").selectExpr("word", "xxhash64(word) AS key")
    logp = {bytes(r["word"]): table[r["key"]] for r in words.collect()}
    follow, kinds = defaultdict(Counter), defaultdict(list)
    for w in tail:
        s = b"\n\n" + w + b"\n"
        for a, b, c in zip(s, s[1:], s[2:]):
            follow[a, b][c] += 1
        kinds[lm.TokenIds.of(w)].append(w)
    for group, own in kinds.items():
        size = sum(tail[w] for w in own)
        left = 1 - sum(tail[w] - lm.DISCOUNT for w in own if tail[w] >= lm.MIN_COUNT) / size
        for w in own[:20]:
            s = b"\n\n" + w + b"\n"
            spelt = np.prod([(follow[a, b][c] + 1) / (follow[a, b].total() + 256) for a, b, c in zip(s, s[1:], s[2:])])
            p = (tail[w] - lm.DISCOUNT if tail[w] >= lm.MIN_COUNT else 0) / size + left * spelt
            assert logp[w] == pytest.approx(np.log(p), rel=1e-5)
        assert 0.3 < sum(np.exp(logp[w]) for w in own) <= 1
    whole = {r["doc_id"]: r["pll"] for r in lm.pseudo_likelihood(docs).collect()}
    part = {r["doc_id"]: r["pll"] for r in lm.score(docs, known, lm.train(docs, known)).collect()}
    for i, t in zip(texts.doc_id[:50], texts.text):
        assert whole[i] - part[i] == pytest.approx(sum(logp[w] for w in lm.words_of(t) if w in tail), rel=1e-4, abs=0.01)


def test_registered_training_learns_and_ignores_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = lm.vocabulary(docs)
    net = lm.train(docs.repartition(200), known)
    assert np.array_equal(net.flat(), lm.train(docs.repartition(1), known).flat())
    start = lm.WindowNetwork.start()
    assert np.abs(net.embed - start.embed).max() > 0.05
    got, blank = (lm.score(docs, known, x).toPandas() for x in (net, start))
    assert got.pll.sum() / got.n_tokens.sum() > blank.pll.sum() / blank.n_tokens.sum() + 0.5
    rng = np.random.default_rng(3)
    texts = docs.toPandas()
    texts["text"] = [" ".join(rng.permutation((t or "").split())) for t in texts.text]
    assert got.pll.sum() > lm.score(spark.createDataFrame(texts), known, net).toPandas().pll.sum()
