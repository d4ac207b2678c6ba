import pandas as pd
import regex

import corpus_pipeline as P

from .test_against_brute_force import components


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    left = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(P.STAGES):
        stage(spark, left, sf_dir).write.parquet(f"{tmp_path}/{n}")
        left = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = left.toPandas()
        if n < 4:
            assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    lang = seen["language_id"]
    assert set(lang.doc_id) == {i for i, t in zip(docs.doc_id, docs.text) if t and regex.search(r"\p{L}", t)}
    exact = seen["exact_dedup"]
    assert set(exact.doc_id) == set(lang.groupby("text").doc_id.max())
    near = seen["near_dedup"]
    assert set(near.doc_id) == {c for _, c in components(list(zip(exact.doc_id, exact.text)), 5, 80).values()}
    masked = seen["mask_secrets"]
    assert set(masked.doc_id) == set(near.doc_id) and masked.text.str.contains(r"\[SECRET\]").any()
    assert not masked.text.str.contains(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}").any()
    assert (masked.text.str.len() == masked.n_chars).all()
    assert sorted(seen["packing"].doc_id) == sorted(masked.doc_id)
    assert P.run(spark, sf_dir).count() == len(masked)


def test_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for k, docs in enumerate((odd_docs, no_docs)):
        for n, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}-{n}")


A = " ".join(f"w{i}" for i in range(60))
NEAR_A = A + " tail"
B, C = "some other clean words of their own here", "yet another text without any copy at all"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA).repartition(3)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_copies_row_by_row(spark):
    rows = [(None, A, "x"), (None, A, "y"), (None, B, "x"), (None, B, "x"), (5, A, "x"), (5, C, "x"), (9, A, "x"),
            (7, "", "x"), (8, None, "x"), (3, "same", "x"), (3, "same", "y")]
    got = left(P.drop_exact_copies(spark, frame(spark, rows), ""))
    assert got == sorted([(9, A), (None, B), (5, C), (8, None), (3, "same")], key=str)


def test_near_copies_row_by_row(spark):
    rows = [(None, A, "x"), (4, NEAR_A, "x"), (4, C, "x"), (6, A, "x"), (6, B, "x"), (None, "p q r s t u v w", "x"),
            (None, "p q r s t u v w x", "x"), (1, None, "x"), (2, "", "x")]
    got = left(P.drop_near_copies(spark, frame(spark, rows), ""))
    assert [x for x in got if x[0] is not None] == sorted([(4, NEAR_A), (4, C), (6, B), (1, None), (2, "")], key=str)
    assert sum(x[0] is None for x in got) == 1


def test_ties_of_the_smallest_id(spark):
    got = left(P.drop_near_copies(spark, frame(spark, [(1, A, "x"), (1, NEAR_A, "x"), (2, A + " end", "x")]), ""))
    assert len(got) == 1 and got[0][0] == 1


def test_secrets_keep_rows_that_share_an_id(spark):
    rows = [(None, "token = abcdefgh12", "x"), (3, None, "y"), (3, "password: hunter22xx", "z"), (3, "clean", "z")]
    got = sorted(((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in P.mask_secrets(spark, frame(spark, rows), "").collect()), key=str)
    assert got == sorted([(None, "[SECRET]", "x", 8), (3, None, "y", None), (3, "[SECRET]", "z", 8), (3, "clean", "z", 5)], key=str)
