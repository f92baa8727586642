"""The corpus pipeline: each stage and the whole against brute force, and odd input through every stage."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from gavelyard.llm import ranker, toxicity

from .test_minhash import brute
from .test_texts import brute_substring, without

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def kept_rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_pipeline_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    toxic = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    rows = [(d, t) for d, t in rows if toxic[d] < 0.7]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept_rows(P.drop_toxic(spark, docs, DATA)) == sorted(rows)
    good = {r.doc_id: r.score for r in ranker.score_quality(left, labels).collect()}
    rows = [(d, t) for d, t in rows if good[d] >= 0.5]
    assert kept_rows(P.drop_low_quality(spark, left, DATA)) == sorted(rows)
    groups = brute(rows, 5, 80)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    spans = brute_substring(rows)
    rows = [(d, without(t, spans[d])) for d, t in rows]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        pieces, k = -(-len(ids) // 2048), 0
        for i in range(pieces):
            n = len(ids) - 2048 * (pieces - 1) if i == 0 else 2048
            want.append((d, i, k, n, zlib.crc32(ids[k : k + n].tobytes())))
            k += n
    got = P.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert [name for name, _ in P.STAGES] == ["toxicity", "quality_classifier", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]


LONG = " ".join(f"word{k % 977} goes on and on." for k in range(20_000))
TEXT = "One plain sentence that has more than eight words in it. Another one follows here."
ODD = [(1, None), (2, ""), (3, TEXT), (3, TEXT), (3, "A different text under the same id, which is long enough to be told apart."), (None, TEXT), (None, "Only a null id has this text of several words."), (4, TEXT + " More."), (9, LONG)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "2 as row_number", "3 as bucket", "4 as y")


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]])
def test_odd_input(spark, odd, stage):
    got = stage(spark, odd, DATA)
    assert got.dtypes == odd.dtypes and stage(spark, odd.limit(0), DATA).count() == 0
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    assert all((r.score, r.row_number, r.bucket, r.y) == (1, 2, 3, 4) for r in rows) and {1, 2, 9} <= set(ids) if stage is not P.drop_low_quality else rows
    if stage is P.drop_near_duplicates:
        # of the repeated rows one stays, and every text of its own under a repeated or null id
        assert sorted(t for d, t in ((r.doc_id, r.text) for r in rows) if d in (3, None)) == sorted(x for _, x in {ODD[2], ODD[4], ODD[6]})
    if stage is P.drop_repeated_units:
        left = {}
        for r in rows:
            left.setdefault(r.doc_id, []).append(r.text)
            assert r.n_chars == (None if r.text is None else len(r.text))
        assert len(rows) == len(ODD) and left[1] == [None] and left[2] == [""] and TEXT in left[3] and left[4] == [" Another one follows here. More."]


def test_odd_input_is_packed(spark, odd):
    rows = P.pack(spark, odd, DATA).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in ODD} and P.pack(spark, odd.limit(0), DATA).count() == 0
    assert [(r.length, r.start) for r in rows if r.doc_id in (1, 2)] == [(1, 0), (1, 0)] and sum(r.doc_id == 3 for r in rows) == 3
    assert all(r.length == 2048 for r in rows if r.doc_id == 9 and r.piece)


def test_order_of_partitions_changes_nothing(spark, odd):
    for stage in (P.drop_near_duplicates, P.drop_repeated_units):
        a, b = stage(spark, odd, DATA), stage(spark, odd.orderBy(F.rand(3)).repartition(5), DATA)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
