"""The pipeline's stages on a small corpus, each held against its input."""

from collections import Counter

import pytest

import corpus_pipeline
from foliant.llm.queries import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = documents(spark, SF), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_in_order_with_the_columns_of_documents(stages):
    assert [s[0] for s in stages] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    assert all(after.columns == before.columns for _, before, after in stages[:-1])


def test_filters_only_drop_and_keep_clean_rows(spark, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    for _, before, after in stages[:3]:
        b, a = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(a.items()) <= set(b.items())
    kept = {r.doc_id for r in stages[0][2].collect()}
    seen = good & {r.doc_id for r in stages[0][1].collect()}
    assert len(seen & kept) >= 0.98 * len(seen)


def test_one_of_equal_texts_stays(stages):
    before, after = stages[1][1].collect(), stages[1][2].collect()
    assert sorted(r.text for r in after) == sorted({r.text for r in before})


def test_mix_and_pack(stages):
    before, mixed = {r.doc_id: r.text for r in stages[3][1].collect()}, stages[3][2].collect()
    assert all(before[r.doc_id] == r.text for r in mixed) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    packed = stages[4][2].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)
    assert max(r.offset + r.length for r in packed) <= 4096


def test_near_dedup_with_repeated_and_null_ids(spark):
    words = [[f"{c}{i}" for i in range(80)] for c in "abc"]
    copies = [" ".join([*w[:40], "changed", *w[41:]]) for w in words]
    a, b, c = (" ".join(w) for w in words)
    rows = [(1, a), (7, copies[0]), (7, b), (2, c), (None, copies[2]), (None, "without an id"), (None, None), (9, "")]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert kept.columns == ["doc_id", "text"]
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a), (7, b), (2, c), (None, "without an id"), (None, None), (9, "")])
