import os

import public_tokenizers
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_stages(spark):
    """Each stage against its operator on the same input, and the last against the documents that reach it."""
    import corpus_pipeline as c
    from codeloom.llm import bpe, language, queries, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert names == ["language_id", "toxicity", "near_duplicates", "best_fit_packing"]
    judge = language.Judge(queries.language_dictionaries(spark, SF))
    first = c.language_id(spark, docs, SF)
    rows = docs.collect()
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in rows if not judge(r.text)[2]}
    model = queries.toxicity_model(spark, SF)
    assert isinstance(model, toxicity.Model)
    second = c.toxic(spark, first, SF)
    kept = first.collect()
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r, s in zip(kept, model([r.text for r in kept]), strict=True) if s < 0.5}
    third = c.near_duplicates(spark, second, SF)
    import sys

    sys.path.insert(0, os.path.dirname(__file__))
    from test_joins import brute_jaccard

    classes = brute_jaccard([(r.doc_id, r.text) for r in second.collect()])
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == {i for i, (g, _) in classes.items() if g == i}
    packed = c.run(spark, SF).toPandas()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(bpe.read_ranks(open(path, "rb").read()), public_tokenizers.PATTERN)
    ids = {r.doc_id: codec.encode(r.text) for r in third.collect()}
    assert {i: [x for t in g.sort_values("piece").token_ids for x in t] for i, g in packed.groupby("doc_id")} == ids
    assert len(first.collect()) > 0.97 * len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_edges(spark):
    """Nulls, empty and repeated rows, big ids, extra columns with the stages' names, and an empty table, at each stage."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [r.text for r in docs.where("lang = 'en' and n_chars > 300").orderBy("doc_id").limit(3).collect()]
    big = 2**53 + 1
    rows = [(1, clean[0], "en"), (1, clean[0], "en"), (1, clean[2], "en"), (2, None, None), (3, "", "en"), (None, clean[1], None), (None, clean[1], None), (big, clean[0], "en"), (big + 2, clean[1], "en")]
    odd = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, score int, rejected string, kept int")
    first = c.language_id(spark, odd, SF)
    second = c.toxic(spark, first, SF)
    third = c.near_duplicates(spark, second, SF)
    assert first.columns == second.columns == third.columns == odd.columns
    said = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    texts = sorted(((i, t) for i, t, _ in rows if t), key=str)
    assert said(first) == said(second) == texts
    assert said(third) == sorted([(1, clean[0]), (1, clean[2]), (None, clean[1]), (None, clean[1]), (big + 2, clean[1])], key=str)
    assert {r.doc_id for r in c.best_fit_packing(spark, third, SF).collect()} == {1, None, big + 2}
    none = odd.limit(0)
    for _, stage in c.STAGES:
        none_after = stage(spark, none, SF)
        assert none_after.count() == 0
