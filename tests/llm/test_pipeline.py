import corpus_pipeline as P
import pytest
from fixtures import documents, texts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("step", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_take_anything(spark, step):
    for rows in (texts(), []):
        docs = documents(spark, rows)
        out = step(spark, docs, SF)
        n = out.count()
        if step is not P.best_fit_packing:
            assert out.columns == docs.columns and out.schema == docs.schema
            assert n <= len(rows)
        assert n or not rows


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.stage(P.ngram_jaccard(spark, docs, SF))
    groups = P.near_duplicates(docs).select("component_id").distinct().count()
    assert kept.count() == groups
    again = P.near_duplicates(kept)
    assert again.where("doc_id <> component_id").isEmpty()
    leaky = P.decontamination(spark, docs, SF)
    assert P.find_leaks(leaky, P.build_indexes(P.table(spark, SF, "benchmark"))).where("n_items > 0").isEmpty()
    cut = P.substring_dedup(spark, kept, SF)
    assert cut.count() == kept.count()
    same = P.dedup_words(kept).where("n_removed = 0").select("doc_id")
    before, after = (df.join(same, "doc_id").select("doc_id", "text") for df in (kept, cut))
    assert before.exceptAll(after).isEmpty()


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and out.where("offset + length > 1024").isEmpty()
