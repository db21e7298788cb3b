from collections import Counter

import corpus_pipeline
from llm_data import DATA
from spanloom.llm import registry
from spanloom.session import table

SF = f"{DATA}/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    n = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        n[name] = docs.count()
        if k < 3:
            assert Counter(map(tuple, docs.collect())) <= Counter(map(tuple, before.collect()))
        if name == "language_id":
            assert n[name] >= 0.95 * n["quality_rules"]
        if name == "quality_rules":
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            good = [i for i, q in labels.items() if q]
            assert sum(i in kept for i in good) >= 0.9 * len(good) and not any(i in kept for i, q in labels.items() if not q)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "mixing", "sentencepiece"]
    assert docs.where("not round_trip").count() == 0


def test_run_equals_its_stages(spark):
    a = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect())
    b = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert a == b and a


def test_one_query_for_each_operator():
    names = registry.queries()
    assert sorted(int(x[2:].split("_")[0]) for x in names if x.startswith("op")) == list(range(1, 11)) and "pipeline" in names
