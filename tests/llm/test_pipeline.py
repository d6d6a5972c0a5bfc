import corpus_pipeline
from tests.llm.conftest import SMALL


def test_stages_keep_the_columns_of_documents(spark, small_docs):
    docs = small_docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= {r.doc_id for r in small_docs.select("doc_id").collect()}
