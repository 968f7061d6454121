"""The pipeline's stages against what the operators decide, on a fixture."""

from collections import Counter

import corpus_pipeline
from tests_llm_fixture import write_tables


def test_stages(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        ids.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert [sorted(x) for x in ids] == [[1, 2, 3, 4, 5, 6], [1, 3, 4, 5, 6], [1, 3, 4, 5, 6], [1, 3, 4, 6], [1, 3, 4, 6]]
    final = {r.doc_id: r for r in docs.collect()}
    assert final[4].decoded.count("\n") == 0 and len(final[1].ids) == final[1].n_tokens
