"""The pipeline's stages keep their promises on a small folder of tables."""

import corpus_pipeline
from palimpsest.llm import queries

from .data import documents


def test_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in documents()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int(i % 4 == 0)) for i, r in enumerate(documents()) if i < 20]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "mixing sources", "best-fit packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
