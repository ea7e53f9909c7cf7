from textloom.operators.findings import text_metrics
from textloom.streaming import documents


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"a b{i}.\n\n- **c**: d。e。") for i in range(20)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(rows, documents.DOCUMENT)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, plan in (("metrics", documents.metrics), ("sentences", documents.sentences), ("structure", documents.structure)):
        stream = plan(documents.read_documents(spark, str(tmp_path / "in"), files_per_trigger=1))
        documents.write_to(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        got, want = spark.read.parquet(str(tmp_path / name)), plan(docs)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count()
    again = documents.write_to(documents.metrics(documents.read_documents(spark, str(tmp_path / "in"))), str(tmp_path / "metrics"), str(tmp_path / "metrics-state"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == text_metrics(docs).count()
