from entiloom.plans.registrar import Registrar
from entiloom.streaming.updates import append_versions, current_versions, update_registry


def test_versions_may_arrive_in_any_order(spark, tmp_path):
    schema = "entity_id string, component_index bigint, x int, t int"
    source, history = str(tmp_path / "in"), str(tmp_path / "history")
    for batch in ([("a", 0, 2, 2), ("b", 0, 7, 1)], [("a", 0, 1, 1)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        append_versions(stream, history, str(tmp_path / "checkpoint")).awaitTermination(60)
    rows = spark.read.schema(schema).parquet(history)
    assert rows.count() == 3
    assert sorted((r.entity_id, r.x) for r in current_versions(rows, "t").collect()) == [("a", 2), ("b", 7)]


def test_documents_of_a_stream_update_a_registrar(spark, tmp_path):
    user = Registrar(spark)
    user.update(yaml={"types.yaml": "position:\n    - component_type\n    - field:\n        x: {type: int}\n        t: {type: int, time_dimension: true}\n"}, time=0)
    source = str(tmp_path / "in")
    spark.createDataFrame([("a.yaml", "ship:\n    - position: {x: 4}\n"), ("b.yaml", "boat:\n    - position: {x: 5}\n")], "file_id string, text string").write.parquet(source)
    stream = spark.readStream.schema("file_id string, text string").parquet(source)
    update_registry(stream, user, str(tmp_path / "checkpoint")).awaitTermination(300)
    assert sorted((r["entity_id.alias"], r["position.x"]) for r in user.view_current("position").collect()) == [("boat", 5), ("ship", 4)]
