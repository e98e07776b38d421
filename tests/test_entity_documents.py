"""The data source of entity documents: files written, read in groups, and picked up by a stream."""

import pytest

from entiloom.sources import entity_documents
from entiloom.sources.manifests import flat_documents, read_files

DOCS = [(f"a/{i}.yaml", f"ship{i}:\n    data:\n        - size: {i}\n    mast:\n        - tall\n") for i in range(7)]
DOCS += [("a/b/m.py", '"""Text.\n\nComponents\n----------\n- rank: 3\n"""\n'), ("empty.yml", ""), ("odd name, é.yaml", "boat:\n    - note: 'ü: 1'\n"), ("a/no.txt", "- : :")]


def rows(df):
    return sorted(map(str, df.collect()))


def test_files_are_written_and_read_in_groups(spark, tmp_path):
    entity_documents.register(spark)
    folder = str(tmp_path / "docs")
    given = spark.createDataFrame([*DOCS, ("null.yaml", None)], "file_id string, text string")
    given.withColumn("more", given.text).write.format("entity_documents").mode("append").save(f"file:{folder}")
    given.filter("file_id = 'a/0.yaml'").write.format("entity_documents").mode("append").save(folder)  # again: one file still
    source = lambda **o: spark.read.format("entity_documents").options(base=folder, **o).load(folder)
    text = source(form="text")
    assert sorted((r.file_id, r.text) for r in text.collect()) == sorted([*[d for d in DOCS if not d[0].endswith(".txt")], ("null.yaml", "")])
    assert rows(source()) == rows(flat_documents(text)) and source().filter("kind = 'pair'").count() == 17  # seven twice, two of the module, the boat's
    assert source(bytes=100).rdd.getNumPartitions() > source().rdd.getNumPartitions() == 1 and rows(source(bytes=100)) == rows(source())
    plain = spark.read.format("entity_documents").option("form", "text").load(f"{folder}/a")
    spark_files = read_files(spark, [f"{folder}/a"], (".yaml",), "yaml").unionByName(read_files(spark, [f"{folder}/a"], (".py",), "python"))
    assert rows(plain) == rows(spark_files)
    assert spark.read.format("entity_documents").load(f"{folder}/a/0.yaml").filter("kind = 'pair'").count() == 2
    (tmp_path / "none").mkdir()
    assert spark.read.format("entity_documents").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("entity_documents").load(str(tmp_path / "missing")).count()
    with pytest.raises(Exception, match="no name of a file"):
        spark.createDataFrame([("../x.yaml", "")], "file_id string, text string").write.format("entity_documents").mode("append").save(folder)


def test_a_stream_takes_new_and_changed_files(spark, tmp_path):
    entity_documents.register(spark)
    folder, out, at = (str(tmp_path / n) for n in ("docs", "out", "checkpoint"))
    put = lambda *docs: spark.createDataFrame(list(docs), "file_id string, text string").write.format("entity_documents").mode("append").save(folder)
    put(("a.yaml", "x:\n    - size: 1\n"), ("b.yaml", "y:\n    - size: 2\n"))

    def run():
        stream = spark.readStream.format("entity_documents").options(base=folder, settle="0").load(folder)
        query = stream.filter("kind = 'pair'").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.file_id, r.value) for r in spark.read.parquet(out).collect())

    first = [("a.yaml", "1"), ("b.yaml", "2")]
    assert run() == first
    put(("b.yaml", "y:\n    - size: 5\n"), ("c.yaml", "z:\n    - size: 3\n"))
    assert run() == [*first, ("b.yaml", "5"), ("c.yaml", "3")]
