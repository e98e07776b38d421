"""Many documents in one file, and documents of many entities: all tasks parse, and no task holds a large one as objects."""

import tracemalloc

import pytest
import yaml
from pyspark.sql import functions as F

from entiloom.functions.documents import flat_rows, flatten, separable
from entiloom.sources import entity_documents
from entiloom.sources.manifests import flat_documents

TEXTS = {
    "nested": "a:\n  data:\n  - x: {k: 1}\n  - y of: [1, 2]\n  - t\n  b:\n  - z: {m: {q: 1}, n: {q: }}\n  c: {}\n  d: 5\n  e:\n    f: []\n1:\n- x\n",
    "data is a mapping": "a:\n  data: {x: 1, y: 2}\n  b: [c]\n", "data is null": "a:\n  data:\n  b: [c]\n", "data above": "data:\n  data: [x]\n  c: [y]\n", "flow": "{a: {data: [{x: 1}], b: [y]}, c: [z]}",
}
WHOLE = {
    "key twice": "a: [x]\nb: [y]\na: [z]\n", "keys are equal": "1: [x]\n01: [y]\n", "data twice": "a:\n  data: [x]\n  data: [y]\n", "data behind": "a:\n  b: [c]\n  data: [x]\n",
    "anchor": "a: &n\n- x\nb: *n\n", "merged": "a: &n {c: [x]}\nb:\n  <<: *n\n", "tag": "a: !!set {x: }\nb: [y]\n", "list": "- a\n", "empty": "", "value key": "=: [x]\n",
}
OWN = {"tab": "a:\n- x: 'b\tc'\n", "byte order mark": "a: [x]\nb: [\"\ufeff\"]\n", "its own line": "\n\ufeff", "block": "a: [y]\nb:\n- x: |#\n"}


def whole(text):
    found = yaml.safe_load(text)
    return flatten("f", found if isinstance(found, dict) else {})


@pytest.mark.parametrize("text", [*TEXTS.values(), *WHOLE.values()], ids=[*TEXTS, *WHOLE])
def test_pieces_give_the_rows_of_the_whole(text):
    assert list(flat_rows("f", "yaml", text, large=0)) == list(flat_rows("f", "yaml", text)) == whole(text)
    assert (separable(text) is not None) == (text in TEXTS.values())


@pytest.mark.parametrize("text", [*OWN.values(), "a: [", "a: [x]\n---\nb: [y]\n"])
def test_documents_mean_what_yaml_says_of_them(text):
    try:
        want = whole(text)
    except yaml.YAMLError as e:
        for large in (0, 1 << 20):
            with pytest.raises(type(e)):
                list(flat_rows("f", "yaml", text, large))
    else:
        assert list(flat_rows("f", "yaml", text, large=0)) == list(flat_rows("f", "yaml", text)) == want


def test_a_large_document_is_not_held_as_objects():
    text = "land:\n    town:\n        data:\n            - rank: 1\n" + "".join(f"        house{i}:\n            - cents: '{i}'\n            - kept\n" for i in range(30_000))
    assert len(text) > 1 << 20
    tracemalloc.start()
    n = sum(1 for _ in flat_rows("f", "yaml", text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 + 1 + 3 * 30_000 and peak < 8 * len(text)


def test_documents_of_one_file_are_parsed_by_all_tasks(spark):
    docs = spark.range(400).coalesce(1).select(F.format_string("%d.yaml", "id").alias("file_id"), F.lit("yaml").alias("kind"), F.format_string("e%d:\n- x: %d\n", "id", "id").alias("text"))
    rows = flat_documents(docs)
    tasks = {r.p: r.n for r in rows.filter("kind = 'pair'").groupBy(F.spark_partition_id().alias("p")).count().withColumnRenamed("count", "n").collect()}
    assert len(tasks) == 4 and max(tasks.values()) < 200 and sum(tasks.values()) == 400


def test_many_small_files_are_read_and_written_by_several_tasks(spark, tmp_path):
    entity_documents.register(spark)
    docs = spark.range(2000).select(F.format_string("d/%d.yaml", "id").alias("file_id"), F.format_string("e%d:\n- x: %d\n", "id", "id").alias("text"))
    docs.write.format("entity_documents").mode("append").save(str(tmp_path / "docs"))
    rows = spark.read.format("entity_documents").load(str(tmp_path / "docs"))
    assert rows.rdd.getNumPartitions() == 2 and rows.filter("kind = 'pair'").count() == 2000  # some 1,000 files a task, small as they are
