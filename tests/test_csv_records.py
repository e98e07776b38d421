"""CSV files cut into records by many tasks, and arithmetic in column expressions, against plain Python."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from entiloom.functions.documents import arithmetic
from entiloom.functions.sums import sum_value
from entiloom.operators import validate
from entiloom.sources import csv_records
from entiloom.sources.manifests import csv_spine, csv_tables


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def written(path, n, seed, end="\n"):
    r = random.Random(seed)
    out = io.StringIO()
    rows = [[str(i), r.choice(["plain", 'say "hi"', "a, b", "two\nlines", '"', "\n\n", "x\r\ny", "", "é" * 9]) * r.choice([1, 1, 3]), r.choice(["", "1.5", "z" * r.randrange(60)])] for i in range(n)]
    rows[n // 2][1] = 'long "field"\n' * 6000  # runs over several blocks
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "note", "x"])
    w.writerows(rows)
    text = out.getvalue().replace(f"{end}7,", f"{end}{end}7,", 1)  # a blank line
    path.write_bytes(text.encode())
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("limit", [csv_records.BLOCKS, 0])
def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_blocks, monkeypatch, end, limit):
    monkeypatch.setattr(csv_records, "BLOCKS", limit)
    rows = written(tmp_path / "big.csv", 3000, 5, end)
    assert csv_records.lines(spark, [str(tmp_path / "big.csv")]).rdd.getNumPartitions() > 8
    got = {r.component_index: r for r in csv_tables(spark, str(tmp_path))["big_comp"].collect()}
    assert sorted(got) == list(range(3000))
    for i, (k, note, x) in enumerate(rows):
        assert (got[i].id, got[i].note, got[i].x) == (int(k), note or None, x or None), i
    (entity,) = csv_spine(spark, str(tmp_path)).collect()
    assert {r.entity_id for r in got.values()} == {entity.value} and entity.entity_key == "big"


def test_quotes_inside_of_plain_fields(spark, tmp_path):
    (tmp_path / "pipes.csv").write_text('id,name\n1,5" pipe\n2, "odd" one\n3,"a ""b"", c"\n4,"5"" pipe\nin two lines"\n')
    got = {r.id: r.name for r in csv_tables(spark, str(tmp_path))["pipes_comp"].collect()}
    assert got == {1: '5" pipe', 2: ' "odd" one', 3: 'a "b", c', 4: '5" pipe\nin two lines'}


def test_sums_equal_plain_python(spark):
    r = random.Random(7)
    texts = ["", " ", "()", "1 2", "(1", "1)", "1*/2", "2*-(3-1)", "1e3 - .5", "4 / 50", "1/0", "0/0", "-(-(2))", "+-+3*2", "((((1+1))))", "1e308*10", "2-3-4", "8/4/2", "1-2*3/4+5", "1.5.2", "1e", "3(4)", "(3)4", "--", "1+", "a+1", "2 e3", "1/(2-2)"]
    texts += ["+".join(["1"] * 3000), "(" * 300 + "1" + ")" * 300, "-" * 500 + "1"]
    texts += ["".join(r.choice(["1", "2.5", "30", ".5", "1e2", "+", "-", "*", "/", "(", ")", " "]) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string").select("i", sum_value(F.col("t")).alias("v"))
    got = {x.i: x.v for x in rows.collect()}
    assert got.pop(-1) is None
    assert [t for i, t in enumerate(texts) if got[i] != arithmetic(t)] == []


def test_no_python_works_out_sums(spark):
    rows = spark.createDataFrame([("a", "(2 + 3) * -4 / (1 - 1)"), ("b", "(2 + 3) * -4"), ("c", "junk"), ("d", "1.5"), ("e", "7 - -1")], "entity_id string, value string")
    out = validate.coerce(rows, [validate.FieldRule("value", "float")])
    assert {r.entity_id: r.value for r in out.collect()} == {"a": None, "b": -20.0, "c": None, "d": 1.5, "e": 8.0}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
