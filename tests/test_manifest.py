import json

import pytest

from entiloom import cli
from entiloom.functions.documents import arithmetic, docstring_parts, flatten, parse_python, parse_yaml
from entiloom.plans import registrar
from entiloom.plans.registrar import Registrar
from entiloom.sources.manifests import apart, csv_tables, flat_documents, raw_documents
from entiloom.sources.tables import collected, load_jdbc, save_jdbc

MANIFEST = """
goal:
    data:
        - description: "  keep plants alive \\n"
        - requirement: 1
    water:
        - requirement: 0.5
        - alias: water
    light:
        - requirement
robot:
    data:
        - solution of: goal
        - system
    pump:
        - parent: task
        - solution of: goal.water
        - status: in progress
        - effort:
            - 8
            - {value: 2, schedule: weekly}
        - todo: fix the leak
    lamp:
        - effort: 4 / 8
plant:
    - description: A plant.
    - component_type
    - field:
        value: {type: float, nullable: false}
        kind: {type: str, range: [moss, fern], default: moss}
        asked: {type: entity_ref}
shrub:
    - parent: plant
    - component_type
    - field:
        height: {type: int}
pots:
    one:
        - plant: 3
    two:
        - plant: {value: "1 / 4", kind: cactus, asked: pots.one}
        - shrub: {value: 2, height: "2.5"}
empty:
"""


@pytest.fixture(scope="module")
def reg(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("manifest")
    (d / "garden.yaml").write_text(MANIFEST)
    (d / "users.csv").write_text("user_id,name,since\n1,Ann,2023-01-02\n2,Bo,2024-05-06\n")
    (d / "mod.py").write_text('"""A module.\n\nComponents\n----------\n- requirement: 0.25\n"""\nclass A:\n    """Class."""\n')
    (d / "bad.py").write_text("def (")
    return Registrar.from_manifest(spark, str(d))


def by_key(reg, table):
    spine = reg.get("entity_id").selectExpr("value as entity_id", "entity_key")
    return [r.asDict() for r in reg.get(table).join(spine, "entity_id").collect()]


def test_spine_and_flags(reg):
    alias = {r.entity_key: r.alias for r in reg.get("entity_id").filter("filepath like '%garden.yaml'").collect()}
    assert alias["water"] == "goal.water" and alias["goal"] == "goal" and "pots" in alias and "empty" not in alias
    ids = {r.path: r.value for r in reg.get("entity_id").collect()}
    assert ids["builtins.components:component"] == "dac3bf7914c7"


def test_list_form_counts_on(reg):
    got = {(r["entity_key"], r["component_index"]): (r["value"], r.get("schedule")) for r in by_key(reg, "effort")}
    assert got == {("pump", 3): ("8", None), ("pump", 4): ("2", "weekly"), ("lamp", 0): ("4 / 8", None)}


def test_coercion_defaults_and_violations(reg):
    got = {(r["entity_key"]): r for r in by_key(reg, "plant")}
    assert (got["one"]["value"], got["one"]["kind"]) == (3.0, "moss")
    assert (got["two"]["value"], got["two"]["kind"]) == (0.25, "cactus")
    assert got["two"]["asked_eid"] == got["one"]["entity_id"]
    bad = [r for r in by_key(reg, "invalid_field") if r["entity_key"] == "two"]
    assert [(r["component_type"], r["field"], r["value"], r["error_type"]) for r in bad] == [("plant", "kind", "cactus", "range")]


def test_inherited_fields(reg):
    (shrub,) = [r for r in by_key(reg, "shrub") if r["entity_key"] == "two"]
    assert (shrub["value"], shrub["height"], shrub["kind"]) == (2.0, 3, "moss")


def test_derived_tables(reg):
    depth = {r["entity_key"]: r["depth"] for r in by_key(reg, "entity_depth")}
    assert depth["goal"] == 0 and depth["water"] == 1
    product = {r["entity_key"]: r["priority_product"] for r in by_key(reg, "priority_product")}
    assert product["water"] == 0.5 and product["light"] == 0.5 and product["lamp"] == 1.0
    effort = {r["entity_key"]: r["value"] for r in by_key(reg, "effort_total")}
    assert effort["pump"] == 8 + 2 * 4 and effort["robot"] == effort["pump"]
    assert {r["entity_key"]: r["value"] for r in by_key(reg, "description")}["goal"] == "keep plants alive"


def test_audits(reg):
    cover = {(r["entity_key"], r["solution_status"]) for r in [dict(x, entity_key=x["entity_key"]) for x in audit_rows(reg)]}
    assert ("water", "in progress") in cover and ("light", None) in cover and ("goal", None) in cover
    reg.execute("audit.traceability")
    found = {r["entity_key"]: r["message"] for r in by_key(reg, "traceability")}
    assert "lamp" in found and "water" not in found and found["lamp"].endswith("does not trace to any requirement.")
    reg.execute("audit.todo")
    assert [r["value"] for r in by_key(reg, "todo_audit")] == ["fix the leak"]
    with pytest.raises(ValueError):
        reg.execute("audit.nothing")


def audit_rows(reg):
    reg.execute("audit.requirement_coverage")
    return by_key(reg, "requirement_coverage")


def test_views(reg):
    rows = reg.view(["plant.value", "plant.kind"]).collect()
    assert {(r["entity_id.alias"], r["plant.value"]) for r in rows} == {("pots.one", 3.0), ("pots.two", 0.25)}
    with pytest.raises(KeyError):
        reg.view("unheard_of")
    assert reg.view("cost_budget").count() == 0
    assert reg.get_entity_id("water") == next(r.value for r in reg.get("entity_id").filter("entity_key = 'water'").collect())
    assert reg.get_entity_id("pot") is None and reg.get_entity_id("") is None


def test_csv_and_python(reg):
    users = reg.get("users_comp").orderBy("component_index").collect()
    assert [(u.component_index, u.user_id, u.name, u.since) for u in users] == [(0, 1, "Ann", "2023-01-02"), (1, 2, "Bo", "2024-05-06")]
    keys = [r.entity_key for r in reg.get("entity_id").filter("filepath like '%mod.py'").collect()]
    assert sorted(k for k in keys) == ["A", "mod"]


def test_csv_of_many_files_and_quotes(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "parts.csv").write_text(f'id,"name, long",note\n{i},"a ""b"", c","two\nlines"\n{i + 100},,\n')
    (tmp_path / "parts.csv").write_text("id,other\nx,1\n")
    (tmp_path / "empty.csv").write_text("")
    got = csv_tables(spark, str(tmp_path))
    rows = got["parts_comp"].collect()
    assert set(got) == {"parts_comp"} and len(rows) == 81
    assert {(r.component_index, r["name, long"], r.note) for r in rows if r.other is None} == {(0, 'a "b", c', "two\nlines"), (1, None, None)}
    assert len({r.entity_id for r in rows}) == 41


def test_python_wins_over_yaml(spark):
    raw = raw_documents(spark, yaml={"x": "a:\n- b\n"}, python={"x": '"""Told."""'}, builtins=False)
    assert [r.kind for r in raw.collect()] == ["python"]
    assert [r.path for r in flat_documents(raw).filter("kind = 'entity'").collect()] == ["x:x"]


def test_dataflows_and_tree(reg, tmp_path, spark):
    made = reg.execute("etl.export_manifest", output_dir=str(tmp_path))
    assert len(made["written_paths"]) == 2 and "written_paths" not in reg.registry.component_types
    tree = reg.requirement_tree("goal")
    assert (tree["name"], tree["priority"], {c["name"] for c in tree["children"]}) == ("goal", 1.0, {"water", "light"})
    assert reg.load_dataflow("etl.export_manifest") is reg


def test_versions(spark):
    text = "position:\n    - component_type\n    - field:\n        x: {type: int}\n        t: {type: int, time_dimension: true}\nship:\n    - position: {x: 1}\n"
    reg = Registrar(spark)
    reg.update(yaml={"a.yaml": text}, time=0)
    reg.update(yaml={"b.yaml": "again:\n    - same_as: a.yaml:ship\n    - position: {x: 5}\n"}, time=1)
    assert [(r["position.x"], r["position.t"]) for r in reg.view_current("position").collect()] == [(5, 1)]
    assert reg.view("position").count() == 2


def test_round_trip(reg, spark, tmp_path):
    written = reg.export_manifest(str(tmp_path))
    assert len(written) == 2  # the CSV file's entity has a document of its own; Python sources have none
    again = Registrar.from_manifest(spark, [w for w in written if "garden" in w])
    want = {(r["entity_key"], r["value"], r["kind"]) for r in by_key(reg, "plant")}
    assert {(r["entity_key"], r["value"], r["kind"]) for r in by_key(again, "plant")} == want
    assert {(r["entity_key"], r["value"]) for r in by_key(again, "requirement") if r["entity_key"] != "mod"} == {(r["entity_key"], r["value"]) for r in by_key(reg, "requirement") if r["entity_key"] != "mod"}


def test_save_and_load(reg, spark, tmp_path):
    reg.save(str(tmp_path / "db"))
    assert Registrar.load(spark, str(tmp_path / "db")).get("plant").count() == reg.get("plant").count()


def test_tables_in_a_database(spark):
    """Derby, which Spark brings along, in memory."""
    rows = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None)], "entity_id string, component_index bigint, value double")
    url = "jdbc:derby:memory:entiloom;create=true"
    save_jdbc({"effort": rows, "solution of": rows.select("entity_id")}, url, driver="org.apache.derby.jdbc.EmbeddedDriver")
    every = load_jdbc(spark, url, driver="org.apache.derby.jdbc.EmbeddedDriver")  # finds the tables itself
    assert set(every) == {"effort", "solution of"} and every["solution of"].count() == 2
    back = load_jdbc(spark, url, ["effort"], driver="org.apache.derby.jdbc.EmbeddedDriver")["effort"]
    assert sorted(tuple(r) for r in back.select("entity_id", "component_index", "value").collect()) == [("a", 1, 2.5), ("b", 2, None)]


def test_small_helpers():
    assert arithmetic("(1+2)*-3") == -9 and arithmetic("a+1") is None and arithmetic("1/0") is None
    assert parse_python("x.py", "def f(:") == {}
    assert [(r[1], r[-1]) for r in flatten("f", {"e": [{"k": {"n1": {"a": 1}, "n2": {"a": None}}}]})[1:]] == [("f:e[0].k.value", "n1"), ("f:e[0].k.a", "1"), ("f:e[1].k.value", "n2"), ("f:e[1].k.a", "")]
    assert flatten("f", {"e": {"data": [{"part of": {"size.x": 2}}]}})[1:] == [("pair", "f:e.data[0].part of.size.x", "f:e", "f:e.data[0].part of", 0, "part", "of", "size.x", "2")]
    assert arithmetic("+".join(["1"] * 5000)) == 5000 and arithmetic("-" * 3000 + "1") == 1 and arithmetic("2-3-4") == -5 and arithmetic("8/4/2") == 1
    assert [arithmetic(t) for t in ("", "()", "1 2", "(1", "1)", "1*/2", "2*-(3-1)", "1e3 - .5")] == [None, None, None, None, None, None, -4, 999.5]
    assert parse_yaml("- a\n- b\n") == {} and parse_yaml("") == {}
    assert docstring_parts("Top.\n\nComponents\n----------\n- a: 1\n\nNotes\n-----\ntext\n") == ("Top.\n\nNotes\n-----\ntext", [{"a": 1}])
    assert parse_python("m.py", '"""A."""\n__entity__ = {"system": True}\n') == {"m": [{"description": "A."}, {"system": True}]}
    assert apart(["a", "a/", "a/b.yaml", "ab"]) == ["a", "ab"]


def test_cli(spark, tmp_path, capsys, monkeypatch):
    f = tmp_path / "m.yaml"
    f.write_text("a:\n    - requirement: {value: 0.5, type: odd}\n")
    assert cli.main(["validate-yaml", str(f)], spark) == 1
    assert "requirement.type: range odd" in capsys.readouterr().out
    f.write_text("a:\n    - requirement: 0.5\n")
    assert cli.main(["validate-yaml", str(f)], spark) == 0
    monkeypatch.setenv(cli.ENV, str(f))
    assert cli.main(["view-component", "requirement", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])[0]["value"] == 0.5
    assert cli.main(["describe-format"]) == 0
    assert "work_state" in capsys.readouterr().out


def test_what_rules_and_checks_read_often_is_written_once(spark, monkeypatch):
    """The spine and the types' tables are worked out once, and types without rules bring no tasks to the violations."""
    new = registrar.loaded(spark, yaml={"a.yaml": "a:\n    - requirement: 0.5\n"})
    assert hasattr(new.get("entity_id"), "durable_path") and hasattr(new.get("component_type"), "durable_path")
    written, write = [], registrar.durable_all
    monkeypatch.setattr(registrar, "durable_all", lambda tables, at_once=8: written.extend(tables) or write(tables, at_once))
    done = registrar.validated(new, last=True)
    assert "requirement" in written and hasattr(done.get("requirement"), "durable_path")
    assert "ExistingRDD" not in done.get("invalid_field")._jdf.queryExecution().toString()


def test_documents_are_written_once_by_few_tasks(spark, monkeypatch):
    """Entities and pairs come from one table, and a task gets documents enough to be worth its Python worker."""
    written, write = [], registrar.durable
    monkeypatch.setattr(registrar, "durable", lambda df, name="step", by=None: written.append(name) or write(df, name, by))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "640")
        flat = flat_documents(raw_documents(spark, yaml={"a.yaml": "a:\n    - x: 1\n"}))
        assert flat.rdd.getNumPartitions() == 80
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    new = registrar.loaded(spark, yaml={"a.yaml": "a:\n    - x: 1\n    - x of: {y: 2}\nb:\n    c:\n"}, builtins=False)
    assert written == ["flat"]
    assert sorted(r.path for r in new.get("entity_id").collect()) == ["a.yaml:a", "a.yaml:b"]  # a null entity leaves nothing
    rows = new.get("x").select("component_index", "modifier", "value", "y").orderBy("component_index").collect()
    assert [tuple(r) for r in rows] == [(0, None, "1", None), (1, "of", None, "2")]


def test_rows_of_a_schema_are_sorted_as_by_spark(spark):
    rows = spark.createDataFrame([("ä", 1), ("z", None), (None, 3), ("Z", 2), ("z", 0), ("\U0001f600", 1), ("\uffee", 1)], "a string, b bigint")
    assert collected(rows, "a", "b") == rows.orderBy("a", "b").collect()
