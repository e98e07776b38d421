"""Documents written line by line, against nested dicts."""

import random

import yaml

from entiloom.operators import export

ODD = ["plain", "5", "true", "null", "- a", "a: b", 'say "hi"', "two\nlines", "é \x07", "#x", "{", "", "it's", "\\n", " lead"]


def expected(rows):
    """file -> nested dict of (path, components), parents first."""
    out = {}
    for file, path, components in sorted(rows, key=lambda r: (r[1].count("."), r[1])):
        here = out.setdefault(file, {})
        *above, key = path.split(".")
        for p in above:
            if not isinstance(here.get(p), dict):
                here[p] = {"data": here[p]} if here.get(p) else {}
            here = here[p]
        here[key] = components
    return out


def test_lines_equal_nested_dicts(spark, tmp_path):
    r = random.Random(3)
    names = [f"k{i}" for i in range(7)] + ["a-b", "Ä", "x y", "1"]
    paths = sorted({(f"m/f{r.randrange(4)}.yaml", ".".join(r.choice(names) for _ in range(r.randint(1, 4)))) for _ in range(120)})
    tables, rows, ids = {"tag": [], "size": [], "odd": []}, [], {}
    for n, (file, path) in enumerate(paths):
        ids[f"e{n}"] = (file, path)
        components = []
        for i in range(r.randint(0, 3)):
            kind = r.choice(list(tables))
            v, w = r.choice(ODD), r.choice(ODD)
            if kind == "tag":
                tables[kind].append((f"e{n}", i, None, ""))
                components.append("tag")
            elif kind == "size":
                tables[kind].append((f"e{n}", i, "of", v or "z"))
                components.append({"size of": v or "z"})
            else:
                tables[kind].append((f"e{n}", i, None, v, w))
                components.append({"odd": {"value": v, "b c": w}})
        rows.append((file, path, components))
    meta = "entity_id string, component_index bigint, modifier string, value string"
    frames = {k: spark.createDataFrame(v, meta + (", `b c` string" if k == "odd" else "")) for k, v in tables.items()}
    spine = spark.createDataFrame([(i, f"{f}:{p}", p, f) for i, (f, p) in ids.items()] + [("q", "src/a.py:q", "q", "src/a.py")], "value string, path string, entity_key string, filepath string")
    lines = export.lines(frames, spine)
    want = expected(rows)
    got = {x.filepath: yaml.safe_load(x.text) for x in export.documents(lines).collect()}
    assert got == want
    written = export.write_documents(lines, str(tmp_path))
    assert written == sorted(f"{tmp_path}/{f}" for f in want)
    assert {f: yaml.safe_load((tmp_path / f).read_text(encoding="utf-8")) for f in want} == want
