"""Command line: look at manifests, run audits on them, write them out again, check YAML."""

from __future__ import annotations

import argparse
import json
import os
import sys

ENV = "ENTILOOM_MANIFESTS"


def manifest_paths(given: list[str] | None) -> list[str]:
    """Paths given, else those of the environment variable, parted as the system parts paths."""
    return given or [p for p in os.environ.get(ENV, "").split(os.pathsep) if p]


def validate_yaml(spark, text: str) -> str:
    """`Valid.`, or what is wrong: the YAML, the pipeline, or values that break their rules."""
    import yaml

    from .plans.registrar import Registrar

    try:
        parsed = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return f"YAML syntax error: {e}"
    if parsed is not None and not isinstance(parsed, dict):
        return "Pipeline error: a manifest is a mapping of entities"
    reg = Registrar(spark)
    try:
        reg.update(yaml={"check.yaml": text})
        broken = reg.get("invalid_field").join(reg.get("entity_id").filter("filepath = 'check.yaml'").selectExpr("value as entity_id"), "entity_id", "left_semi").collect()
    except Exception as e:  # noqa: BLE001  whatever the pipeline says about a user's document is the answer
        return f"Pipeline error: {e}"
    return "\n".join(f"{r.component_type}.{r.field}: {r.error_type} {r['value'] or ''}".strip() for r in broken) or "Valid."


def describe_format() -> str:
    """The built-in component types and their fields, as a guide for authors."""
    import yaml

    from .functions.documents import instances, walk
    from .sources.manifests import BUILTIN

    lines = []
    for path, entries, _ in walk(yaml.safe_load(BUILTIN.read_text(encoding="utf-8"))):
        said = [e for e in entries if isinstance(e, dict)]
        about = next((e["description"] for e in said if "description" in e), "")
        lines.append(f"{path.rsplit('.', 1)[-1]}: {about}")
        for e in said:
            for _, f in instances("field", e.get("field", [])) if "field" in e else []:
                extra = ", ".join(f"{k} {v}" for k, v in f.items() if k not in ("value", "description"))
                lines.append(f"    {f['value']}: {f.get('description', '')}" + (f" ({extra})" if extra else ""))
    return "\n".join(lines)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="entiloom")
    p.add_argument("--manifest", action="append", help=f"file or folder, several times; else ${ENV}")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("manifest", "list-types", "describe-format"):
        sub.add_parser(name)
    c = sub.add_parser("view-component")
    c.add_argument("type")
    c.add_argument("--format", choices=["csv", "markdown", "json"], default="csv")
    c = sub.add_parser("view-entity")
    c.add_argument("entity")
    c.add_argument("--format", choices=["csv", "markdown", "json"], default="markdown")
    c = sub.add_parser("run-dataflow")
    c.add_argument("name")
    c.add_argument("--format", choices=["csv", "markdown", "json"], default="csv")
    sub.add_parser("requirement-tree").add_argument("key")
    sub.add_parser("refresh").add_argument("--output-dir")
    sub.add_parser("validate-yaml").add_argument("file", nargs="?", default="-")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    paths = manifest_paths(args.manifest)
    if args.command == "manifest":
        print(os.pathsep.join(paths))
        return 0
    if args.command == "describe-format":
        print(describe_format())
        return 0
    if spark is None:  # Spark is slow to start, so only commands that need it do it
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("entiloom").getOrCreate()
    if args.command == "validate-yaml":
        text = sys.stdin.read() if args.file == "-" else open(args.file, encoding="utf-8").read()
        said = validate_yaml(spark, text)
        print(said)
        return int(said != "Valid.")
    from .plans.registrar import Registrar
    from .plans.registry import to_csv, to_markdown, to_records

    show = {"csv": to_csv, "markdown": to_markdown, "json": lambda df: "[" + ", ".join(to_records(df)) + "]"}
    reg = Registrar.from_manifest(spark, paths)
    match args.command:
        case "list-types":
            print("\n".join(reg.registry.component_types))
        case "view-component":
            print(show[args.format](reg.get(args.type)))
        case "view-entity":
            known = reg.get_entity_id(args.entity)
            for name, rows in reg.view_entity(known or args.entity).items():
                print(f"## {name}\n{show[args.format](rows)}\n")
        case "run-dataflow":
            for name, made in sorted(reg.execute(args.name).items()):
                told = "\n".join(map(str, made)) if isinstance(made, list) else show[args.format](made)
                print(f"## {name}\n{told}\n")
        case "requirement-tree":
            print(json.dumps(reg.requirement_tree(args.key), indent=2, ensure_ascii=False))
        case "refresh":
            print("\n".join(reg.export_manifest(args.output_dir)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
