"""Loading manifests into a registry: flatten, validate, derive, validate again, merge."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, derive, eav, export, graph, resolve, validate
from ..operators.views import current, stacked
from ..sources import manifests
from ..sources.store import Store
from ..sources.tables import durable, durable_all, empty
from . import upkeep
from .registry import Registry

Hook = Callable[[str, object], None]


def loaded(spark: SparkSession, paths=None, yaml=None, python=None, builtins: bool = True, raw: DataFrame | None = None) -> Registry:
    """A registry of the documents as they are: all fields text but for CSV columns. raw: further documents (file_id,
    kind, text) as a table; each is flattened on an executor."""
    texts = manifests.raw_documents(spark, paths, yaml, python, builtins)
    if raw is not None:
        texts = texts.unionByName(raw.select("file_id", "kind", "text"))
    flat = durable(eav.long_rows(manifests.flat_documents(texts)), "flat", by="component_type")  # a type's pivot reads its own files
    kv = flat.filter("kind = 'pair'").drop("kind")
    named = flat.filter("component_type is null and kind = 'entity'").select(F.col("entity_path").alias("path"))
    spine = eav.spine(named).unionByName(manifests.csv_spine(spark, paths))
    pivots = {t: eav.pivot(kv, t, fields) for t, fields in eav.fields_by_type(kv).items() if t not in ("entity_id", "component_type")}
    tables = durable_all({"entity_id": spine, "component_type": eav.component_types(kv), **pivots})  # rules, edges and checks read them often
    spine, types = tables.pop("entity_id"), tables.pop("component_type")
    for name, rows in manifests.csv_tables(spark, paths).items():
        tables[name] = stacked(tables[name], rows) if name in tables else rows
        types = types.unionByName(rows.select("entity_id", "component_index", F.lit(name).alias("component_type"), "modifier", F.lit(False).alias("derived"), F.lit(False).alias("skip_on_export")))
    return Registry(spark, {"entity_id": spine, "component_type": types, **tables})


def validated(reg: Registry, existing: Registry | None = None, last: bool = False) -> Registry:
    """Types coerced, violations in invalid_field, types that are declared but have no rows known as empty. last: coerced
    tables are written, so that they and their violations are worked out once."""
    spine = reg.get("entity_id")
    old = existing.rules() if existing is not None and "field" in existing.tables else {}

    def rules_now() -> dict[str, list[validate.FieldRule]]:
        """Those known before come first: the first definition of a name counts."""
        new = validate.compile_rules(reg.get("field"), spine)
        return {t: [*old.get(t, []), *[r for r in new.get(t, []) if r.name not in {o.name for o in old.get(t, [])}]] for t in {**old, **new}}

    rules = rules_now()
    if "field" in rules and "field" in reg.tables:
        reg.update({"field": durable(validate.coerce(reg.get("field"), rules["field"]), "field")})
        rules = rules_now()
    done = {n: validate.coerce(t, rules[n]) for n, t in reg.tables.items() if n in rules and n not in ("entity_id", "component_type", "invalid_field")}
    if last:
        done = durable_all(done)
    broken = [validate.violations(t, n, rules[n]) for n, t in done.items()]
    reg.update({**done, "invalid_field": reduce(DataFrame.unionByName, broken, empty(reg.spark, validate.VIOLATION))})
    tags = reg.get("component_type").filter("component_type = 'component_type'").select(F.col("entity_id").alias("value"))
    tagged = spine.join(F.broadcast(tags), "value", "left_semi").select("entity_key")  # schema rows
    for name in {*rules, *[r.entity_key for r in tagged.collect()]} - reg.tables.keys():
        reg.declare(name, rules.get(name, []))
    return reg


def derived(reg: Registry, existing: Registry | None = None, load_time: object = None, period: str = "28 days") -> Registry:
    spark = reg.spark
    if "same_as" in reg.tables:
        moved = resolve.same_as_map(reg.get("same_as"), reg.get("entity_id"), existing.get("entity_id") if existing else None)
        tables = {n: resolve.rebase(t, moved) for n, t in reg.tables.items() if n != "entity_id" and "entity_id" in t.columns}
        spine = reg.get("entity_id").join(moved.withColumnRenamed("owner", "value"), "value", "left_anti")
        reg.update({**tables, "entity_id": durable(spine, "spine")})
    spine = reg.get("entity_id")
    rules = reg.rules()
    refs = {n: [r.name for r in rs if r.type == "entity_ref" and r.name in reg.tables[n].columns] for n, rs in rules.items() if n in reg.tables and n != "same_as"}
    refs = {n: fields for n, fields in refs.items() if fields and n != "parent"}
    if refs:
        found = durable(resolve.resolve(resolve.references(reg.tables, refs), spine), "references")
        reg.update({n: resolve.with_resolved(reg.get(n), fields, found) for n, fields in refs.items()})
    edges = durable(graph.parents(spine, reg.tables.get("parent")), "parent")
    tree = graph.Hierarchy(edges)
    text = {n: [r.name for r in rs if r.type == "description"] for n, rs in rules.items() if n in reg.tables}
    if "description" in reg.tables:
        text["description"] = ["value"]
    reg.update({"parent": edges, **{n: derive.stripped(reg.get(n), fields) for n, fields in text.items() if fields}})
    with ThreadPoolExecutor(1) as pool:  # inheritance is a chain of small jobs; what doesn't ask for it runs beside it
        own = reg.tables.get("field")
        field = None if own is None else pool.submit(lambda: durable(graph.inherited(own, edges, tree), "derived-field"))
        if load_time is None:
            with_derived(reg, tree, period)
        if field is not None:
            reg.update({"field": field.result()})
    if load_time is not None:
        known = lambda n: reg.time_field(n) or (existing.time_field(n) if existing is not None else None)
        reg.update({n: derive.time_filled(reg.get(n), f, load_time) for n in reg.component_types if (f := known(n))})
        with_derived(reg, tree, period)
    return validated(reg, existing, last=True)


def with_derived(reg: Registry, tree: graph.Hierarchy, period: str = "28 days") -> None:
    """entity_depth, effort_total, priority_product, resolved_impact_cost, as far as they have rows."""
    made: dict[str, Callable[[], DataFrame]] = {"entity_depth": tree.depth}
    if "effort" in reg.tables:
        made["effort_total"] = lambda: derive.effort_total(tree, reg.get("effort"), period)
    ids = reg.get("entity_id").select(F.col("value").alias("entity_id"))
    if "requirement" in reg.tables:
        p = reg.get("requirement").select("entity_id", F.col("value").cast("string").try_cast("double").alias("p"))
        made["priority_product"] = lambda: tree.ancestor_product(ids, p)
    if {"impact", "cost"} & reg.tables.keys():
        made["resolved_impact_cost"] = lambda: derive.impact_cost(reg.get("impact"), reg.get("cost"), reg.tables.get("impact_budget"), reg.tables.get("cost_budget"))
    with ThreadPoolExecutor(len(made)) as pool:  # each is a chain of jobs, and doesn't wait for the others
        out = {n: f.result() for n, f in {n: pool.submit(f) for n, f in made.items()}.items()}
    written = durable_all(out)
    reg.update({n: t for n, t in written.items() if not t.isEmpty()})


def coverage_audit(reg: Registry) -> dict[str, DataFrame]:
    solution = reg.get("solution")
    if "value_eid" not in solution.columns:
        solution = solution.withColumn("value_eid", F.lit(None).cast("string"))
    return {"requirement_coverage": audit.requirement_coverage(reg.get("requirement"), solution, reg.tables.get("status"))}


def traceability_audit(reg: Registry, by_modifier: bool = False) -> dict[str, DataFrame]:
    solved = reg.get("solution").filter("modifier = 'of'") if by_modifier and "solution" in reg.tables else reg.get("solution of")
    entities = reg.get("entity_id").select(F.col("value").alias("entity_id"))
    return {"traceability": audit.traceability(entities, reg.get("requirement"), solved)}


def todo_audit(reg: Registry) -> dict[str, DataFrame]:
    """Stored beside the component it reads, which so keeps its rows."""
    return {"todo_audit": audit.todo(reg.get("todo"))}


AUDITS: dict[str, Callable[[Registry], dict[str, DataFrame]]] = {"audit.requirement_coverage": coverage_audit, "audit.traceability": traceability_audit, "audit.todo": todo_audit}


class Registrar:
    """What users hold: a registry that manifests are loaded into, and dataflows that run on it."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None, hook: Hook | None = None):
        self.spark, self.registry, self.hook = spark, registry or Registry(spark), hook or (lambda name, value: None)
        self.store: Store | None = None
        self.dataflows = {**AUDITS, "etl.export_manifest": self._export}

    @classmethod
    def from_manifest(cls, spark: SparkSession, manifest: str | Iterable[str], time: object = None) -> Registrar:
        return cls(spark).load_manifest(manifest, time)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Registrar:
        return cls(spark, Registry.load(spark, folder))

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int | None = None) -> Registrar:
        """A registrar whose registry lives in a folder of snapshots (made if it isn't there): updates write the buckets
        that they change, and become the folder's next snapshot."""
        store = Store(spark, folder, buckets)
        user = cls(spark, Registry.of(spark, store.load()) if store.numbers() else None)
        user.store = store
        return user

    def load_manifest(self, manifest: str | Iterable[str], time: object = None) -> Registrar:
        self.update(manifest, time=time)
        return self

    def update(self, paths=None, time: object = None, yaml: dict[str, str] | None = None, python: dict[str, str] | None = None, period: str = "28 days", raw: DataFrame | None = None) -> None:
        """Load more documents (raw: a table of them); derived tables are made anew from the merged registry."""
        existing = self.registry if self.registry.tables else None
        new = loaded(self.spark, paths, yaml, python, raw=raw)
        self.hook("loaded", new)
        new = validated(new, existing)
        self.hook("validated", new)
        new = derived(new, existing, time, period)
        self.hook("derived", new)
        first = existing is None
        if self.store is not None:
            return self._store(new, existing, period)
        self.registry.merge(new)
        changed = new.tables.keys()
        self.registry.update(durable_all({n: t for n, t in self.registry.tables.items() if n in changed and not hasattr(t, "durable_path")}))
        if not first:
            with_derived(self.registry, graph.Hierarchy(self.registry.get("parent")), period)

    def _store(self, new: Registry, existing: Registry | None, period: str) -> None:
        """The next snapshot: buckets of the new rows, and of derived rows that they change, are written again."""
        if existing is None:
            self.store.save(new.tables)
        else:
            own = durable_all({n: t for n, t in new.tables.items() if n not in upkeep.DERIVED})
            done = self.store.merged(self.store.snapshot()["tables"], own)
            both = Registry(self.spark, {n: self.store.read(n, e) for n, e in done.items()})
            rows = upkeep.renewed(existing, Registry(self.spark, own), both, period)
            if rows is None:
                whole = Registry(self.spark, {n: t for n, t in both.tables.items() if n not in upkeep.DERIVED})
                with_derived(whole, graph.Hierarchy(both.get("parent")), period)
                rows = {n: t for n, t in whole.tables.items() if n in upkeep.DERIVED}
            done = self.store.merged(done, durable_all(rows), tuple(rows))
            self.store.commit(done)
        declared = self.registry.declared | new.declared
        self.registry = Registry.of(self.spark, self.store.load())
        self.registry.declared |= {n: r for n, r in declared.items() if n not in self.registry.tables}

    def overwrite(self, component_type: str, table: DataFrame) -> None:
        self.registry.update({component_type: table})

    def save(self, folder: str) -> None:
        self.registry.save(folder)

    def export_manifest(self, output_dir: str | None = None, collapse_time_dimension: bool = True) -> list[str]:
        reg = self.registry
        names = export.kept_types(reg.tables.get("component_type"), [n for n in reg.tables if n not in ("entity_id", "component_type", "field", "invalid_field")])
        tables = {n: current(reg.get(n), reg.time_field(n)) if collapse_time_dimension else reg.get(n) for n in names}
        own = reg.tables.get("field")
        if own is not None:
            said = reg.get("component_type").filter("component_type = 'field'").select("entity_id", "component_index")
            tables["field"] = own.join(said, ["entity_id", "component_index"], "left_semi")
        if "parent" in tables:
            tables["parent"] = export.parents_left(tables["parent"], reg.get("entity_id")).drop("is_primary")
        return export.write_documents(export.lines(tables, reg.get("entity_id")), output_dir)

    def _export(self, reg: Registry, output_dir: str | None = None, collapse_time_dimension: bool = True) -> dict[str, object]:
        return {"written_paths": self.export_manifest(output_dir, collapse_time_dimension)}

    def requirement_tree(self, key: str) -> dict:
        """Nested {name, priority, children} of the requirements below the entity with this key."""
        return graph.requirement_tree(self.registry.get("parent"), self.registry.get("entity_id"), self.registry.get("requirement"), key)

    def load_dataflow(self, flow: str | ModuleType | Callable, name: str | None = None) -> Registrar:
        """A function of the registry that returns tables to store; or a module, or a module's dotted name, with `run`."""
        if isinstance(flow, str) and flow in self.dataflows:
            flow, name = self.dataflows[flow], name or flow
        elif isinstance(flow, str):
            try:
                name, flow = name or flow, importlib.import_module(flow)
            except ModuleNotFoundError as e:
                raise ValueError(f"unknown dataflow {flow!r}") from e
        run = flow.run if isinstance(flow, ModuleType) else flow
        self.dataflows[name or getattr(flow, "__name__", "dataflow")] = run
        return self

    def execute(self, name: str, **inputs: object) -> dict[str, object]:
        """Run a dataflow; tables that it returns are stored under their names, and all that it returns is handed back."""
        if name not in self.dataflows:
            self.load_dataflow(name)
        made = self.dataflows[name](self.registry, **inputs)
        self.registry.update({n: t for n, t in made.items() if isinstance(t, DataFrame)})
        self.hook(name, made)
        return made

    def outputs(self) -> list[str]:
        return sorted(self.dataflows)

    def __getattr__(self, name: str):
        if name in {"view", "view_current", "view_df", "get", "get_entity_id", "view_entity"}:
            return getattr(self.registry, name)
        raise AttributeError(name)
