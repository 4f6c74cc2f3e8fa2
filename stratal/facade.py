"""The tool surface: one function per tool, over a store path. Reads return DataFrames or small dicts, writes commit.

Writes that need a second look raise ConfirmationNeeded with a token; the same call with confirm=token goes through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.functions.columns import selection_content_hash
from stratal.operators import mutations as mu
from stratal.operators import queries as q
from stratal.operators import selections as se
from stratal.plans import constraints as c
from stratal.plans import model as m
from stratal.plans.patterns import match_axioms as _match
from stratal.sources import export, store
from stratal.sources.ontology import Ontology

DEFAULT_MATCHES = 100


class ConfirmationNeeded(RuntimeError):
    def __init__(self, message: str, token: str):
        super().__init__(f"{message}; confirm with {token}")
        self.token = token


def confirm_token(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8]


def _need(confirm: str | None, message: str, *parts: object) -> None:
    if confirm != (token := confirm_token(*parts)):
        raise ConfirmationNeeded(message, token)


def _read(spark: SparkSession, path: str) -> Ontology:
    return store.load(spark, path)[0]


def _scope(o: Ontology, within: str | None) -> tuple:
    return () if within is None else (q.resolve_within(o, within),)


def _save(s: store.Session, o: Ontology, into: str, kind: str, found: DataFrame, item: str, mode: str, source: str) -> int:
    """found becomes a selection in its own order; returns its size. s.previous_size has that of the one it replaces."""
    s.previous_size = se.size_of(o, into)
    items = found.select(F.monotonically_increasing_id().alias("ord"), F.col(item).alias("item"))
    s.ontology = se.upsert_selection(o, into, kind, items, mode, source)
    s.commit()
    return s.ontology.selections[into].items.count()


def create_ontology(spark: SparkSession, path: str) -> None:
    store.create(spark, path)


def describe_ontology(spark: SparkSession, path: str, within: str | None = None) -> dict[str, DataFrame]:
    o = _read(spark, path)
    scope = _scope(o, within)
    return {
        "axioms": q.summarize_axioms(o, *scope),
        "entities": q.summarize_entities(o, *scope),
        "undeclared": q.count_undeclared_entities(o, *scope),
        "undeclared_current": q.count_undeclared_entities(o, *scope, exclude_deprecated=True),
        "top": q.top_entities(o, 10, within=within),
        "prefix_usage": q.prefix_usage(o, *scope),
        "prefixes": mu.list_prefixes(o),
    }


def export_jsonl(spark: SparkSession, path: str, output_path: str, within: str | None = None) -> export.ExportResult:
    return export.export_jsonl(_read(spark, path), store.check_workspace(output_path), within)


@store.retried
def add_axioms(spark: SparkSession, path: str, axioms: list[dict | m.Node]) -> dict[str, int]:
    if not axioms:
        raise c.QueryError("at least one axiom")
    nodes = [a if isinstance(a, m.Node) else m.parse(a) for a in axioms]
    with store.session(spark, path) as s:
        before = s.ontology.axioms
        s.ontology, new = mu.add_axioms(s.ontology, nodes)
        added = new.join(before.select("hash"), "hash", "left_anti").count()
        s.commit()
    return {"added": added, "skipped": len(nodes) - added}


@store.retried
def remove_axioms(spark: SparkSession, path: str, hashes: list[str] | None = None, selection: str | None = None, confirm: str | None = None) -> dict[str, int]:
    with store.session(spark, path) as s:
        o = s.ontology
        if selection is not None:
            c.selection_items(o, selection, "axiom")
            about = selection_content_hash(o.selections[selection].items).first()
            _need(confirm, f"{about['size']} axioms go", selection, about["hash"], about["size"])
            s.ontology, counts = mu.remove_by_selection(o, selection)
            row = counts.first()
            out = {"removed": row["removed"], "absent": row["absent"] or 0}
        else:
            full = [mu.resolve_hash_prefix(o, h) for h in dict.fromkeys(hashes or [])]
            s.ontology = mu.remove_by_hash(o, full)
            out = {"removed": len(set(full)), "absent": 0}
        s.commit()
    return out


@store.retried
def annotate_axiom(spark: SparkSession, path: str, hash_prefix: str, add: tuple = (), remove: tuple = ()) -> dict:
    if not add and not remove:
        raise c.QueryError("at least one change")
    with store.session(spark, path) as s:
        h = mu.resolve_hash_prefix(s.ontology, hash_prefix)
        s.ontology, done = mu.annotate_axiom(s.ontology, h, add, remove)
        s.commit()
    return {"hash": h, **done}


@store.retried
def replace_axiom(spark: SparkSession, path: str, hash_prefix: str, axiom: dict | m.Node) -> dict:
    new = axiom if isinstance(axiom, m.Node) else m.parse(axiom)
    with store.session(spark, path) as s:
        h = mu.resolve_hash_prefix(s.ontology, hash_prefix)
        s.ontology, outcome = mu.replace_axiom(s.ontology, h, new)
        s.commit()
    return {"hash": m.content_hash(new), "outcome": outcome}


@store.retried
def rename_iri(spark: SparkSession, path: str, old: str, new: str, within: str | None = None, into: str | None = None, mode: str = "create", confirm: str | None = None) -> dict[str, int]:
    with store.session(spark, path) as s:
        o = s.ontology
        scope = None if within is None else c.scoped_items(o, within, "axiom").select(F.col("item").alias("hash"))
        s.ontology, plan = mu.rename_iri(o, old, new, scope)
        counts = {r["outcome"]: r["n"] for r in plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counts.get("merged"):
            merged = selection_content_hash(plan.where("outcome = 'merged'").select(F.col("new_hash").alias("item"))).first()["hash"]
            extra = [] if within is None else [selection_content_hash(o.selections[within].items).first()["hash"]]
            _need(confirm, f"{counts['merged']} axioms merge", old, new, merged, *extra)
        if into is not None:
            found = plan.select(F.col("new_hash").alias("item")).distinct()
            s.ontology = se.upsert_selection(s.ontology, into, "axiom", se.numbered(found, "item"), mode, f"rename_iri({old}, {new})")
        s.commit()
    return {k: counts.get(k, 0) for k in ("replaced", "merged", "noop")}


@store.retried
def find_axioms(spark: SparkSession, path: str, into: str, query: str | None = None, properties: tuple = (), within: str | None = None, mode: str = "create") -> int:
    with store.session(spark, path) as s:
        found = q.search_axioms(s.ontology, query, properties, within)
        return _save(s, s.ontology, into, "axiom", found, "hash", mode, f"find_axioms({query}, {properties}, {within})")


@store.retried
def match_axioms(spark: SparkSession, path: str, pattern: dict, into: str, within: str | None = None, limit: int = DEFAULT_MATCHES, mode: str = "create") -> dict:
    with store.session(spark, path) as s:
        found = _match(s.ontology, pattern, limit, _scope(s.ontology, within))
        n = _save(s, s.ontology, into, "axiom", found, "hash", mode, f"match_axioms({pattern['type']}, {within})")
    return {"size": n, "truncated": n == limit}


@store.retried
def find_entities(spark: SparkSession, path: str, into: str, query: str | None = None, role: str | None = None, namespace: str | None = None, declared: bool | None = None, properties: tuple = (), within: str | None = None, exclude_deprecated: bool = True, mode: str = "create") -> int:
    with store.session(spark, path) as s:
        found = q.search_entities(s.ontology, query, role, namespace, declared, properties, within, exclude_deprecated)
        source = f"find_entities({query}, {role}, {namespace}, {declared}, {properties}, {within})"
        return _save(s, s.ontology, into, "entity", found, "entity_iri", mode, source)


@store.retried
def get_entity(spark: SparkSession, path: str, iri: str, within: str | None = None, into: str | None = None, mode: str = "create") -> dict[str, DataFrame]:
    """Roles, annotations and (scoped) axiom counts; unknown entities raise with up to three near names."""
    with store.session(spark, path) as s:
        o = s.ontology
        scope = _scope(o, within)
        if o.mentions.where(F.col("entity_iri") == iri).isEmpty():
            near = q.find_entities(o, c.EntityTextMatches(iri.split(":", 1)[-1], (m.LOCAL_NAME,)), limit=3)
            raise mu.NotFound(f"{iri}; near: {', '.join(r['entity_iri'] for r in near.collect()) or 'none'}")
        if into is not None:
            _save(s, o, into, "axiom", q.axiom_hashes_for_entity(o, iri, *scope), "hash", mode, f"get_entity({iri}, {within})")
    return {"roles": q.entity_roles(o, iri), "annotations": q.entity_annotations(o, iri), "axioms": q.entity_axiom_counts(o, iri, *scope)}


@store.retried
def find_duplicate_entities(spark: SparkSession, path: str, into: str, annotation_property: str = "rdfs:label", within: str | None = None, mode: str = "create") -> int:
    with store.session(spark, path) as s:
        members = q.duplicate_members(s.ontology, annotation_property, within)
        found = members.groupBy("entity_iri").agg(F.min(F.struct((-F.col("size")).alias("a"), "text", "entity_iri")).alias("k")).orderBy("k")
        return _save(s, s.ontology, into, "entity", found, "entity_iri", mode, f"find_duplicate_entities({annotation_property}, {within})")


@store.retried
def set_prefix(spark: SparkSession, path: str, name: str, iri: str, confirm: str | None = None) -> dict:
    with store.session(spark, path) as s:
        s.ontology, about = mu.set_prefix(s.ontology, name, iri)
        if about["in_use"]:
            _need(confirm, f"{about['in_use']} entities use the prefix", name, iri, about["previous"], about["in_use"])
        s.commit()
    return about


@store.retried
def remove_prefix(spark: SparkSession, path: str, name: str) -> None:
    with store.session(spark, path) as s:
        s.ontology = mu.remove_prefix(s.ontology, name)
        s.commit()


@store.retried
def create_selection(spark: SparkSession, path: str, name: str, expr, mode: str = "create") -> dict[str, int | None]:
    """The size of the new selection, and that of the one it replaces (None without one)."""
    with store.session(spark, path) as s:
        before = se.size_of(s.ontology, name)
        s.ontology = se.create_selection(s.ontology, name, expr, mode)
        s.commit()
        return {"size": se.size_of(s.ontology, name), "previous_size": before}


def read_selection(spark: SparkSession, path: str, name: str, limit: int = 20, offset: int = 0, show: str = "all") -> dict[str, DataFrame]:
    """A page of the selection's items, and its totals."""
    o = _read(spark, path)
    return {"items": se.selection_page(o, name, show, limit, offset), "totals": se.selection_totals(o, name, show)}


def list_selections(spark: SparkSession, path: str) -> DataFrame:
    return se.list_selections(_read(spark, path))


@store.retried
def remove_selections(spark: SparkSession, path: str, names: tuple) -> list[str]:
    with store.session(spark, path) as s:
        s.ontology, missing = se.remove_selections(s.ontology, tuple(names))
        s.commit()
    return missing
