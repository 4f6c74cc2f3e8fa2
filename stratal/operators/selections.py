"""Named selections: set algebra, reading with drift, listing.

A set expression is a selection name or a tuple: ("union", e, ...), ("intersect", e, e, ...), ("diff", e, e, ...),
("axioms_for", e), ("entities_in", e) or ("entities_in", e, position). It folds into one lazy DataFrame. Its order is that of
first sight: the place of an item is a path, the operand's number before the place in the operand, at any depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.plans.constraints import QueryError, SelectionNotFound, page
from stratal.plans.model import SELECTION_NAME, ModelError
from stratal.plans.spec import POSITIONS
from stratal.sources.ontology import Ontology, Selection


def numbered(df: DataFrame, item: str) -> DataFrame:
    """(ord, item) in the order of the item: range-sorted, numbers rise but have gaps."""
    return df.select(F.col(item).alias("item")).distinct().orderBy("item").select(F.monotonically_increasing_id().alias("ord"), "item")


def printed(expr) -> str:
    if isinstance(expr, str):
        return expr
    return f"{expr[0]}({', '.join(printed(e) if isinstance(e, (str, tuple)) else str(e) for e in expr[1:])})"


def kind_of(o: Ontology, expr) -> str:
    """"axiom" or "entity"; mixed kinds, wrong operands and too few operands are errors."""
    if isinstance(expr, str):
        if expr not in o.selections:
            raise SelectionNotFound(expr)
        return o.selections[expr].kind
    op, *rest = expr
    if op in ("union", "intersect", "diff"):
        if len(rest) < (1 if op == "union" else 2):
            raise QueryError(f"{op} needs more operands")
        kinds = {kind_of(o, e) for e in rest}
        if len(kinds) > 1:
            raise QueryError(f"{op} over axioms and entities")
        return kinds.pop()
    if op == "axioms_for" and len(rest) == 1:
        if kind_of(o, rest[0]) != "entity":
            raise QueryError("axioms_for takes entities")
        return "axiom"
    if op == "entities_in" and len(rest) in (1, 2):
        if kind_of(o, rest[0]) != "axiom":
            raise QueryError("entities_in takes axioms")
        if len(rest) == 2 and rest[1] not in POSITIONS:
            raise QueryError(f"no position: {rest[1]!r}")
        return "entity"
    raise QueryError(f"no set expression: {expr!r}")


def evaluate(o: Ontology, expr) -> DataFrame:
    """(ord, item): distinct items, ord (array<bigint>) gives the expression's order."""
    kind_of(o, expr)
    return _evaluate(o, expr)


def in_order(items: DataFrame) -> DataFrame:
    """(ord bigint, item) of (ord, item) with any ord: each item once, at its first place."""
    first = items.groupBy("item").agg(F.min("ord").alias("ord"))
    return first.orderBy("ord", "item").select(F.monotonically_increasing_id().alias("ord"), "item")


def _evaluate(o: Ontology, expr) -> DataFrame:
    if isinstance(expr, str):
        return _paths(o.selections[expr].items.groupBy("item").agg(F.min("ord").alias("ord")))
    op, *rest = expr
    if op == "axioms_for":
        hit = o.mentions.join(_evaluate(o, rest[0]).select(F.col("item").alias("entity_iri")), "entity_iri", "left_semi")
        return _paths(numbered(hit, "hash"))
    if op == "entities_in":
        rows = o.mentions if len(rest) == 1 else o.mentions.where(F.col("position") == rest[1])
        return _paths(numbered(rows.join(_evaluate(o, rest[0]).select(F.col("item").alias("hash")), "hash", "left_semi"), "entity_iri"))
    parts = [_evaluate(o, e) for e in rest]
    if op == "union":
        ranked = [p.select(F.concat(F.array(F.lit(i).cast("bigint")), "ord").alias("ord"), "item") for i, p in enumerate(parts)]
        return reduce(DataFrame.unionByName, ranked).groupBy("item").agg(F.min("ord").alias("ord")).select("ord", "item")
    how = "left_semi" if op == "intersect" else "left_anti"
    return reduce(lambda a, b: a.join(b.select("item"), "item", how).select("ord", "item"), parts)


def _paths(items: DataFrame) -> DataFrame:
    return items.select(F.array(F.col("ord").cast("bigint")).alias("ord"), "item")


def upsert_selection(o: Ontology, name: str, kind: str, items: DataFrame, mode: str = "create", source: str = "", created_at: str = "") -> Ontology:
    """create refuses an existing name, replace overwrites; a name of the other kind is refused either way. Of items that
    repeat, the first stays."""
    if not SELECTION_NAME.match(name):
        raise ModelError(f"no selection name: {name!r}")
    old = o.selections.get(name)
    if old is not None and old.kind != kind:
        raise QueryError(f"{name} is a selection of the other kind")
    if mode not in ("create", "replace"):
        raise QueryError(f"no mode: {mode!r}")
    if old is not None and mode == "create":
        raise QueryError(f"{name} exists")
    return o.with_selection(name, Selection(kind, in_order(items), source, created_at))


def create_selection(o: Ontology, name: str, expr, mode: str = "create", created_at: str = "") -> Ontology:
    return upsert_selection(o, name, kind_of(o, expr), evaluate(o, expr), mode, printed(expr), created_at)


def remove_selections(o: Ontology, names: tuple) -> tuple[Ontology, list[str]]:
    """The ontology without them, and the names that were not there."""
    from dataclasses import replace

    left = {k: v for k, v in o.selections.items() if k not in names}
    return replace(o, selections=left), [n for n in dict.fromkeys(names) if n not in o.selections]


def with_presence(o: Ontology, name: str) -> DataFrame:
    """(ord, item, present) of a selection: is the axiom stored, is the entity mentioned?"""
    if name not in o.selections:
        raise SelectionNotFound(name)
    s = o.selections[name]
    there = o.axioms.select(F.col("hash").alias("item")) if s.kind == "axiom" else o.mentions.select(F.col("entity_iri").alias("item"))
    here = there.join(s.items.select("item"), "item", "left_semi").distinct().withColumn("hit", F.lit(True))
    return s.items.join(here, "item", "left").select("ord", "item", F.coalesce("hit", F.lit(False)).alias("present"))


def size_of(o: Ontology, name: str) -> int | None:
    """Items of a selection, None if there is none of that name."""
    return o.selections[name].items.select("item").distinct().count() if name in o.selections else None


def selection_totals(o: Ontology, name: str, show: str = "all") -> DataFrame:
    """One row: kind, source, size, present, missing, and total_filtered, the items that show lets through."""
    there = F.coalesce(F.sum(F.col("present").cast("long")), F.lit(0))
    counts = with_presence(o, name).agg(F.count(F.lit(1)).alias("size"), there.alias("present"))
    missing = F.col("size") - F.col("present")
    total = {"all": F.col("size"), "present": F.col("present"), "missing": missing}
    if show not in total:
        raise QueryError(f"no filter: {show!r}")
    s = o.selections[name]
    return counts.select(F.lit(s.kind).alias("kind"), F.lit(s.source).alias("source"), "size", "present", missing.alias("missing"), total[show].alias("total_filtered"))


def selection_page(o: Ontology, name: str, show: str = "all", limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of read_selection() with what is known of its items: of axioms type and data (null where missing), of entities
    their sorted roles and label (empty and null where missing)."""
    rows = read_selection(o, name, show, limit, offset)
    if o.selections[name].kind == "axiom":
        known = o.axioms.select(F.col("hash").alias("item"), "type", "data")
        return rows.join(known, "item", "left").select("ord", "item", "present", "type", "data").orderBy("ord")
    here = rows.where("present").select(F.col("item").alias("entity_iri"))
    roles = o.mentions.where("role IS NOT NULL").join(here, "entity_iri", "left_semi").groupBy(F.col("entity_iri").alias("item")).agg(F.array_sort(F.collect_set("role")).alias("roles"))
    labels = o.entity_text.where("property = 'rdfs:label'").join(here, "entity_iri", "left_semi").groupBy(F.col("entity_iri").alias("item")).agg(F.min("text").alias("label"))
    known = rows.join(roles, "item", "left").join(labels, "item", "left")
    none = F.array().cast("array<string>")  # roles: a closed list of names
    return known.select("item", "present", F.coalesce("roles", none).alias("roles"), "label").orderBy("item")


def read_selection(o: Ontology, name: str, show: str = "all", limit: int | None = None, offset: int = 0) -> DataFrame:
    """(ord, item, present): axioms in insertion order, entities in IRI order; show is all, present or missing."""
    rows = with_presence(o, name)
    if show not in ("all", "present", "missing"):
        raise QueryError(f"no filter: {show!r}")
    if show != "all":
        rows = rows.where(F.col("present") == (show == "present"))
    return page(rows.orderBy("ord" if o.selections[name].kind == "axiom" else "item"), limit, offset)


def list_selections(o: Ontology, kind: str | None = None) -> DataFrame:
    """(kind, name, size, present, source, created_at) by kind and creation."""
    rows = []
    for name, s in o.selections.items():
        if kind in (None, s.kind):
            counts = with_presence(o, name).agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum(F.col("present").cast("long")), F.lit(0)).alias("present"))
            rows.append(counts.select(F.lit(s.kind).alias("kind"), F.lit(name).alias("name"), "size", "present", F.lit(s.source).alias("source"), F.lit(s.created_at).alias("created_at")))
    if not rows:
        return o.spark.createDataFrame([], "kind string, name string, size bigint, present bigint, source string, created_at string")
    return reduce(DataFrame.unionByName, rows).orderBy("kind", "created_at", "name")
