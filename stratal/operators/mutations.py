"""Mutations as functions from ontology to ontology: nothing is changed in place, derived rows follow the stored JSON.

Selections never change with their members (they may drift).
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratal.functions.columns import prefix_of
from stratal.plans import model as m
from stratal.plans.constraints import QueryError, selection_items
from stratal.sources import columnar
from stratal.sources.ontology import Ontology, apart, axiom_rows, from_axioms, node_relations, settled

RELATIONS = ("mentions", "entity_text", "axiom_text", "nodes")


class NotFound(KeyError):
    """A hash, prefix or axiom that is not there."""


def undeclared_prefixes(o: Ontology, mentions: DataFrame | None = None) -> DataFrame:
    """(name): prefixes in use that are neither registered nor built in."""
    used = (o.mentions if mentions is None else mentions).select(prefix_of("entity_iri").alias("name")).distinct()
    return used.where(~F.col("name").isin(*m.BUILTIN_PREFIXES)).join(o.prefixes.select("name"), "name", "left_anti")


def check_prefixes(o: Ontology, axioms: Iterable[m.Node]) -> None:
    used = {x[0].split(":", 1)[0] for a in axioms for x in m.mentions(a)} - set(m.BUILTIN_PREFIXES)
    known = {r["name"] for r in o.prefixes.where(F.col("name").isin(*used)).collect()} if used else set()
    if missing := sorted(used - known):
        raise QueryError(f"undeclared prefixes: {', '.join(missing)}")


def add_rows(o: Ontology, rows: DataFrame, parts: dict[str, DataFrame] | None = None) -> tuple[Ontology, DataFrame]:
    """o with those rows (hash, type, data) that it lacks, and the rows added; of rows with one hash, one is added. parts are the
    derived relations of the rows, where they are known."""
    new = rows.select("hash", "type", "data").groupBy("hash").agg(F.min(F.struct("type", "data")).alias("x")).select("hash", "x.type", "x.data")
    new = settled(new)
    # looked up among the axioms, which are not shuffled for a few
    new = settled(new.join(o.axioms.select("hash").join(new.select("hash"), "hash", "left_semi"), "hash", "left_anti"))
    if parts is None:
        made = from_axioms(new, o.prefixes)
        more = {r: getattr(made, r) for r in RELATIONS}
    else:
        more = {r: parts[r].join(new.select("hash"), "hash", "left_semi") for r in RELATIONS}
    grown = {r: getattr(o, r).unionByName(more[r]) for r in RELATIONS}
    return o.changed_by("add", new, parts, axioms=o.axioms.unionByName(new), **grown), new


def add_nodes(o: Ontology, axioms: list[m.Node]) -> tuple[Ontology, DataFrame]:
    return add_rows(o, axiom_rows(o.spark, axioms), node_relations(o.spark, axioms))


def add_axioms(o: Ontology, axioms: list[m.Node]) -> tuple[Ontology, DataFrame]:
    check_prefixes(o, axioms)
    return add_nodes(o, axioms)


def remove(o: Ontology, hashes: DataFrame) -> Ontology:
    """o without the axioms of the column hash, and without what is derived from them."""
    gone = settled(hashes.select("hash").distinct())
    return o.changed_by("remove", gone, **{r: getattr(o, r).join(gone, "hash", "left_anti") for r in ("axioms", *RELATIONS)})


def remove_by_hash(o: Ontology, hashes: list[str]) -> Ontology:
    """All or nothing: a missing hash is an error."""
    asked = settled(o.spark.createDataFrame([(h,) for h in dict.fromkeys(hashes)], "hash string"))
    if missing := asked.join(o.axioms.select("hash").join(asked, "hash", "left_semi"), "hash", "left_anti").first():
        raise NotFound(missing["hash"])
    return remove(o, asked)


def remove_by_selection(o: Ontology, name: str) -> tuple[Ontology, DataFrame]:
    """o without the selection's axioms, and (removed, absent) counts; the selection stays."""
    items = settled(selection_items(o, name, "axiom").select(F.col("item").alias("hash")).distinct())
    there = items.join(o.axioms.select("hash").join(items, "hash", "left_semi").withColumn("hit", F.lit(1)), "hash", "left")
    counts = there.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("removed"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("absent"))
    return remove(o, items), counts


def load_axiom(o: Ontology, h: str) -> m.Node:
    row = o.axioms.where(F.col("hash") == h).first()
    if row is None:
        raise NotFound(h)
    try:
        return m.parse(json.loads(row["data"]))
    except (ValueError, TypeError, KeyError) as e:
        raise QueryError(f"stored axiom {h} is damaged: {e}") from e


def resolve_hash_prefix(o: Ontology, prefix: str) -> str:
    """The one hash that starts with prefix; none or several are errors."""
    found = [r["hash"] for r in o.axioms.where(F.col("hash").startswith(prefix.lower())).select("hash").limit(2).collect()]
    if not found:
        raise NotFound(prefix)
    if len(found) > 1:
        raise QueryError(f"several axioms start with {prefix}")
    return found[0]


def _swap(o: Ontology, h: str, axiom: m.Node) -> Ontology:
    one = remove(o, o.spark.createDataFrame([(h,)], "hash string"))
    return add_nodes(one, [axiom])[0]


def annotate_axiom(o: Ontology, h: str, add: tuple = (), remove_: tuple = ()) -> tuple[Ontology, dict]:
    """Remove, then add annotations (property, value); the hash stays. Reports what was applied."""
    a = load_axiom(o, h)
    dropped = [x for x in dict.fromkeys(remove_) if x in a.annotations]
    kept = [x for x in a.annotations if x not in dropped]
    added = [x for x in dict.fromkeys(add) if x not in kept]
    return _swap(o, h, m.Node(a.tag, a.values, tuple(kept + added))), {"added": added, "removed": dropped}


def replace_axiom(o: Ontology, h: str, new: m.Node) -> tuple[Ontology, str]:
    """The new axiom in place of the old one, with the old annotations: "noop", "merged" or "replaced"."""
    check_prefixes(o, [new])
    old = load_axiom(o, h)
    target = m.content_hash(new)
    if target == h:
        return o, "noop"
    if not o.axioms.where(F.col("hash") == target).isEmpty():
        return remove(o, o.spark.createDataFrame([(h,)], "hash string")), "merged"
    return _swap(o, h, m.Node(new.tag, new.values, old.annotations)), "replaced"


def renamed_apart(o: Ontology, old: str, new: str, within: DataFrame | None = None) -> DataFrame:
    """The axioms that mention old, taken apart with new in its place; hash is that of before."""
    hit = o.axioms.join(settled(o.mentions.where(F.col("entity_iri") == old).select("hash").distinct()), "hash", "left_semi")
    if within is not None:
        hit = hit.join(within.select("hash"), "hash", "left_semi")
    return apart(hit, old, new)


def rename_plan(o: Ontology, old: str, new: str, within: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(hash, new_hash, type, data, outcome) of every axiom that mentions old; outcome is noop, replaced or merged."""
    renamed = columnar.axiom_rows(renamed_apart(o, old, new, within) if parts is None else parts)
    # in hash order the first to arrive keeps the place, a stored axiom that does not move comes before all
    first = F.row_number().over(Window.partitionBy("new_hash").orderBy("hash")) == 1
    moving = renamed.where("hash != new_hash").withColumn("first", first)
    places = settled(moving.select("hash", "new_hash"))
    standing = o.axioms.select(F.col("hash").alias("new_hash")).join(places.select("new_hash"), "new_hash", "left_semi")
    standing = standing.join(places.select(F.col("hash").alias("new_hash")), "new_hash", "left_anti").withColumn("taken", F.lit(True))
    judged = moving.join(standing, "new_hash", "left").withColumn("outcome", F.when(F.col("taken") | ~F.col("first"), "merged").otherwise("replaced"))
    still = renamed.where("hash = new_hash").withColumn("outcome", F.lit("noop"))
    cols = ["hash", "new_hash", "type", "data", "outcome"]
    return judged.select(cols).unionByName(still.select(cols))


def rename_iri(o: Ontology, old: str, new: str, within: DataFrame | None = None) -> tuple[Ontology, DataFrame]:
    m.check_iri(old)
    m.check_iri(new)
    if (p := new.split(":", 1)[0]) not in m.BUILTIN_PREFIXES and o.prefixes.where(F.col("name") == p).isEmpty():
        raise QueryError(f"undeclared prefixes: {p}")
    parts = renamed_apart(o, old, new, within)
    plan = rename_plan(o, old, new, within, parts)
    left = remove(o, plan.where("outcome != 'noop'").select("hash"))
    moved = plan.where("outcome = 'replaced'").select("hash", "new_hash", "type", "data")
    # of the axioms that become one, the relations are those of the one that keeps the place
    kept = parts.join(moved.select("hash", "new_hash"), "hash").select(F.col("new_hash").alias("hash"), "x", "notes", "rows")
    return add_rows(left, moved.select(F.col("new_hash").alias("hash"), "type", "data"), columnar.relations(kept))[0], plan


def set_prefix(o: Ontology, name: str, namespace: str) -> tuple[Ontology, dict]:
    """Upsert; reports the previous namespace and, if it changes, how many entities use the prefix."""
    if not m.PREFIX_NAME.match(name) or not m.NAMESPACE.match(namespace):
        raise m.ModelError(f"no prefix or namespace: {name!r} {namespace!r}")
    row = o.prefixes.where(F.col("name") == name).first()
    previous = row["namespace_iri"] if row else None
    in_use = 0 if previous in (None, namespace) else _in_use(o, name)
    one = o.spark.createDataFrame([(name, namespace)], "name string, namespace_iri string")
    return replace(o, prefixes=o.prefixes.where(F.col("name") != name).unionByName(one)), {"previous": previous, "in_use": in_use}


def _in_use(o: Ontology, name: str) -> int:
    return o.mentions.where(prefix_of("entity_iri") == name).select("entity_iri").distinct().count()


def remove_prefix(o: Ontology, name: str) -> Ontology:
    if o.prefixes.where(F.col("name") == name).isEmpty():
        raise NotFound(name)
    if n := _in_use(o, name):
        raise QueryError(f"prefix {name} is in use by {n} entities")
    return replace(o, prefixes=o.prefixes.where(F.col("name") != name))


def list_prefixes(o: Ontology) -> DataFrame:
    return o.prefixes.orderBy("name")


