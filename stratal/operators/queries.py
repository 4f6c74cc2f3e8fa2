"""Query operators: find, list, count, summarise, project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.functions.columns import local_name_of, prefix_of
from stratal.plans.constraints import (
    AnnotationTextMatches,
    Declared,
    Deprecated,
    EntityTextMatches,
    HasAnyProperty,
    HasRole,
    InAxiomSelection,
    InEntitySelection,
    InNamespaces,
    MentionsAll,
    SelectionNotFound,
    WithRoles,
    axiom_hashes,
    axiom_table,
    entity_rows,
    page,
    selection_items,
)
from stratal.plans.model import LOCAL_NAME
from stratal.sources.ontology import Ontology, settled


def find_entities(o: Ontology, *constraints, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Distinct (entity_iri, ranks), best rank first, then by IRI."""
    rows, ranks = entity_rows(o, constraints)
    return page(rows.select("entity_iri", *ranks).distinct().orderBy(*ranks, "entity_iri"), limit, offset)


def count_entities(o: Ontology, *constraints) -> DataFrame:
    return entity_rows(o, constraints)[0].agg(F.count_distinct("entity_iri").alias("n"))


def count_entities_by_role(o: Ontology, *constraints) -> DataFrame:
    return entity_rows(o, constraints)[0].where("role IS NOT NULL").groupBy("role").agg(F.count_distinct("entity_iri").alias("n"))


def find_axioms(o: Ontology, *constraints, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows, ranks = axiom_hashes(o, constraints)
    return page(rows.select("hash", *ranks).orderBy(*ranks, "hash"), limit, offset)


def list_axioms(o: Ontology, *constraints, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(hash, type, data) in hash order."""
    return page(axiom_table(o, constraints)[0].select("hash", "type", "data").orderBy("hash"), limit, offset)


def stream_axioms(o: Ontology, *constraints, limit: int | None = None, offset: int = 0):
    """Lazy iterator of list_axioms, one partition at a time."""
    return list_axioms(o, *constraints, limit=limit, offset=offset).toLocalIterator()


def count_axioms_by_type(o: Ontology, *constraints) -> DataFrame:
    return axiom_table(o, constraints)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def summarize_axioms(o: Ontology, *constraints) -> DataFrame:
    """Counts by type and, with a null type, in total."""
    return axiom_table(o, constraints)[0].rollup("type").agg(F.count(F.lit(1)).alias("n"))


def summarize_entities(o: Ontology, *scope) -> DataFrame:
    """Distinct entities with a role: by role and, with a null role, in total."""
    rows, _ = entity_rows(o, (HasRole(), *scope))
    return rows.rollup("role").agg(F.count_distinct("entity_iri").alias("n"))


def count_undeclared_entities(o: Ontology, *scope, exclude_deprecated: bool = False) -> DataFrame:
    return count_entities(o, HasRole(), Declared(False), *([Deprecated(False)] if exclude_deprecated else []), *scope)


def resolve_within(o: Ontology, name: str):
    """The scope constraint of a selection; unknown names are an error."""
    if name not in o.selections:
        raise SelectionNotFound(name)
    return InAxiomSelection(name) if o.selections[name].kind == "axiom" else InEntitySelection(name)


def duplicate_entities(o: Ontology, prop: str = "rdfs:label", within: str | None = None) -> DataFrame:
    """Values of a property that two or more entities share: (text, size, iris sorted), largest groups first. For showing;
    duplicate_members() has the same without lists."""
    groups = duplicate_members(o, prop, within).groupBy("text", "size").agg(F.sort_array(F.collect_list("entity_iri")).alias("iris"))
    return groups.orderBy(F.desc("size"), "text")


def duplicate_members(o: Ontology, prop: str = "rdfs:label", within: str | None = None) -> DataFrame:
    """The members of duplicate_entities() as rows (text, size, entity_iri): no group meets in one row."""
    rows = o.entity_text.where(F.col("property") == prop)
    if within is not None:
        rows = rows.join(selection_items(o, within, "entity").select(F.col("item").alias("entity_iri")), "entity_iri", "left_semi")
    rows = rows.select("text", "entity_iri").distinct()
    sizes = rows.groupBy("text").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "text").select("text", "size", "entity_iri")


def duplicate_group_sizes(o: Ontology, prop: str = "rdfs:label") -> DataFrame:
    """duplicate_entities without the members: no group meets in one row."""
    rows = o.entity_text.where(F.col("property") == prop).select("text", "entity_iri").distinct()
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("size"), F.min("entity_iri").alias("first_iri"), F.max("entity_iri").alias("last_iri")).where("size > 1")


def top_entities(o: Ontology, n: int = 10, *, within: str | None = None) -> DataFrame:
    """The n entities in most axioms (ties by IRI); an entity scope keeps full counts, an axiom scope counts inside it. An axiom
    has one local-name row of each entity that it mentions, so pairs need no distinct, but for the IRIs without a local name."""
    bare = o.mentions.where(local_name_of("entity_iri") == "").select("entity_iri", "hash").distinct()
    rows = o.entity_text.where(F.col("property") == LOCAL_NAME).select("entity_iri", "hash").unionByName(bare)
    if within is not None:
        scope = resolve_within(o, within)
        column = "hash" if isinstance(scope, InAxiomSelection) else "entity_iri"
        rows = rows.join(o.selections[within].items.select(F.col("item").alias(column)), column, "left_semi")
    counts = rows.groupBy("entity_iri").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "entity_iri").limit(n)


def prefix_usage(o: Ontology, *scope) -> DataFrame:
    """Distinct entities of every registered prefix, 0 where there are none; prefixes compare case-sensitively."""
    used = entity_rows(o, scope)[0].select("entity_iri").distinct().groupBy(prefix_of("entity_iri").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return o.prefixes.select("name").join(used, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def entity_labels(o: Ontology, iris: DataFrame, prop: str = "rdfs:label") -> DataFrame:
    """(entity_iri, label): the least of several labels, null without one. iris has the column entity_iri."""
    labels = o.entity_text.where(F.col("property") == prop).groupBy("entity_iri").agg(F.min("text").alias("label"))
    return iris.select("entity_iri").distinct().join(labels, "entity_iri", "left")


def entity_display(o: Ontology, iris: DataFrame) -> DataFrame:
    """(entity_iri, roles, annotations): sorted distinct roles and annotations of the given entities."""
    asked = settled(iris.select("entity_iri").distinct())
    roles = o.mentions.join(asked, "entity_iri", "left_semi").where("role IS NOT NULL").groupBy("entity_iri").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    notes = o.entity_text.join(asked, "entity_iri", "left_semi").where(F.col("property") != LOCAL_NAME)
    notes = notes.groupBy("entity_iri").agg(F.array_sort(F.collect_set(F.struct("property", "text"))).alias("annotations"))
    return asked.join(roles, "entity_iri", "left").join(notes, "entity_iri", "left")


def entity_roles(o: Ontology, iri: str) -> DataFrame:
    return o.mentions.where((F.col("entity_iri") == iri) & F.col("role").isNotNull()).select("role").distinct()


def entity_annotations(o: Ontology, iri: str) -> DataFrame:
    return o.entity_text.where((F.col("entity_iri") == iri) & (F.col("property") != LOCAL_NAME)).select("property", "text").distinct().orderBy("property", "text")


def entity_axiom_counts(o: Ontology, iri: str, *scope) -> DataFrame:
    """Axioms that mention the entity, by type; scopes narrow only these counts."""
    return count_axioms_by_type(o, MentionsAll((iri,)), *scope)


def axiom_hashes_for_entity(o: Ontology, iri: str, *scope) -> DataFrame:
    return find_axioms(o, MentionsAll((iri,)), *scope)


def search_entities(o: Ontology, query: str | None = None, role: str | None = None, namespace: str | None = None, declared: bool | None = None, properties: tuple = (), within: str | None = None, exclude_deprecated: bool = True) -> DataFrame:
    """The high-level search: text anchors the query, else a role must be there; properties scope the text, or without text
    ask that one of them exists."""
    cs: list = [EntityTextMatches(query, tuple(properties))] if query is not None else [HasRole()]
    if properties and query is None:
        cs.append(HasAnyProperty(tuple(properties)))
    cs += [WithRoles((role,))] * (role is not None) + [InNamespaces((namespace,))] * (namespace is not None)
    cs += [Declared(declared)] * (declared is not None) + [Deprecated(False)] * exclude_deprecated
    if within is not None:
        cs.append(resolve_within(o, within))
    return find_entities(o, *cs)


def search_axioms(o: Ontology, query: str | None = None, properties: tuple = (), within: str | None = None) -> DataFrame:
    from stratal.plans.constraints import HasAnyAnnotation, QueryError

    if query is None and not properties:
        raise QueryError("query or properties must be given")
    cs: list = [AnnotationTextMatches(query, tuple(properties))] if query is not None else [HasAnyAnnotation(tuple(properties))]
    return find_axioms(o, *cs, *([resolve_within(o, within)] if within is not None else []))
