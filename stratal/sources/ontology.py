"""The relations of an ontology as DataFrames, built from axiom nodes (general path) or from table templates."""

from __future__ import annotations

import atexit
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.plans import model as m
from stratal.shuffles import passing

from . import columnar

AXIOMS = "hash string, type string, data string"
MENTIONS = "hash string, entity_iri string, role string, position string"
ENTITY_TEXT = "hash string, entity_iri string, property string, text string"
AXIOM_TEXT = "hash string, property string, text string"
NODES = "hash string, node_id int, parent_id int, field string, ord int, list_size int, kind string, tag string, term string, node_repr string"
PREFIXES = "name string, namespace_iri string"
DERIVED = {"mentions": MENTIONS, "entity_text": ENTITY_TEXT, "axiom_text": AXIOM_TEXT, "nodes": NODES}


@dataclass(frozen=True)
class Selection:
    """A named ordered set of axiom hashes or entity IRIs; items is (ord bigint, item string)."""

    kind: str  # "axiom" or "entity"
    items: DataFrame
    source: str = ""
    created_at: str = ""


@dataclass(frozen=True)
class Ontology:
    axioms: DataFrame
    mentions: DataFrame
    entity_text: DataFrame
    axiom_text: DataFrame
    nodes: DataFrame
    prefixes: DataFrame
    selections: dict[str, Selection] = field(default_factory=dict)
    # what led here from the version of a store that was read: ("add", axioms, relations that hold at least what is derived from
    # them, or None) and ("remove", hashes, None), and the axioms they lead to
    changes: tuple = ()
    changed: DataFrame | None = None
    # text relation -> (the relation it was made of, its rows that may hold a needle)
    searches: dict[str, tuple[DataFrame, Callable[[str], DataFrame | None]]] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.axioms.sparkSession

    def changed_by(self, kind: str, rows: DataFrame, parts: dict[str, DataFrame] | None = None, **relations: DataFrame) -> Ontology:
        """With other relations, and a note of how the axioms came to be, so that a store may write that alone."""
        changes = (*self.changes, (kind, rows, parts)) if self.changed is self.axioms else (("unknown", None, None),)
        return replace(self, changes=changes, changed=relations["axioms"], **relations)

    def texts_with(self, relation: str, needle: str) -> DataFrame:
        """Rows of entity_text or axiom_text that may hold needle: from the index where the relation is as it was indexed, else all."""
        whole = getattr(self, relation)
        of, search = self.searches.get(relation, (None, None))
        found = search(needle) if of is whole else None
        return whole if found is None else found

    def with_selection(self, name: str, selection: Selection) -> Ontology:
        return replace(self, selections=self.selections | {name: selection})


def stored_json(axiom: m.Node) -> str:
    return json.dumps(m.to_json(axiom), separators=(",", ":"), ensure_ascii=False)


def derived(parsed: Iterable[tuple[str, m.Node]]) -> dict[str, list[tuple]]:
    """Rows of the derived relations of (hash, axiom) pairs."""
    out: dict[str, list[tuple]] = {"mentions": [], "entity_text": [], "axiom_text": [], "nodes": []}
    for h, a in parsed:
        out["mentions"] += [(h, *x) for x in m.mentions(a)]
        out["entity_text"] += [(h, *x) for x in m.entity_texts(a)]
        out["axiom_text"] += [(h, *x) for x in m.axiom_texts(a)]
        out["nodes"] += [(h, *(r[c] for c in ("node_id", "parent_id", "field", "ord", "list_size", "kind", "tag", "term", "node_repr"))) for r in m.walk_nodes(a)]
    return out


def _unique(axioms: Iterable[m.Node]) -> dict[str, m.Node]:
    rows: dict[str, m.Node] = {}
    for a in axioms:
        rows.setdefault(m.content_hash(a), a)
    return rows


def node_relations(spark: SparkSession, axioms: Iterable[m.Node]) -> dict[str, DataFrame]:
    """The derived relations of a small list, made where the list is."""
    return {name: spark.createDataFrame(rows, DERIVED[name]) for name, rows in derived(_unique(axioms).items()).items()}


def from_nodes(spark: SparkSession, axioms: Iterable[m.Node], prefixes: DataFrame) -> Ontology:
    axioms = list(axioms)
    return Ontology(axiom_rows(spark, axioms), prefixes=prefixes, **node_relations(spark, axioms))


def apart(axioms: DataFrame, old: str | None = None, new: str | None = None) -> DataFrame:
    """columnar.taken_apart(), written once to a scratch folder: the long expression is planned and run a single time for
    whatever is read off it. The axioms are settled first, or it would be planned for each branch of a union."""
    from . import store

    spark, made = axioms.sparkSession, columnar.taken_apart(settled(axioms.select("hash", "data")), old=old, new=new)
    path = store.scratch(spark, "apart")
    with passing(spark):
        made.write.parquet(path)
    atexit.register(store.discard, spark, path)
    return spark.read.schema(made.schema).parquet(path)


# more than any table has partitions
MANY = 1 << 24


def undivided(df: DataFrame) -> DataFrame:
    """df with its partitions as they are, behind a bound that no projection passes: a long expression over a union is planned
    once, not for each of its branches."""
    return df.coalesce(MANY)


# a settled table of at most so many rows and bytes is broadcast, whatever the planner's threshold: the other side is often
# every axiom, and to shuffle those takes many times the tables' room
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 8 << 20


def settled(df: DataFrame) -> DataFrame:
    """df written once to a scratch folder: its size is known, and joins with it are by broadcast where it is small."""
    from . import store

    spark, path = df.sparkSession, store.scratch(df.sparkSession, "settled")
    with passing(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(store.discard, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(found) if store.size(spark, path) <= BROADCAST_BYTES and found.count() <= BROADCAST_ROWS else found


def from_axioms(axioms: DataFrame, prefixes: DataFrame, selections: dict | None = None) -> Ontology:
    """The derived relations of any axiom table, taken apart in columns from the stored JSON."""
    return Ontology(axioms, prefixes=prefixes, selections=selections or {}, **columnar.relations(apart(axioms)))


def axiom_rows(spark: SparkSession, axioms: Iterable[m.Node]) -> DataFrame:
    """(hash, type, data) of a small list, one row per hash: the first."""
    return spark.createDataFrame([(h, a.tag, stored_json(a)) for h, a in _unique(axioms).items()], AXIOMS)


def empty(spark: SparkSession) -> Ontology:
    make = lambda schema: spark.createDataFrame([], schema)
    return Ontology(make(AXIOMS), make(MENTIONS), make(ENTITY_TEXT), make(AXIOM_TEXT), make(NODES), make(PREFIXES))
