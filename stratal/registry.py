"""The registered ontology queries over the fixture ontology, and their oracle SQL in literal EXISTS form."""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratal.functions.columns import disambiguating_prefixes, local_name_of, selection_content_hash, short_hash
from stratal.operators import mutations as mu
from stratal.operators import queries as q
from stratal.operators import selections as se
from stratal.plans import constraints as c
from stratal.plans import model as m
from stratal.plans.patterns import match_axioms, match_bindings
from stratal.sources.export import export_lines
from stratal.sources import columnar, store, text_index
from stratal.sources.fixture import constants, ontology, oracle_prefix
from stratal.sources.fixture_sql import axiom_text_sql, entity_text_sql, mention_sql
from stratal.sources.ontology import Ontology, undivided

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# the fixture's selections, for the oracle
SELECTIONS = """,
ents_a AS (SELECT unnest(range(10)) AS ord, 'nation:n' || unnest(range(10)) AS item),
ents_b AS (SELECT unnest(range(15)) AS ord, 'nation:n' || (2 * unnest(range(15))) AS item),
axs_a AS MATERIALIZED (SELECT row_number() OVER (ORDER BY hash) - 1 AS ord, hash AS item FROM ax WHERE type = 'ObjectPropertyAssertion'
          AND data LIKE '{"property":"tpch:inRegion"%'),
drifted AS MATERIALIZED (SELECT ord, item FROM axs_a UNION ALL SELECT 1000000, repeat('0', 64) UNION ALL SELECT 1000001, repeat('f', 64))
"""


def query(sql: str | None = None, alone: bool = False):
    """Register a function of the ontology under its name, and of the source tables, if it takes a second argument; sql follows
    the oracle's common tables, or stands alone."""

    def wrap(fn: Callable[..., DataFrame]):
        reads = fn.__code__.co_argcount > 1
        more = lambda spark, sf_dir: [lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")] if reads else []
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ontology(spark, sf_dir), *more(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = sql if alone else oracle_prefix() + SELECTIONS + sql
        return fn

    return wrap


def entities(where: str) -> str:
    return f"SELECT DISTINCT entity_iri FROM ae WHERE {where}"


DECLARED = "EXISTS (SELECT 1 FROM ae x JOIN ax y ON x.hash = y.hash WHERE y.type = 'Declaration' AND x.entity_iri = ae.entity_iri)"
DEPRECATED = "EXISTS (SELECT 1 FROM et x WHERE x.entity_iri = ae.entity_iri AND x.property = 'owl:deprecated' AND lower(x.text) = 'true')"


@query("SELECT type, count(*) AS n FROM ax GROUP BY type")
def count_axioms_by_type(o):
    return q.count_axioms_by_type(o)


@query("SELECT type, count(*) AS n FROM ax GROUP BY ROLLUP (type)")
def summarize_axioms(o):
    return q.summarize_axioms(o)


@query(f"SELECT count(DISTINCT entity_iri) AS n FROM ae WHERE role IN ('Class', 'NamedIndividual') AND NOT {DEPRECATED}")
def count_entities(o):
    return q.count_entities(o, c.WithRoles(("Class", "NamedIndividual")), c.Deprecated(False))


@query("SELECT role, count(DISTINCT entity_iri) AS n FROM ae WHERE role IS NOT NULL GROUP BY role")
def count_entities_by_role(o):
    return q.count_entities_by_role(o)


@query("SELECT role, count(DISTINCT entity_iri) AS n FROM ae WHERE role IS NOT NULL GROUP BY ROLLUP (role)")
def summarize_entities(o):
    return q.summarize_entities(o)


@query(f"SELECT count(DISTINCT entity_iri) AS n FROM ae WHERE role IS NOT NULL AND NOT {DECLARED} AND NOT {DEPRECATED}")
def undeclared_entities(o):
    return q.count_undeclared_entities(o, exclude_deprecated=True)


@query("SELECT entity_iri, count(DISTINCT hash) AS n FROM ae GROUP BY entity_iri ORDER BY n DESC, entity_iri LIMIT 10")
def top_entities(o):
    return q.top_entities(o, 10)


@query("SELECT entity_iri, count(DISTINCT hash) AS n FROM ae WHERE hash IN (SELECT item FROM axs_a) GROUP BY entity_iri ORDER BY n DESC, entity_iri LIMIT 7")
def top_entities_scoped(o):
    return q.top_entities(o, 7, within="axs_a")


@query(
    """SELECT p.name, (SELECT count(DISTINCT entity_iri) FROM ae WHERE split_part(entity_iri, ':', 1) = p.name) AS n
    FROM (SELECT unnest(['tpch','region','nation','supp','cust','part','brand','ptype','seg','bpart','order','doc','REGION']) AS name) AS p"""
)
def prefix_usage(o):
    return q.prefix_usage(o)


@query(
    """SELECT text, count(DISTINCT entity_iri) AS size, min(entity_iri) AS first_iri, max(entity_iri) AS last_iri FROM et AS a WHERE property = 'rdfs:label'
    AND EXISTS (SELECT 1 FROM et AS b WHERE b.property = 'rdfs:label' AND b.text = a.text AND b.entity_iri <> a.entity_iri) GROUP BY text"""
)
def duplicate_labels(o):
    return q.duplicate_group_sizes(o)


@query(
    """SELECT text, count(DISTINCT entity_iri) AS size, string_agg(DISTINCT entity_iri, ' ' ORDER BY entity_iri) AS iris FROM et WHERE property = 'rdfs:label'
    AND entity_iri LIKE 'part:p%' GROUP BY text HAVING count(DISTINCT entity_iri) > 1"""
)
def duplicate_label_members(o):
    parts = o.mentions.where("entity_iri LIKE 'part:p%'").select(F.lit(0).cast("bigint").alias("ord"), F.col("entity_iri").alias("item")).distinct()
    o = se.upsert_selection(o, "parts", "entity", parts)
    return q.duplicate_entities(o, within="parts").select("text", "size", F.array_join("iris", " ").alias("iris"))


@query("SELECT e.entity_iri, min(t.text) AS label FROM (SELECT DISTINCT entity_iri FROM ae WHERE role = 'NamedIndividual') AS e LEFT JOIN et AS t ON t.entity_iri = e.entity_iri AND t.property = 'rdfs:label' GROUP BY e.entity_iri")
def entity_labels(o):
    return q.entity_labels(o, q.find_entities(o, c.WithRoles(("NamedIndividual",))))


@query(
    """SELECT e.entity_iri, (SELECT string_agg(DISTINCT role, ',' ORDER BY role) FROM ae WHERE ae.entity_iri = e.entity_iri) AS roles,
    (SELECT string_agg(DISTINCT property || '=' || text, ',' ORDER BY property || '=' || text) FROM et WHERE et.entity_iri = e.entity_iri AND property <> 'local_name') AS annotations
    FROM (SELECT DISTINCT entity_iri FROM ae WHERE lower(entity_iri) LIKE 'nation:%' OR lower(entity_iri) LIKE 'region:%') AS e"""
)
def entity_display(o):
    d = q.entity_display(o, q.find_entities(o, c.InNamespaces(("nation", "region"))))
    return d.select("entity_iri", F.array_join("roles", ",").alias("roles"), F.array_join(F.transform("annotations", lambda x: F.concat(x["property"], F.lit("="), x["text"])), ",").alias("annotations"))


@query("SELECT type, count(*) AS n FROM ax WHERE EXISTS (SELECT 1 FROM ae WHERE ae.hash = ax.hash AND ae.entity_iri = 'nation:n3') GROUP BY type")
def get_entity_counts(o):
    return q.entity_axiom_counts(o, "nation:n3")


@query("SELECT DISTINCT role FROM ae WHERE entity_iri = 'tpch:Order' AND role IS NOT NULL")
def get_entity_roles(o):
    return q.entity_roles(o, "tpch:Order")


@query("SELECT DISTINCT property, text FROM et WHERE entity_iri = 'doc:d0' AND property <> 'local_name'")
def get_entity_annotations(o):
    return q.entity_annotations(o, "doc:d0")


@query("SELECT hash FROM ax WHERE EXISTS (SELECT 1 FROM ae WHERE ae.hash = ax.hash AND ae.entity_iri = 'region:r1') AND hash IN (SELECT item FROM axs_a)")
def axiom_hashes_for_entity(o):
    return q.axiom_hashes_for_entity(o, "region:r1", c.InAxiomSelection("axs_a"))


@query(entities("entity_iri IN ('nation:n1', 'nation:n2', 'absent:x', 'doc:d3')"))
def find_entities_iris(o):
    return q.find_entities(o, c.InIRIs(("nation:n1", "nation:n2", "absent:x", "doc:d3")))


@query(entities("role IN ('ObjectProperty', 'AnnotationProperty')"))
def find_entities_role(o):
    return q.find_entities(o, c.WithRoles(("ObjectProperty", "AnnotationProperty")))


@query(entities("role IS NOT NULL AND position = 'value'") + " UNION " + entities("role IS NOT NULL AND position = 'domain'"))
def find_entities_has_role(o):
    return q.find_entities(o, c.HasRole(), c.InPositions(("value", "domain")))


@query(entities("entity_iri LIKE 'region:%' OR lower(entity_iri) LIKE 'region:%' OR lower(entity_iri) LIKE 'ptype:%'"))
def find_entities_namespace(o):
    return q.find_entities(o, c.InNamespaces(("Region", "ptype")))


@query(entities(f"role = 'NamedIndividual' AND {DECLARED}"))
def find_entities_declared(o):
    return q.find_entities(o, c.WithRoles(("NamedIndividual",)), c.Declared(True))


@query(entities(f"lower(entity_iri) LIKE 'doc:%' AND NOT {DEPRECATED}"))
def find_entities_not_deprecated(o):
    return q.find_entities(o, c.InNamespaces(("doc",)), c.Deprecated(False))


@query(entities("EXISTS (SELECT 1 FROM et x WHERE x.entity_iri = ae.entity_iri AND x.property IN ('owl:deprecated', 'rdfs:comment'))"))
def find_entities_has_property(o):
    return q.find_entities(o, c.HasAnyProperty(("owl:deprecated", "rdfs:comment")))


@query(entities("position IN ('restriction_property', 'filler', 'chain_member')"))
def find_entities_positions(o):
    return q.find_entities(o, c.InPositions(("restriction_property", "filler", "chain_member")))


@query(entities("hash IN (SELECT hash FROM ax WHERE type = 'HasKey')"))
def find_entities_mentioned_in(o):
    return q.find_entities(o, c.MentionedIn((_hash_of("HasKey"),)))


def _hash_of(tag: str) -> str:
    return next(m.content_hash(a) for a in constants() if a.tag == tag)


def ranked(needle: str) -> str:
    t = lambda cond: f"EXISTS (SELECT 1 FROM et x WHERE x.entity_iri = ae.entity_iri AND {cond})"
    ln, an, eq, has = "x.property = 'local_name'", "x.property <> 'local_name'", f"lower(x.text) = '{needle}'", f"instr(lower(x.text), '{needle}') > 0"
    return f"""SELECT DISTINCT entity_iri, CASE WHEN {t(ln + ' AND ' + eq)} THEN 0 WHEN {t(ln + ' AND ' + has)} THEN 2
        WHEN {t(an + ' AND ' + eq)} THEN 1 ELSE 3 END AS rank0 FROM ae WHERE {t(has)}"""


@query(ranked("red bolt"))
def find_entities_text_ranked(o):
    return q.find_entities(o, c.EntityTextMatches("Red Bolt"))


@query(ranked("p1"))
def find_entities_text_local_names(o):
    return q.find_entities(o, c.EntityTextMatches("P1"))


@query("SELECT DISTINCT entity_iri, CASE WHEN EXISTS (SELECT 1 FROM et x WHERE x.entity_iri = ae.entity_iri AND x.property = 'rdfs:label' AND lower(x.text) = 'small ring') THEN 0 ELSE 1 END AS rank0 FROM ae WHERE EXISTS (SELECT 1 FROM et x WHERE x.entity_iri = ae.entity_iri AND x.property = 'rdfs:label' AND instr(lower(x.text), 'small ring') > 0)")
def find_entities_text_scoped(o):
    return q.find_entities(o, c.EntityTextMatches("small ring", ("rdfs:label",)))


@query(entities("hash IN (SELECT item FROM axs_a) AND position = 'target'"))
def find_entities_in_axiom_selection(o):
    return q.find_entities(o, c.InAxiomSelection("axs_a"), c.InPositions(("target",)))


@query(entities("entity_iri IN (SELECT item FROM ents_a) AND position = 'target'"))
def find_entities_in_entity_selection(o):
    return q.find_entities(o, c.InEntitySelection("ents_a"), c.InPositions(("target",)))


@query(f"SELECT DISTINCT entity_iri FROM ae WHERE role = 'Class' AND lower(entity_iri) LIKE 'part:%' AND {DECLARED} AND EXISTS (SELECT 1 FROM et x WHERE x.entity_iri = ae.entity_iri AND x.property = 'rdfs:label') AND NOT {DEPRECATED} ORDER BY entity_iri LIMIT 25 OFFSET 5")
def search_entities_page(o):
    found = q.search_entities(o, role="Class", namespace="part", declared=True, properties=("rdfs:label",))
    return c.page(found, 25, 5)


@query("SELECT hash FROM ax WHERE type IN ('HasKey', 'DisjointClasses', 'EquivalentClasses')")
def find_axioms_types(o):
    return q.find_axioms(o, c.WithTypes(("HasKey", "DisjointClasses", "EquivalentClasses")))


@query("SELECT hash FROM ax WHERE EXISTS (SELECT 1 FROM ae WHERE ae.hash = ax.hash AND entity_iri = 'tpch:inNation') AND EXISTS (SELECT 1 FROM ae WHERE ae.hash = ax.hash AND entity_iri = 'nation:n7')")
def find_axioms_mentions_all(o):
    return q.find_axioms(o, c.MentionsAll(("tpch:inNation", "nation:n7")))


@query("SELECT hash FROM ax WHERE EXISTS (SELECT 1 FROM ae WHERE ae.hash = ax.hash AND entity_iri IN ('brand:Brand#2', 'region:r0'))")
def find_axioms_mentions_any(o):
    return q.find_axioms(o, c.MentionsAny(("brand:Brand#2", "region:r0")))


@query("SELECT hash FROM ax WHERE EXISTS (SELECT 1 FROM axt WHERE axt.hash = ax.hash AND property IN ('rdfs:seeAlso', 'rdfs:comment'))")
def find_axioms_has_annotation(o):
    return q.find_axioms(o, c.HasAnyAnnotation(("rdfs:seeAlso", "rdfs:comment")))


@query("SELECT hash, CASE WHEN EXISTS (SELECT 1 FROM axt WHERE axt.hash = ax.hash AND lower(text) = '1-urgent') THEN 0 ELSE 1 END AS rank0 FROM ax WHERE EXISTS (SELECT 1 FROM axt WHERE axt.hash = ax.hash AND instr(lower(text), '1-urgent') > 0)")
def find_axioms_text_ranked(o):
    return q.find_axioms(o, c.AnnotationTextMatches("1-Urgent"))


_indexed: dict[tuple, tuple] = {}


# what ranks of entities are made of: an entity's texts, without the axioms that give them
TEXTS = "entity_iri string, property string, text string"


def texts_once(o: Ontology) -> DataFrame:
    """The texts of every entity (TEXTS), sorted by name in each task: an IRI has its local name once, however many axioms mention it."""
    said = o.entity_text.where(F.col("property") != m.LOCAL_NAME).select("entity_iri", "property", "text")
    named = o.entity_text.where(F.col("property") == m.LOCAL_NAME).select("entity_iri").distinct().sortWithinPartitions("entity_iri")
    return named.select("entity_iri", F.lit(m.LOCAL_NAME).alias("property"), local_name_of("entity_iri").alias("text")).unionByName(said)


def indexed(o: Ontology, name: str) -> Ontology:
    """o with a substring index of one text relation, built once a session."""
    from dataclasses import replace

    key = (o.spark.sparkContext.applicationId, id(getattr(o, name)))
    if key not in _indexed:
        path = store.scratch(o.spark, f"index-{name}")
        rows, schema = (texts_once(o), TEXTS) if name == "entity_text" else (getattr(o, name), store.SCHEMAS[name])
        index = text_index.build(rows, path, schema)
        atexit.register(store.discard, o.spark, path)
        _indexed[key] = (getattr(o, name), lambda needle: index.search(o.spark, needle))
    return replace(o, searches={name: _indexed[key]})


@query(ranked("red bolt"))
def find_entities_text_indexed(o):
    return q.find_entities(indexed(o, "entity_text"), c.EntityTextMatches("Red Bolt"))


@query(ranked("r#00000000"))
def find_entities_text_indexed_rare(o):
    """Names of one table, whose grams are rare in all others."""
    return q.find_entities(indexed(o, "entity_text"), c.EntityTextMatches("R#00000000"))


@query("SELECT hash, CASE WHEN EXISTS (SELECT 1 FROM axt WHERE axt.hash = ax.hash AND lower(text) = '5-low') THEN 0 ELSE 1 END AS rank0 FROM ax WHERE EXISTS (SELECT 1 FROM axt WHERE axt.hash = ax.hash AND instr(lower(text), '5-low') > 0)")
def find_axioms_text_indexed(o):
    return q.find_axioms(indexed(o, "axiom_text"), c.AnnotationTextMatches("5-LOW"))


@query("SELECT hash, CASE WHEN EXISTS (SELECT 1 FROM axt WHERE axt.hash = ax.hash AND property = 'rdfs:comment' AND lower(text) = 'first region') THEN 0 ELSE 1 END AS rank0 FROM ax WHERE EXISTS (SELECT 1 FROM axt WHERE axt.hash = ax.hash AND property = 'rdfs:comment' AND instr(lower(text), 'i') > 0)")
def find_axioms_text_scoped(o):
    found = q.search_axioms(o, "I", ("rdfs:comment",))
    exact = o.axiom_text.where("property = 'rdfs:comment' AND lower(text) = 'first region'").select("hash").distinct().withColumn("e", F.lit(0))
    return found.join(exact, "hash", "left").select("hash", F.coalesce("e", F.col("rank0")).alias("rank0"))


# the axioms of axs_a, from their table alone
IN_REGION = """SELECT sha256(data) AS hash, 'ObjectPropertyAssertion' AS type, data
    FROM (SELECT '{"property":"tpch:inRegion","source":"nation:n' || n_nationkey || '","target":"region:r' || n_regionkey || '"}' AS data FROM nation)"""


@query(f"SELECT hash FROM ({IN_REGION})", alone=True)
def find_axioms_in_axiom_selection(o):
    return q.find_axioms(o, c.InAxiomSelection("drifted"))


@query("SELECT hash FROM ax WHERE type = 'ClassAssertion' AND EXISTS (SELECT 1 FROM ae WHERE ae.hash = ax.hash AND entity_iri IN (SELECT item FROM ents_b))")
def find_axioms_in_entity_selection(o):
    return q.find_axioms(o, c.WithTypes(("ClassAssertion",)), c.InEntitySelection("ents_b"))


@query("SELECT hash, type, data FROM ax WHERE type = 'SubClassOf' ORDER BY hash LIMIT 50 OFFSET 10")
def list_axioms_hash_order(o):
    return q.list_axioms(o, c.WithTypes(("SubClassOf",)), limit=50, offset=10)


@query("SELECT hash FROM ax WHERE hash LIKE 'ab%'")
def hash_prefix_lookup(o):
    return o.axioms.where(F.col("hash").startswith("ab")).select("hash")


@query("SELECT hash, substr(hash, 1, 12) AS short FROM ax")
def short_hashes(o):
    return o.axioms.select("hash", short_hash("hash").alias("short"))


@query(
    """, h AS (SELECT DISTINCT hash, lag(hash) OVER (ORDER BY hash) AS p, lead(hash) OVER (ORDER BY hash) AS n FROM (SELECT DISTINCT hash FROM ax))
    SELECT hash, substr(hash, 1, (SELECT max(i) FROM range(0, 64) AS r(i) WHERE substr(hash, 1, i) = substr(p, 1, i) OR substr(hash, 1, i) = substr(n, 1, i) OR i = 0) + 1) AS prefix FROM h"""
)
def disambiguating_hash_prefixes(o):
    return disambiguating_prefixes(o.axioms)


@query("SELECT entity_iri, property, text FROM et WHERE property = 'local_name'")
def local_name_text(o):
    return o.entity_text.where("property = 'local_name'").select("entity_iri", "property", "text")


# ---- whole relations of the table axioms, against a mapping that is written apart --------------------------------


def of_tables(relation: DataFrame) -> DataFrame:
    """A relation without the rows of the constant axioms."""
    fixed = [m.content_hash(a) for a in constants()]
    return relation.where(~F.col("hash").isin(*fixed))


def plain(fn: Callable[[Ontology], DataFrame], sql: str) -> None:
    """Register a function of the ontology whose oracle needs no common tables."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ontology(spark, sf_dir))
    ORACLES[fn.__name__] = sql


def mention_rows(o):
    return of_tables(o.mentions).select("hash", "entity_iri", "role", "position")


def entity_text_rows(o):
    return of_tables(o.entity_text).select("hash", "entity_iri", "property", "text")


def axiom_text_rows(o):
    return of_tables(o.axiom_text).select("hash", "property", "text")


plain(mention_rows, mention_sql())
plain(entity_text_rows, entity_text_sql())
plain(axiom_text_rows, axiom_text_sql())


# the same from the stored JSON of every axiom, as for any table of axioms


def taken_apart(o: Ontology) -> DataFrame:
    """The axioms of o, taken apart as they are read: nothing is written, for the stored form of all of them takes more room than
    the tables, and the structs many times that."""
    return columnar.taken_apart(undivided(o.axioms.select("hash", "data")))


def exploded(o: Ontology, relation: str) -> DataFrame:
    return of_tables(columnar.relations(taken_apart(o))[relation])


def exploded_mentions(o):
    return exploded(o, "mentions")


def exploded_entity_text(o):
    return of_tables(columnar.entity_text_rows(undivided(o.axioms.select("hash", "data"))))


def exploded_axiom_text(o):
    return exploded(o, "axiom_text")


plain(exploded_mentions, mention_sql())
plain(exploded_entity_text, entity_text_sql())
plain(exploded_axiom_text, axiom_text_sql())


@query("SELECT hash, hash AS new_hash, type, data FROM ax")
def exploded_axioms(o):
    """Canonical hash, type and stored form of every axiom, as its JSON gives them."""
    return columnar.canonical_rows(undivided(o.axioms.select("hash", "data")))


@query("SELECT hash, hash AS again FROM ax")
def content_hashes(o):
    """Hashes of the canonical form of every stored axiom."""
    return columnar.axiom_rows(taken_apart(o)).select("hash", F.col("new_hash").alias("again"))


@query("SELECT hash, type AS tag FROM ax")
def structural_dispatch(o):
    """The type of every stored axiom as its field names tell."""
    return columnar.axiom_rows(taken_apart(o)).select("hash", F.col("type").alias("tag"))


# ---- patterns: the oracle asks the source tables -------------------------------------------------------------------


@query("SELECT hash FROM ax WHERE type = 'DisjointClasses'")
def match_wildcard(o):
    return match_axioms(o, {"type": "DisjointClasses", "disjoint_classes": ["*", "*"]})


@query("SELECT hash FROM ax WHERE data = '{\"sub_class\":\"tpch:Self\",\"super_class\":\"tpch:Self\"}'")
def match_variable_equality(o):
    return match_axioms(o, {"type": "SubClassOf", "sub_class": "?x", "super_class": "?x"})


@query("SELECT sha256('{\"sub_class\":\"part:p' || p_partkey || '\",\"super_class\":{\"filler\":\"brand:Brand#7\",\"property\":\"tpch:hasBrand\"}}') AS hash FROM part WHERE p_brand = 'Brand#7'")
def match_concrete_nested(o):
    return match_axioms(o, {"type": "SubClassOf", "sub_class": "*", "super_class": {"type": "ObjectSomeValuesFrom", "property": "tpch:hasBrand", "filler": "brand:Brand#7"}})


@query("SELECT hash FROM ax WHERE data LIKE '%\"property\":\"tpch:hasBrand\",\"filler\"%'")
def match_expression_level(o):
    return match_axioms(o, {"type": "ObjectSomeValuesFrom", "property": "tpch:hasBrand", "filler": "*"})


@query("SELECT hash FROM ax WHERE type = 'SubObjectPropertyOfChain'")
def match_ordered_chain(o):
    return match_axioms(o, {"type": "SubObjectPropertyOfChain", "chain": ["tpch:contains", "?p"], "super_property": "tpch:containsBrand"})


@query("SELECT hash FROM ax WHERE type = 'DisjointClasses' AND data LIKE '%ptype:PROMO%'")
def match_unordered_exact(o):
    return match_axioms(o, {"type": "DisjointClasses", "disjoint_classes": ["?a", "ptype:PROMO"]})


@query("SELECT hash FROM ax WHERE type = 'DifferentIndividuals'")
def match_unordered_partial(o):
    return match_axioms(o, {"type": "DifferentIndividuals", "different_individuals": ["region:r4", "?x", "region:r0"], "different_individuals_match": "partial"})


@query("SELECT sha256('{\"property\":\"rdfs:label\",\"subject\":\"part:p' || p_partkey || '\",\"value\":{\"lang\":\"en\",\"value\":\"red bolt\"}}') AS hash FROM part WHERE p_name = 'red bolt'")
def match_literal_slot(o):
    return match_axioms(o, {"type": "AnnotationAssertion", "property": "rdfs:label", "subject": "*", "value": '"red bolt"@en'})


@query("SELECT sha256('{\"equivalent_classes\":[\"bpart:' || b || '\",{\"filler\":\"brand:' || b || '\",\"property\":\"tpch:hasBrand\"}]}') AS hash, 'bpart:' || b AS v_part, 'brand:' || b AS v_brand FROM (SELECT DISTINCT p_brand AS b FROM part)")
def match_bindings_mixed_list(o):
    return match_bindings(o, {"type": "EquivalentClasses", "equivalent_classes": ["?part", {"type": "ObjectSomeValuesFrom", "property": "tpch:hasBrand", "filler": "?brand"}]})


@query("SELECT hash FROM ax WHERE type = 'HasKey'")
def match_empty_list(o):
    return match_axioms(o, {"type": "HasKey", "class_expression": "*", "has_key_object_properties": ["?p"], "has_key_data_properties": []})


@query("SELECT hash FROM ax WHERE hash IN (SELECT item FROM axs_a) AND data LIKE '%\"region:r2\"%' ORDER BY hash LIMIT 3")
def match_scoped_limit(o):
    return match_axioms(o, {"type": "ObjectPropertyAssertion", "property": "?p", "source": "*", "target": "region:r2"}, limit=3, within=(c.InAxiomSelection("axs_a"),))


# ---- selections ----------------------------------------------------------------------------------------------------


def placed(items: DataFrame) -> DataFrame:
    """Items with their place from 0; small results only."""
    return items.select("item", (F.row_number().over(Window.orderBy("ord")) - 1).cast("bigint").alias("place"))


def of_tables_selections(o: Ontology, read) -> Ontology:
    """o with selections made from tables: the nations of a region by name, and those of suppliers and customers by first key."""
    iri = lambda key: F.concat(F.lit("nation:n"), F.col(key))
    by_name = read("nation").where("n_regionkey = 1").select((F.ascii("n_name") * 1000 + F.ascii(F.substring("n_name", 2, 1))).cast("bigint").alias("ord"), iri("n_nationkey").alias("item"))
    suppliers = read("supplier").select(F.col("s_suppkey").alias("ord"), iri("s_nationkey").alias("item"))
    customers = read("customer").select(F.col("c_custkey").alias("ord"), iri("c_nationkey").alias("item"))
    for name, items in (("region_nations", by_name), ("supplier_nations", suppliers), ("customer_nations", customers)):
        o = se.upsert_selection(o, name, "entity", items, source="tables")
    return o


NATION_SETS = """WITH a AS (SELECT 'nation:n' || n_nationkey AS item, row_number() OVER (ORDER BY ascii(n_name) * 1000 + ascii(substr(n_name, 2, 1)), 'nation:n' || n_nationkey) AS ord FROM nation WHERE n_regionkey = 1),
b AS (SELECT 'nation:n' || s_nationkey AS item, min(s_suppkey) AS ord FROM supplier GROUP BY 1),
c AS (SELECT 'nation:n' || c_nationkey AS item, min(c_custkey) AS ord FROM customer GROUP BY 1),
"""
FIRST_SEEN = """seen AS (SELECT item, 1 AS o, ord FROM {0} UNION ALL SELECT item, 2, ord FROM {1} UNION ALL SELECT item, 3, ord FROM {2}),
firsts AS (SELECT item, min(o * 1000000000000 + ord) AS k FROM seen GROUP BY item) SELECT item, row_number() OVER (ORDER BY k) - 1 AS place FROM firsts"""


@query(NATION_SETS + FIRST_SEEN.format("a", "b", "c"), alone=True)
def set_union(o, read):
    return placed(se.evaluate(of_tables_selections(o, read), ("union", "region_nations", "supplier_nations", "customer_nations")))


@query(NATION_SETS + FIRST_SEEN.format("a", "b", "c"), alone=True)
def set_union_nested(o, read):
    return placed(se.evaluate(of_tables_selections(o, read), ("union", ("union", "region_nations", "supplier_nations"), ("union", "customer_nations"))))


@query(NATION_SETS + FIRST_SEEN.format("b", "a", "c"), alone=True)
def set_union_stored(o, read):
    o = se.create_selection(of_tables_selections(o, read), "stored_union", ("union", "supplier_nations", "region_nations"))
    return placed(se.evaluate(o, ("union", "stored_union", ("union", "customer_nations", "region_nations"))))


@query(NATION_SETS + "d AS (SELECT item, ord FROM b WHERE item IN (SELECT item FROM a) AND item IN (SELECT item FROM c)) SELECT item, row_number() OVER (ORDER BY ord) - 1 AS place FROM d", alone=True)
def set_intersect(o, read):
    return placed(se.evaluate(of_tables_selections(o, read), ("intersect", "supplier_nations", "region_nations", "customer_nations")))


@query(NATION_SETS + "d AS (SELECT item, ord FROM c WHERE item NOT IN (SELECT item FROM a) AND item NOT IN (SELECT item FROM b WHERE ord > 50)) SELECT item, row_number() OVER (ORDER BY ord) - 1 AS place FROM d", alone=True)
def set_diff(o, read):
    o = of_tables_selections(o, read)
    later = read("supplier").groupBy(F.concat(F.lit("nation:n"), F.col("s_nationkey")).alias("item")).agg(F.min("s_suppkey").alias("ord")).where("ord > 50").select("ord", "item")
    o = se.upsert_selection(o, "later_nations", "entity", later)
    return placed(se.evaluate(o, ("diff", "customer_nations", "region_nations", "later_nations")))


@query("SELECT DISTINCT hash AS item FROM ae WHERE entity_iri IN (SELECT item FROM ents_a) AND entity_iri NOT IN (SELECT item FROM ents_b)")
def set_axioms_for(o):
    return se.evaluate(o, ("axioms_for", ("diff", "ents_a", "ents_b"))).select("item")


@query("SELECT DISTINCT entity_iri AS item FROM ae WHERE position = 'target' AND hash IN (SELECT item FROM axs_a)")
def set_entities_in_position(o):
    return se.evaluate(o, ("entities_in", "axs_a", "target")).select("item")


@query("SELECT substr(sha256(string_agg(item, chr(30) ORDER BY item)), 1, 16) AS hash, count(DISTINCT item) AS size FROM drifted")
def selection_hash(o):
    return selection_content_hash(o.selections["drifted"].items)


@query("SELECT item, item IN (SELECT hash FROM ax) AS present FROM drifted")
def read_selection_present_missing(o):
    return se.read_selection(o, "drifted").select("item", "present")


@query("SELECT item FROM ents_b WHERE item NOT IN (SELECT entity_iri FROM ae) ORDER BY item LIMIT 2")
def read_selection_missing_page(o):
    return se.read_selection(o, "ents_b", show="missing", limit=2).select("item")


@query(
    """SELECT 'axiom' AS kind, 'axs_a' AS name, (SELECT count(*) FROM axs_a) AS size, (SELECT count(*) FROM axs_a WHERE item IN (SELECT hash FROM ax)) AS present
    UNION ALL SELECT 'axiom', 'drifted', (SELECT count(*) FROM drifted), (SELECT count(*) FROM drifted WHERE item IN (SELECT hash FROM ax))
    UNION ALL SELECT 'entity', 'ents_a', 10, (SELECT count(*) FROM ents_a WHERE item IN (SELECT entity_iri FROM ae))
    UNION ALL SELECT 'entity', 'ents_b', 15, (SELECT count(*) FROM ents_b WHERE item IN (SELECT entity_iri FROM ae))"""
)
def list_selections_drift(o):
    return se.list_selections(o).select("kind", "name", "size", "present")


# ---- mutations -----------------------------------------------------------------------------------------------------


def _batch() -> list[m.Node]:
    return [
        m.make("SubClassOf", sub_class="tpch:New", super_class="tpch:Order"),
        m.make("SubClassOf", sub_class="tpch:New", super_class="tpch:Order"),
        m.make("DisjointClasses", disjoint_classes=["ptype:LARGE", "ptype:ECONOMY"]),
        m.make("EquivalentClasses", equivalent_classes=["tpch:New", m.make("ObjectIntersectionOf", operands=["tpch:Order", "tpch:Customer"])]),
    ]


@query(
    """SELECT type, count(*) AS n FROM (SELECT type FROM ax UNION ALL SELECT 'SubClassOf' UNION ALL SELECT 'EquivalentClasses') GROUP BY type"""
)
def add_axioms_dedup(o):
    return q.count_axioms_by_type(mu.add_axioms(o, _batch())[0])


@query("SELECT role, count(DISTINCT entity_iri) AS n FROM ae WHERE hash NOT IN (SELECT hash FROM ax WHERE type = 'DisjointClasses') AND role IS NOT NULL GROUP BY role")
def remove_axioms_cascade(o):
    return q.count_entities_by_role(mu.remove(o, o.axioms.where("type = 'DisjointClasses'")))


@query("SELECT count(*) - (SELECT count(*) FROM axs_a) AS n FROM ax")
def remove_by_selection(o):
    return mu.remove_by_selection(o, "drifted")[0].axioms.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT property, text FROM axt WHERE hash IN (SELECT hash FROM ax WHERE type = 'HasKey') UNION ALL SELECT 'rdfs:comment', 'checked'")
def annotate_axiom(o):
    h = _hash_of("HasKey")
    return mu.annotate_axiom(o, h, add=(("rdfs:comment", m.Literal("checked", "xsd:string")),))[0].axiom_text.where(F.col("hash") == h).select("property", "text")


@query("SELECT sha256('{\"transitive_property\":\"tpch:containsBrand\"}') AS hash, 'TransitiveObjectProperty' AS type")
def replace_axiom(o):
    done, _ = mu.replace_axiom(o, _hash_of("TransitiveObjectProperty"), m.make("TransitiveObjectProperty", transitive_property="tpch:containsBrand"))
    return done.axioms.where("type = 'TransitiveObjectProperty'").select("hash", "type")


@query(
    """, hit AS (SELECT * FROM ax WHERE hash IN (SELECT hash FROM ae WHERE entity_iri = 'nation:n0')),
    ren AS (SELECT *, replace(data, '"nation:n0"', '"nation:n1"') AS moved FROM hit)
    SELECT type, CASE WHEN moved IN (SELECT data FROM ax) THEN 'merged' ELSE 'replaced' END AS outcome, count(*) AS n FROM ren GROUP BY ALL"""
)
def rename_iri_merge(o):
    return mu.rename_plan(o, "nation:n0", "nation:n1").groupBy("type", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT split_part(entity_iri, ':', 1) AS name FROM ae WHERE split_part(entity_iri, ':', 1) NOT IN ('rdf','rdfs','owl','xsd') AND split_part(entity_iri, ':', 1) NOT IN ('nation','part')")
def undeclared_prefixes(o):
    from dataclasses import replace

    return mu.undeclared_prefixes(replace(o, prefixes=o.prefixes.where("name IN ('nation', 'part')")))


@query(f"SELECT hash, data FROM ({IN_REGION})", alone=True)
def export_lines_scoped(o):
    return export_lines(o, within="axs_a")


@query("SELECT name, 'http://example.org/' || name || '#' AS namespace_iri FROM (SELECT unnest(['tpch','region','nation','supp','cust','part','brand','ptype','seg','bpart','order','doc','REGION']) AS name) UNION ALL SELECT 'reg' || r_regionkey, 'http://region.org/' || replace(r_name, ' ', '_') || '#' FROM region")
def list_prefixes(o, read):
    for r in read("region").collect():  # a fixed table of five rows
        o, _ = mu.set_prefix(o, f"reg{r['r_regionkey']}", f"http://region.org/{r['r_name'].replace(' ', '_')}#")
    return mu.list_prefixes(o)


@query("SELECT 'zz' AS name, 'http://zz.org/' AS namespace_iri UNION ALL SELECT 'tpch', 'http://new.org/'")
def set_prefix(o):
    o, _ = mu.set_prefix(o, "zz", "http://zz.org/")
    o, _ = mu.set_prefix(o, "tpch", "http://new.org/")
    return o.prefixes.where("name IN ('zz', 'tpch')")


@query(
    """, hit AS (SELECT hash, replace(data, '"nation:n0"', '"nation:n1"') AS moved FROM ax WHERE hash IN (SELECT hash FROM ae WHERE entity_iri = 'nation:n0')),
    post AS (SELECT type, data FROM ax WHERE hash NOT IN (SELECT hash FROM hit) UNION SELECT ax.type, hit.moved FROM hit JOIN ax ON ax.hash = hit.hash)
    SELECT type, count(DISTINCT data) AS n FROM post GROUP BY type"""
)
def rename_iri_state(o):
    return q.count_axioms_by_type(mu.rename_iri(o, "nation:n0", "nation:n1")[0])


@query("SELECT split_part(entity_iri, ':', 1) AS prefix, substr(entity_iri, instr(entity_iri, ':') + 1) AS local_name, count(*) AS n FROM ae GROUP BY ALL")
def curie_parts(o):
    from stratal.functions.columns import local_name_of, prefix_of

    return o.mentions.groupBy(prefix_of("entity_iri").alias("prefix"), local_name_of("entity_iri").alias("local_name")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT '"' || p_name || '"@en' AS term, count(*) AS n FROM part GROUP BY p_name UNION ALL SELECT '"' || source || '"^^xsd:string', count(*) FROM documents GROUP BY source""")
def literal_terms(o):
    labels = o.nodes.where("parent_id = 0 AND field = 'value' AND kind IN ('lang', 'typed')").join(o.axioms.where("data LIKE '%rdfs:label%' AND (data LIKE '%part:p%' OR data LIKE '%doc:d%')"), "hash", "left_semi")
    return labels.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'SubClassOf(tpch:Loop, ObjectHasSelf(tpch:partOf))' AS node_repr UNION ALL SELECT 'SubObjectPropertyOfChain([tpch:contains, tpch:hasBrand], tpch:containsBrand)' UNION ALL SELECT 'DifferentIndividuals(region:r0, region:r1, region:r2, region:r3, region:r4)'")
def rendered_axioms(o):
    named = "node_repr LIKE '%ObjectHasSelf%' OR tag IN ('SubObjectPropertyOfChain', 'DifferentIndividuals')"
    return o.nodes.where("kind = 'axiom'").where(named).select("node_repr")


@query("SELECT count(*) AS exported, (SELECT count(*) FROM drifted) - count(*) AS skipped FROM ax WHERE hash IN (SELECT item FROM drifted)")
def export_counts(o):
    n, size = export_lines(o, within="drifted").agg(F.count(F.lit(1)).alias("exported")), o.selections["drifted"].items.agg(F.count(F.lit(1)).alias("size"))
    return n.join(F.broadcast(size)).select("exported", (F.col("size") - F.col("exported")).alias("skipped"))  # one row each


# ---- point lookups, scopes, errors ---------------------------------------------------------------------------------


def outcome(fn: Callable[[], object]) -> str:
    """The name of the error that fn ends in, or what it gives."""
    try:
        return str(fn())
    except Exception as e:  # noqa: BLE001  the error is the result
        return type(e).__name__


def outcomes(o: Ontology, cases: dict[str, Callable[[], object]]) -> DataFrame:
    return o.spark.createDataFrame([(k, outcome(fn)) for k, fn in cases.items()], "case string, result string")


def literal_rows(pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"case\", '{v}' AS result" for k, v in pairs.items())


@query("""SELECT 'label' AS "case", 'AnnotationAssertion(rdfs:label, nation:n3, "' || n_name || '"^^xsd:string)' AS result FROM nation WHERE n_nationkey = 3 UNION ALL """ + literal_rows({"absent": "NotFound"}))
def load_axiom_by_hash(o):
    h = m.content_hash(m.make("AnnotationAssertion", property="rdfs:label", subject="nation:n3", value=m.Literal(o.axioms.where("data LIKE '%rdfs:label%nation:n3\"%'").first()["data"].split('"value":"')[1].split('"')[0], "xsd:string")))
    return outcomes(o, {"label": lambda: m.render(mu.load_axiom(o, h)), "absent": lambda: mu.load_axiom(o, "0" * 64)})


@query(literal_rows({"none": "NotFound", "several": "QueryError"}) + " UNION ALL SELECT 'one', hash FROM ax WHERE type = 'HasKey'")
def hash_prefix_matches(o):
    return outcomes(o, {"none": lambda: mu.resolve_hash_prefix(o, "0" * 40), "several": lambda: mu.resolve_hash_prefix(o, ""), "one": lambda: mu.resolve_hash_prefix(o, _hash_of("HasKey")[:20])})


@query(
    """WITH named AS (SELECT 'region' || r_regionkey AS name, 'entity' AS kind FROM region UNION ALL SELECT 'nation' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'axiom' END FROM nation),
    asked AS (SELECT unnest(['axiom constraint', 'entity constraint', 'rename', 'scope', 'export', 'remove', 'duplicates', 'axioms_for', 'entities_in', 'upsert entity', 'replace entity']) AS op)
    SELECT name, op, CASE op
        WHEN 'axiom constraint' THEN CASE WHEN kind = 'axiom' THEN 'fine' ELSE 'SelectionNotFound' END
        WHEN 'rename' THEN CASE WHEN kind = 'axiom' THEN 'fine' ELSE 'SelectionNotFound' END
        WHEN 'entity constraint' THEN CASE WHEN kind = 'entity' THEN 'fine' ELSE 'SelectionNotFound' END
        WHEN 'scope' THEN CASE WHEN kind IS NULL THEN 'SelectionNotFound' ELSE 'fine' END
        WHEN 'upsert entity' THEN CASE WHEN kind IS NULL THEN 'fine' ELSE 'QueryError' END
        WHEN 'replace entity' THEN CASE WHEN kind = 'axiom' THEN 'QueryError' ELSE 'fine' END
        WHEN 'duplicates' THEN CASE WHEN kind IS NULL THEN 'SelectionNotFound' WHEN kind = 'axiom' THEN 'SelectionKindMismatch' ELSE 'fine' END
        WHEN 'axioms_for' THEN CASE WHEN kind IS NULL THEN 'SelectionNotFound' WHEN kind = 'axiom' THEN 'QueryError' ELSE 'fine' END
        WHEN 'entities_in' THEN CASE WHEN kind IS NULL THEN 'SelectionNotFound' WHEN kind = 'entity' THEN 'QueryError' ELSE 'fine' END
        ELSE CASE WHEN kind IS NULL THEN 'SelectionNotFound' WHEN kind = 'entity' THEN 'SelectionKindMismatch' ELSE 'fine' END END AS result FROM named, asked""",
    alone=True,
)
def scope_errors(o, read):
    """How each use of a name ends: regions name entity selections, even nations axiom selections, odd nations none."""
    names = []
    for r in read("region").collect():  # two fixed tables of 30 rows
        names.append(f"region{r['r_regionkey']}")
        inside = read("nation").where(F.col("n_regionkey") == r["r_regionkey"]).select(F.col("n_nationkey").cast("bigint").alias("ord"), F.concat(F.lit("nation:n"), "n_nationkey").alias("item"))
        o = se.upsert_selection(o, names[-1], "entity", inside)
    for r in read("nation").collect():
        names.append(f"nation{r['n_nationkey']}")
        if r["n_nationkey"] % 2 == 0:
            o = se.upsert_selection(o, names[-1], "axiom", o.selections["axs_a"].items)
    rows = o.spark.createDataFrame([(0, "nation:n0")], "ord bigint, item string")

    def uses(x: str) -> dict[str, Callable[[], object]]:
        return {
            "axiom constraint": lambda: q.find_axioms(o, c.InAxiomSelection(x)),
            "entity constraint": lambda: q.find_entities(o, c.InEntitySelection(x)),
            "rename": lambda: mu.rename_plan(o, "nation:n0", "nation:n1", c.scoped_items(o, x, "axiom").select(F.col("item").alias("hash"))),
            "scope": lambda: q.resolve_within(o, x),
            "export": lambda: export_lines(o, x),
            "remove": lambda: mu.remove_by_selection(o, x),
            "duplicates": lambda: q.duplicate_members(o, within=x),
            "axioms_for": lambda: se.evaluate(o, ("axioms_for", x)),
            "entities_in": lambda: se.evaluate(o, ("entities_in", x)),
            "upsert entity": lambda: se.upsert_selection(o, x, "entity", rows),
            "replace entity": lambda: se.upsert_selection(o, x, "entity", rows, "replace"),
        }

    found = [(x, op, "fine" if (how := outcome(fn)) not in ERRORS else how) for x in names for op, fn in uses(x).items()]
    return o.spark.createDataFrame(found, "name string, op string, result string")


ERRORS = {"SelectionNotFound", "SelectionKindMismatch", "QueryError"}


@query("""SELECT c AS "case", CASE WHEN n > 0 THEN 'QueryError' END AS result FROM (SELECT unnest(['union of kinds', 'offset alone', 'damaged axiom']) AS c), (SELECT count(*) AS n FROM nation)""", alone=True)
def query_errors(o):
    from dataclasses import replace

    bad = replace(o, axioms=o.axioms.where("type = 'ObjectPropertyAssertion'").withColumn("data", F.expr("substr(data, 1, length(data) - 1)")))
    return outcomes(
        o,
        {
            "union of kinds": lambda: se.evaluate(o, ("union", "ents_a", "axs_a")),
            "offset alone": lambda: q.find_axioms(o, offset=3),
            "damaged axiom": lambda: mu.load_axiom(bad, bad.axioms.first()["hash"]),
        },
    )


@query("SELECT type, count(*) AS n FROM ax WHERE EXISTS (SELECT 1 FROM ae WHERE ae.hash = ax.hash AND ae.entity_iri IN (SELECT item FROM ents_a)) GROUP BY ROLLUP (type)")
def summarize_axioms_scoped(o):
    return q.summarize_axioms(o, q.resolve_within(o, "ents_a"))


@query("SELECT hash, type, data FROM ax WHERE type = 'Declaration'")
def stream_axioms(o):
    return o.spark.createDataFrame([tuple(r) for r in q.stream_axioms(o, c.WithTypes(("Declaration",)))], "hash string, type string, data string")


@query("SELECT sha256('{\"sub_class\":\"part:p7\",\"super_class\":{\"filler\":\"brand:' || p_brand || '\",\"property\":\"tpch:hasBrand\"}}') AS hash, 'ObjectSomeValuesFrom(tpch:hasBrand, brand:' || p_brand || ')' AS v_e FROM part WHERE p_partkey = 7 UNION ALL SELECT sha256('{\"sub_class\":\"part:p7\",\"super_class\":\"ptype:' || p_type || '\"}'), 'ptype:' || p_type FROM part WHERE p_partkey = 7")
def match_binds_expressions(o):
    return match_bindings(o, {"type": "SubClassOf", "sub_class": "part:p7", "super_class": "?e"})


@query("SELECT sha256('{\"entity_type\":\"Class\",\"iri\":\"part:p' || p_partkey || '\"}') AS hash, 'part:p' || p_partkey AS v_x FROM part")
def match_enum_slot(o):
    return match_bindings(o, {"type": "Declaration", "entity_type": "Class", "iri": "?x"})


# ---- selections as they are read and kept -------------------------------------------------------------------------


@query(f"SELECT hash AS item, true AS present, type, data FROM ({IN_REGION}) UNION ALL SELECT repeat(x, 64), false, NULL, NULL FROM (SELECT unnest(['0', 'f']) AS x)", alone=True)
def read_axiom_selection(o):
    return se.selection_page(o, "drifted").drop("ord")


@query(
    """SELECT item, item IN (SELECT entity_iri FROM ae) AS present,
    coalesce((SELECT string_agg(DISTINCT role, ',' ORDER BY role) FROM ae WHERE ae.entity_iri = item), '') AS roles,
    CASE WHEN item IN (SELECT entity_iri FROM ae) THEN (SELECT min(text) FROM et WHERE et.entity_iri = item AND property = 'rdfs:label') END AS label
    FROM ents_b ORDER BY item LIMIT 11 OFFSET 3"""
)
def read_entity_selection(o):
    return se.selection_page(o, "ents_b", limit=11, offset=3).withColumn("roles", F.array_join("roles", ","))


@query(
    """SELECT 'drifted' AS name, count(*) AS size, count(*) - 2 AS present, 2 AS missing, 2 AS total_filtered FROM drifted UNION ALL
    SELECT 'ents_b', count(*), count(*) FILTER (item IN (SELECT entity_iri FROM ae)), count(*) FILTER (item NOT IN (SELECT entity_iri FROM ae)), count(*) FILTER (item IN (SELECT entity_iri FROM ae)) FROM ents_b"""
)
def read_selection_totals(o):
    asked = {"drifted": "missing", "ents_b": "present"}
    rows = [se.selection_totals(o, name, show).select(F.lit(name).alias("name"), "size", "present", "missing", "total_filtered") for name, show in asked.items()]
    return rows[0].unionByName(rows[1])


@query("SELECT DISTINCT hash AS item, 'diff(axioms_for(ents_a), axs_a)' AS source FROM ae WHERE entity_iri IN (SELECT item FROM ents_a) AND hash NOT IN (SELECT item FROM axs_a)")
def create_selection_from_expression(o):
    o = se.create_selection(o, "made", ("diff", ("axioms_for", "ents_a"), "axs_a"))
    return se.read_selection(o, "made").select("item", F.lit(o.selections["made"].source).alias("source"))


@query("SELECT (SELECT count(DISTINCT s_nationkey) FROM supplier) AS previous_size, count(*) AS size FROM nation WHERE n_regionkey = 1", alone=True)
def replace_selection(o, read):
    o = of_tables_selections(o, read)
    before = se.selection_totals(o, "supplier_nations").select(F.col("size").alias("previous_size"))
    o = se.create_selection(o, "supplier_nations", "region_nations", "replace")
    return before.join(F.broadcast(se.selection_totals(o, "supplier_nations").select("size")))  # one row each


@query("SELECT count(DISTINCT l_suppkey) AS size, (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)) AS present FROM lineitem", alone=True)
def upsert_selection_repeats(o, read):
    """Items that repeat count once, and so does what is there of them."""
    rows = read("lineitem").select(F.col("l_orderkey").alias("ord"), F.concat(F.lit("supp:s"), F.col("l_suppkey")).alias("item"))
    return se.selection_totals(se.upsert_selection(o, "repeats", "entity", rows), "repeats").select("size", "present")


@query("SELECT 'axiom' AS kind, 'drifted' AS name, count(*) AS size FROM drifted UNION ALL SELECT 'entity', 'ents_b', 15 UNION ALL SELECT 'absent', 'nothing', 0")
def remove_selections(o):
    o, absent = se.remove_selections(o, ("axs_a", "ents_a", "nothing"))
    gone = o.spark.createDataFrame([("absent", x, 0) for x in absent], "kind string, name string, size bigint")
    return se.list_selections(o).select("kind", "name", "size").unionByName(gone)


# ---- mutations, further outcomes ----------------------------------------------------------------------------------


@query("SELECT type, count(*) AS n FROM ax WHERE type NOT IN ('HasKey', 'TransitiveObjectProperty') GROUP BY type UNION ALL SELECT 'NotFound', 1")
def remove_by_hash(o):
    left = mu.remove_by_hash(o, [_hash_of("HasKey"), _hash_of("TransitiveObjectProperty"), _hash_of("HasKey")])
    error = outcomes(o, {"x": lambda: mu.remove_by_hash(o, [_hash_of("HasKey"), "0" * 64])})
    return q.count_axioms_by_type(left).unionByName(error.select(F.col("result").alias("type"), F.lit(1).cast("bigint").alias("n")))


@query("SELECT 'noop' AS outcome, count(*) AS n FROM ax UNION ALL SELECT 'merged', count(*) - 1 FROM ax")
def replace_axiom_outcomes(o):
    same = mu.replace_axiom(o, _hash_of("HasKey"), next(a for a in constants() if a.tag == "HasKey"))
    into = mu.replace_axiom(o, _hash_of("TransitiveObjectProperty"), next(a for a in constants() if a.tag == "ReflexiveObjectProperty"))
    rows = [x.axioms.agg(F.lit(said).alias("outcome"), F.count(F.lit(1)).alias("n")) for x, said in (same, into)]
    return rows[0].unionByName(rows[1])


@query("SELECT name, 'http://example.org/' || name || '#' AS namespace_iri FROM (SELECT unnest(['tpch','region','nation','supp','cust','part','brand','ptype','seg','bpart','order','doc','REGION']) AS name) UNION ALL SELECT 'in use', 'QueryError' UNION ALL SELECT 'absent', 'NotFound'")
def remove_prefix(o):
    more, _ = mu.set_prefix(o, "zz", "http://zz.org/")
    errors = outcomes(o, {"in use": lambda: mu.remove_prefix(o, "tpch"), "absent": lambda: mu.remove_prefix(o, "zz")})
    return mu.remove_prefix(more, "zz").prefixes.unionByName(errors.toDF("name", "namespace_iri"))


# ---- a stored snapshot ---------------------------------------------------------------------------------------------


def stored(o: Ontology) -> Ontology:
    """o written to a store, then a commit that adds axioms and one that removes some, read again."""
    path = store.scratch(o.spark, "store")
    store.create(o.spark, path)
    with store.session(o.spark, path) as s:
        s.ontology = o
        s.commit()
    with store.session(o.spark, path) as s:
        s.ontology, _ = mu.add_axioms(s.ontology, _batch())
        s.commit()
    with store.session(o.spark, path) as s:
        s.ontology = mu.remove_by_hash(s.ontology, [_hash_of("HasKey")])
        s.commit()
    return store.load(o.spark, path)[0]


@query("SELECT type, count(*) AS n FROM (SELECT type FROM ax WHERE type <> 'HasKey' UNION ALL SELECT 'SubClassOf' UNION ALL SELECT 'EquivalentClasses') GROUP BY type")
def stored_snapshot_types(o):
    return q.count_axioms_by_type(stored(o))


@query("SELECT hash, type, data FROM ax WHERE hash IN (SELECT hash FROM ae WHERE entity_iri IN ('nation:n3', 'tpch:Order')) AND type <> 'HasKey' UNION ALL SELECT sha256('{\"sub_class\":\"tpch:New\",\"super_class\":\"tpch:Order\"}'), 'SubClassOf', '{\"sub_class\":\"tpch:New\",\"super_class\":\"tpch:Order\"}' UNION ALL SELECT sha256('{\"equivalent_classes\":[\"tpch:New\",{\"operands\":[\"tpch:Customer\",\"tpch:Order\"]}]}'), 'EquivalentClasses', '{\"equivalent_classes\":[\"tpch:New\",{\"operands\":[\"tpch:Order\",\"tpch:Customer\"]}]}'")
def stored_snapshot_lookup(o):
    return q.list_axioms(stored(o), c.MentionsAny(("nation:n3", "tpch:Order")))
