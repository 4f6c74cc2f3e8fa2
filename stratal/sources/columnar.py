"""Axioms taken apart in columns: stored JSON to canonical form, hash, mentions, texts and node rows, without Python workers.

The JSON is read as VARIANT. One expression, unrolled to the depth of the data, turns an axiom into a struct of its type, its slots
in the order of the type table and their members; the type follows from the names of the fields. Members carry what is asked of
them further up (rendered text, canonical JSON, sort key), so each level is computed once from the level below, inside the row:
nothing is shuffled. The relations are read off the finished struct.

Null data has no rows in any relation. Data that is no JSON is an error, as is JSON whose fields fit no type.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import chain, combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratal.functions.columns import json_string, json_text, local_name_of
from stratal.plans import model as m
from stratal.plans.model import LOCAL_NAME
from stratal.plans.spec import AXIOMS, EXPRESSIONS, FIELDS, OPTIONAL, RANGES

TABLES = {"axiom": AXIOMS, "ce": EXPRESSIONS, "range": RANGES}  # by the kind of slot that holds them
SLOT = "struct<name:string,kind:string,role:string,position:string,flags:string>"
DEFAULT_DATATYPE = "xsd:string"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def type_names() -> dict[str, str]:
    """Kind of slot and joined sorted field names -> the type they fit best (the fewest declared fields, then the first)."""
    found: dict[str, str] = {}
    for kind, table in TABLES.items():
        for tag in sorted(table, key=lambda t: len(table[t])):
            names = [f[0] for f in table[tag]]
            spare = [n for n in names if (tag, n) in OPTIONAL]
            for left_out in chain.from_iterable(combinations(spare, k) for k in range(len(spare) + 1)):
                found.setdefault(f"{kind}:" + ",".join(sorted(set(names) - set(left_out))), tag)
    return found


SLOTS = {tag: [dict(zip(("name", "kind", "role", "position", "flags"), f, strict=True)) for f in fields] for tag, fields in FIELDS.items()}


def data_depth(data: Column) -> Column:
    """How deep objects of a JSON text are nested; braces inside strings do not count."""
    bare = F.split(F.regexp_replace(F.regexp_replace(data, r"\\.", ""), r'[^{}"]+', ""), '"')
    braces = F.split(F.array_join(F.filter(bare, lambda x, i: i % 2 == 0), ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a, c):
        return let(a["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0), lambda d: F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m")))

    return F.aggregate(braces, start, step)["m"]


def deepest(d: DataFrame) -> int:
    """The largest depth of the data, 1 if there is none. Texts differ and their braces hardly do: depths are taken of distinct braces."""
    x = F.col("data")
    nested = d.where(F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit(""))) > 1)
    outside = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\.", ""), '"[^"]*"', ""), "[^{}]+", "")
    return nested.select(outside.alias("data")).distinct().agg(F.coalesce(F.max(data_depth(x)), F.lit(1))).first()[0]


PLAIN = r"^[ !#-\[\]-~]*$"  # what JSON writes as it is


def quick_json(x: Column, form) -> Column:
    """form(x), a JSON string, without the work for plain texts."""
    return F.when(x.rlike(PLAIN), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(form(x))


class _Builder:
    """Expressions of one depth; old and new rename IRIs on the way."""

    def __init__(self, old: str | None = None, new: str | None = None):
        self.old, self.new = old, new
        self.slots, self.types = F.col("slots"), F.col("types")

    def iri(self, text: Column) -> Column:
        return text if self.old is None else F.when(text == self.old, self.new).otherwise(text)

    def literal(self, v: Column) -> Column:
        """A member that is a literal."""
        get = lambda name: F.variant_get(v, f"$.{name}", "string")
        parts = F.struct(get("value").alias("value"), get("lang").alias("lang"), F.coalesce(get("datatype"), F.lit(DEFAULT_DATATYPE)).alias("datatype"))

        def made(p: Column) -> Column:
            mark, of = F.when(p["lang"].isNotNull(), "@").otherwise("^^"), F.coalesce(p["lang"], p["datatype"])
            name = F.when(p["lang"].isNotNull(), "lang").otherwise("datatype")
            text = F.concat(F.lit('"'), p["value"], F.lit('"'), mark, of)
            canonical = F.concat(F.lit('{"'), name, F.lit('":'), quick_json(of, json_string), F.lit(',"value":'), quick_json(p["value"], json_string), F.lit("}"))
            stored = F.concat(F.lit('{"value":'), quick_json(p["value"], json_text), F.lit(',"'), name, F.lit('":'), quick_json(of, json_text), F.lit("}"))
            both = F.struct(text.alias("text"), canonical.alias("json"))
            return let(both, lambda x: self.member(F.when(p["lang"].isNotNull(), "lang").otherwise("typed"), x["text"], x["text"], x["json"], stored, x["json"], p["value"]))

        return let(parts, made)

    def leaf(self, v: Column, kind: Column | str) -> Column:
        """A member that is a name."""

        def made(x: Column) -> Column:
            named = F.lit(kind) if isinstance(kind, str) else kind
            return self.member(F.when(named.isin("entity_type", "datatype"), "enum").otherwise("iri"), x, x, quick_json(x, json_string), quick_json(x, json_text), x, x)

        text = v.cast("string")
        if isinstance(kind, str):
            return let(self.iri(text), made)
        return let(text if self.old is None else F.when(kind.isin("entity_type", "datatype"), text).otherwise(self.iri(text)), made)

    @staticmethod
    def member(kind, term, text, canonical, stored, key, value) -> Column:
        named = {"kind": kind, "term": term, "text": text, "json": canonical, "stored": stored, "key": key, "value": value}
        return F.struct(*((F.lit(x) if isinstance(x, str) else x).alias(k) for k, x in named.items()))

    def with_node(self, m: Column, depth: int) -> Column:
        """A member without a node, in the form of one that may have some."""
        return m if depth == 0 else F.struct(*(m[c].alias(c) for c in ("kind", "term", "text", "json", "stored", "key", "value")), F.lit(None).cast(self.node_type(depth - 1)).alias("node"))

    @staticmethod
    def node_type(depth: int) -> str:
        inside = "kind:string,term:string,text:string,json:string,stored:string,key:string,value:string"
        node = ""
        for _ in range(depth + 1):
            members = f"array<struct<{inside}{',node:' + node if node else ''}>>"
            node = f"struct<tag:string,slots:array<struct<name:string,kind:string,role:string,position:string,flags:string,members:{members}>>,text:string,json:string,stored:string>"
        return node

    def any_member(self, v: Column, kind: Column, depth: int) -> Column:
        """A member of a slot: a name, a literal, or (down to the depth) a node."""
        is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        plain = F.when((kind == "literal") | ((kind == "value") & is_object), self.literal(v)).otherwise(self.leaf(v, kind))
        if depth == 0:
            return plain
        nested = (kind == "range") | ((kind == "ce") & is_object)

        def made(n: Column) -> Column:
            named = {"kind": F.when(kind == "range", "range").otherwise("expr"), "term": F.lit(None).cast("string"), "text": n["text"], "json": n["json"], "stored": n["stored"], "key": n["json"], "value": F.lit(None).cast("string")}
            return F.struct(*(x.alias(k) for k, x in named.items()), n.alias("node"))

        return F.when(nested, let(self.node(v, kind, depth - 1), made)).otherwise(self.with_node(plain, depth))

    def node(self, v: Column, kind: Column, depth: int) -> Column:
        """struct(tag, slots, text, json, stored) of an object."""

        def of_map(m: Column) -> Column:
            names = F.array_join(F.sort_array(F.array_except(F.map_keys(m), F.array(F.lit("annotations")))), ",")
            tag = F.element_at(self.types, F.concat(kind, F.lit(":"), names))
            known = F.coalesce(tag, F.raise_error(F.concat(F.lit("no type has the fields "), names)).cast("string"))
            return let(known, lambda t: let(self.filled(m, t, depth), lambda s: self.finished(t, s)))

        return let(v.cast("map<string,variant>"), of_map)

    def filled(self, m: Column, tag: Column, depth: int) -> Column:
        """The slots of a type with their members."""

        def slot(s: Column) -> Column:
            v = F.element_at(m, s["name"])
            values = F.when(v.isNull() | (s["kind"] == "true"), F.array().cast("array<variant>")).when(s["flags"] != "", v.cast("array<variant>")).otherwise(F.array(v))
            role = F.when(s["role"] == "@entity_type", F.element_at(m, F.lit("entity_type")).cast("string")).otherwise(s["role"])
            members = F.transform(values, lambda x: self.any_member(x, s["kind"], depth))
            return F.struct(s["name"].alias("name"), s["kind"].alias("kind"), role.alias("role"), s["position"].alias("position"), s["flags"].alias("flags"), members.alias("members"))

        return F.transform(F.element_at(self.slots, tag), slot)

    def finished(self, tag: Column, slots: Column) -> Column:
        quoted = lambda s, body: F.concat(F.lit('"'), s["name"], F.lit('":'), body)
        listed = lambda xs: F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]"))

        def canonical(s: Column) -> Column:
            one = F.transform(s["members"], lambda x: x["json"])
            order = F.sort_array(F.transform(s["members"], lambda x: F.struct(x["key"].alias("k"), x["json"].alias("j"))))
            many = F.when(s["flags"] == "u", F.transform(order, lambda x: x["j"])).otherwise(one)
            return quoted(s, F.when(s["kind"] == "true", "true").when(s["flags"] == "", s["members"][0]["json"]).otherwise(listed(many)))

        def stored(s: Column) -> Column:
            each = F.transform(s["members"], lambda x: x["stored"])
            return quoted(s, F.when(s["kind"] == "true", "true").when(s["flags"] == "", s["members"][0]["stored"]).otherwise(listed(each)))

        shown = F.filter(slots, lambda s: s["kind"] != "true")

        def text(s: Column) -> Column:
            body = F.array_join(F.transform(s["members"], lambda x: x["text"]), ", ")
            return F.when(s["flags"] == "", s["members"][0]["text"]).when((s["flags"] != "") & (F.size(shown) > 1), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)

        order = F.transform(F.sort_array(F.transform(slots, lambda s: F.struct(s["name"].alias("n"), canonical(s).alias("j")))), lambda x: x["j"])
        return F.struct(
            tag.alias("tag"),
            slots.alias("slots"),
            F.concat(tag, F.lit("("), F.array_join(F.transform(shown, text), ", "), F.lit(")")).alias("text"),
            F.concat(F.lit("{"), F.array_join(order, ","), F.lit("}")).alias("json"),
            F.concat(F.lit("{"), F.array_join(F.transform(slots, stored), ","), F.lit("}")).alias("stored"),
        )

    def notes(self, v: Column) -> Column:
        """Annotations as (property, value), each once."""
        given = F.coalesce(F.element_at(v.cast("map<string,variant>"), F.lit("annotations")).cast("array<variant>"), F.array().cast("array<variant>"))

        def note(a: Column) -> Column:
            value = let(F.variant_get(a, "$.value", "variant"), lambda x: self.any_member(x, F.lit("value"), 0))
            return F.struct(self.iri(F.variant_get(a, "$.property", "string")).alias("property"), value.alias("value"))

        return F.array_distinct(F.transform(given, note))


ROW = "struct<up:int,field:string,ord:int,list_size:int,kind:string,tag:string,term:string,node_repr:string,slot:string,role:string,position:string>"


def _row(up, field, ord_, size, kind, tag, term, text, slot, role, position) -> Column:
    """A node's row; up is how many rows before it its parent stands."""
    named = {"up": up, "field": field, "ord": ord_, "list_size": size, "kind": kind, "tag": tag, "term": term, "node_repr": text, "slot": slot, "role": role, "position": position}
    return F.struct(*(x.alias(k) for k, x in named.items())).cast(ROW)


def _rows(node: Column, inherited: Column, depth: int) -> Column:
    """Rows of everything inside a node, depth first; up counts from the node's own row."""
    none = F.lit(None).cast("string")

    def of_slot(s: Column) -> Column:
        where = F.coalesce(s["position"], inherited)
        size = F.when(s["flags"] == "", 1).otherwise(F.size(s["members"]))

        def of_member(x: Column, i: Column) -> Column:
            nested = x["kind"].isin("expr", "range")
            own = _row(F.lit(0), s["name"], i, size, x["kind"], x["node"]["tag"] if depth else none, F.when(~nested, x["term"]), F.when(nested, x["text"]) if depth else none, s["kind"], s["role"], where)
            if depth == 0:
                return F.array(own)
            inside = F.when(x["node"].isNotNull(), _rows(x["node"], where, depth - 1)).otherwise(F.array().cast(f"array<{ROW}>"))
            return F.concat(F.array(own), inside)

        empty = F.array(F.array(_row(F.lit(0), s["name"], F.lit(-1), F.lit(0), F.lit("empty"), none, none, none, s["kind"], s["role"], where)))
        members = F.transform(s["members"], of_member)
        return F.when(s["kind"] == "true", F.array().cast(f"array<array<{ROW}>>")).when(F.size(s["members"]) == 0, empty).otherwise(members)

    groups = F.flatten(F.transform(node["slots"], of_slot))
    start = F.array().cast(f"array<{ROW}>")
    # a group's first row hangs from the node, which stands before all groups
    place = lambda all_, g: F.concat(all_, F.transform(g, lambda r, i: F.when(i == 0, r.withField("up", F.size(all_) + 1)).otherwise(r)))
    return F.aggregate(groups, start, place)


def taken_apart(axioms: DataFrame, depth: int | None = None, old: str | None = None, new: str | None = None) -> DataFrame:
    """(hash, x, notes, rows) of axioms (hash, data): the struct of each, its annotations and its node rows. The depth of the data
    is looked up (one aggregate) where it is not given. With old and new, IRIs are renamed and the rest follows."""
    d = axioms.where(F.col("data").isNotNull()).select("hash", "data")
    if depth is None:
        depth = deepest(d)
    b = _Builder(old, new)
    slots, types = constant(SLOTS, f"map<string,array<{SLOT}>>"), constant(type_names(), "map<string,string>")
    read = d.select("hash", F.parse_json("data").alias("v"), slots.alias("slots"), types.alias("types"))
    made = read.select("hash", b.node(F.col("v"), F.lit("axiom"), max(0, depth - 1)).alias("x"), b.notes(F.col("v")).alias("notes"))
    return made.withColumn("rows", _rows(F.col("x"), F.lit(None).cast("string"), max(0, depth - 1)))


# ---- canonical and stored form alone: usual shapes without lambdas, which cost some hundred microseconds an axiom ----


@dataclass(frozen=True)
class _Form:
    """A value of one shape, as schema_of_variant() writes it, with its two forms: text with SQL between NUL characters."""

    shape: str
    canonical: str
    stored: str
    nested: bool = False


BARE = r"^[ -\[\]-~]*$"  # JSON all whose strings are written as they are


def _get(path: str, kind: str = "string") -> str:
    return f"variant_get(v, '{path}', '{kind}')"


def _name(path: str) -> _Form:
    return _Form("STRING", form := f'"\0{_get(path)}\0"', form)


def _literals(path: str) -> list[_Form]:
    def form(shape: str, name: str, of: str) -> _Form:
        value = f'"value":"\0{_get(path + ".value")}\0"'
        return _Form(f"OBJECT<{shape}value: STRING>", f'{{"{name}":"{of}",{value}}}', f'{{{value},"{name}":"{of}"}}')

    return [*(form(f"{x}: STRING, ", x, f"\0{_get(f'{path}.{x}')}\0") for x in ("lang", "datatype")), form("", "datatype", DEFAULT_DATATYPE)]


def _names(path: str, ordered: bool) -> _Form:
    xs = _get(path, "array<string>")
    form = lambda of: f"""["\0array_join({of}, '","')\0"]"""
    return _Form("ARRAY<STRING>", form(xs if ordered else f"sort_array({xs})"), form(xs))


def _member_forms(path: str, kind: str, flags: str, inside: bool) -> list[_Form]:
    if kind == "true":
        return [_Form("BOOLEAN", "true", "true")]
    if kind == "range" or flags:
        return [_names(path, flags == "l")] if kind in ("iri", "ce") else []
    plain = [] if kind == "literal" else [_name(path)]
    within = [f for tag in EXPRESSIONS for f in _forms("ce", tag, path)] if kind == "ce" and not inside else []
    return plain + (_literals(path) if kind in ("literal", "value") else []) + within


def _forms(of: str, tag: str, path: str) -> list[_Form]:
    """The usual shapes of a type: members that are names, literals and lists of names, at most one an expression of those."""
    fields, found = FIELDS[tag], []
    if type_names()[f"{of}:" + ",".join(sorted(f[0] for f in fields))] != tag:
        return []
    for members in product(*(_member_forms(f"{path}.{f[0]}", f[1], f[4], of == "ce") for f in fields)):
        if sum(x.nested for x in members) < 2:
            stored = [(f[0], x) for f, x in zip(fields, members, strict=True)]
            ordered = sorted(stored, key=lambda x: x[0])
            listed = lambda xs, form: "{" + ",".join(f'"{k}":{getattr(x, form)}' for k, x in xs) + "}"
            shape = "OBJECT<" + ", ".join(f"{k}: {x.shape}" for k, x in ordered) + ">"
            found.append(_Form(shape, listed(ordered, "canonical"), listed(stored, "stored"), of == "ce"))
    return found


def _joined(form: str) -> str:
    return "concat(" + ", ".join(x if i % 2 else f"'{x}'" for i, x in enumerate(form.split("\0"))) + ")"


def canonical_rows(axioms: DataFrame, depth: int | None = None) -> DataFrame:
    """axiom_rows() of axioms (hash, data) without the structs in between: an axiom of a usual shape, with one annotation at most,
    is written from its members, any other goes the way of taken_apart(), row by row."""
    d = axioms.where(F.col("data").isNotNull()).select("hash", "data")
    if depth is None:
        depth = deepest(d)
    known = [(tag, x) for tag in AXIOMS for x in _forms("axiom", tag, "$")]
    value, prop = "$.annotations[0].value", _get("$.annotations[0].property")
    notes = [(f"OBJECT<annotations: ARRAY<OBJECT<property: STRING, value: {x.shape}>>, ", f',"annotations":[{{"property":"\0{prop}\0","value":{x.stored}}}]}}') for x in (_name(value), *_literals(value))]
    alone = _get("$.annotations[1]", "variant") + " IS NULL"
    noted = lambda then, last: "CASE " + " ".join(f"WHEN startswith(shape, '{s}') AND {alone} THEN {then(s, n)}" for s, n in notes) + f" ELSE {last} END"
    read = d.select("hash", "data", F.parse_json("data").alias("v"))
    read = read.select("hash", "v", F.when(F.col("data").rlike(BARE) & ~F.contains("data", F.lit("null")), F.schema_of_variant("v")).alias("shape"))  # a list's shape tells no nulls
    bare, note = noted(lambda s, _: f"concat('OBJECT<', substring(shape, {len(s) + 1}))", "shape"), noted(lambda _, n: _joined(n), "'}'")
    slots, types = constant(SLOTS, f"map<string,array<{SLOT}>>"), constant(type_names(), "map<string,string>")
    read = read.select("hash", "v", F.expr(bare).alias("shape"), F.expr(note).alias("note"), slots.alias("slots"), types.alias("types"))
    # the stored form ends with what the note brings: the closing brace
    cases = " ".join(f"WHEN '{x.shape}' THEN named_struct('tag', '{tag}', 'json', {_joined(x.canonical)}, 'stored', {_joined(x.stored[:-1] + chr(0) + 'note' + chr(0))})" for tag, x in known)
    b = _Builder()
    parts = F.struct(b.node(F.col("v"), F.lit("axiom"), max(0, depth - 1)).alias("x"), b.notes(F.col("v")).alias("notes"))
    whole = let(parts, lambda y: F.struct(y["x"]["tag"].alias("tag"), y["x"]["json"].alias("json"), stored_json(y["x"], y["notes"]).alias("stored")))
    made = read.select("hash", F.when(F.col("shape").isin([x.shape for _, x in known]), F.expr(f"CASE shape {cases} END")).otherwise(whole).alias("x"))
    return made.select("hash", F.sha2(F.col("x.json"), 256).alias("new_hash"), F.col("x.tag").alias("type"), F.col("x.stored").alias("data"))


def stored_json(x: Column, notes: Column) -> Column:
    """The stored form: fields in the order of the type, annotations last."""
    each = F.transform(notes, lambda a: F.concat(F.lit('{"property":'), json_text(a["property"]), F.lit(',"value":'), a["value"]["stored"], F.lit("}")))
    more = F.concat(F.lit(',"annotations":['), F.array_join(each, ","), F.lit("]}"))
    return F.when(F.size(notes) > 0, F.concat(F.substr(x["stored"], F.lit(1), F.char_length(x["stored"]) - 1), more)).otherwise(x["stored"])


def axiom_rows(parts: DataFrame) -> DataFrame:
    """(hash, new_hash, type, data) as the canonical form of the struct gives them."""
    return parts.select("hash", F.sha2(F.col("x.json"), 256).alias("new_hash"), F.col("x.tag").alias("type"), stored_json(F.col("x"), F.col("notes")).alias("data"))


def _mention_structs(notes: Column | str = "notes", rows: Column | str = "rows") -> Column:
    one = lambda iri, role, position: F.struct(iri.alias("entity_iri"), role.cast("string").alias("role"), position.cast("string").alias("position"))
    noted = F.flatten(
        F.transform(
            notes,
            lambda a: F.concat(
                F.array(one(a["property"], F.lit("AnnotationProperty"), F.lit("property"))),
                F.when(a["value"]["kind"] == "iri", F.array(one(a["value"]["term"], F.lit(None), F.lit("value")))).otherwise(F.array().cast("array<struct<entity_iri:string,role:string,position:string>>")),
            ),
        )
    )
    inside = F.filter(rows, lambda r: (r["kind"] == "iri") & r["slot"].isin("iri", "ce", "value"))
    return F.concat(noted, F.transform(inside, lambda r: one(r["term"], r["role"], r["position"])))


def relations(parts: DataFrame) -> dict[str, DataFrame]:
    """mentions, entity_text, axiom_text and nodes of axioms that were taken apart."""
    mentions = parts.select("hash", F.inline(_mention_structs()))
    names = parts.select("hash", F.explode(F.array_distinct(F.transform(_mention_structs(), lambda m: m["entity_iri"]))).alias("entity_iri"))
    names = names.select("hash", "entity_iri", F.lit(LOCAL_NAME).alias("property"), local_name_of("entity_iri").alias("text")).where("text != ''")
    member = lambda k: F.col("x.slots")[k]["members"][0]  # noqa: E731  AnnotationAssertion: property, subject, value
    said = parts.where("x.tag = 'AnnotationAssertion'").select("hash", member(1)["term"].alias("entity_iri"), member(0)["term"].alias("property"), member(2)["value"].alias("text"))
    axiom_text = parts.select("hash", F.explode("notes").alias("a")).select("hash", F.col("a.property").alias("property"), F.col("a.value.value").alias("text"))
    below = parts.select("hash", F.posexplode("rows").alias("i", "r"))
    none = F.lit(None).cast("string")
    nodes = below.select("hash", (F.col("i") + 1).alias("node_id"), (F.col("i") + 1 - F.col("r.up")).alias("parent_id"), *(F.col(f"r.{c}").alias(c) for c in ("field", "ord", "list_size", "kind", "tag", "term", "node_repr")))
    roots = parts.select("hash", F.lit(0).alias("node_id"), F.lit(-1).alias("parent_id"), F.lit("").alias("field"), F.lit(0).alias("ord"), F.lit(1).alias("list_size"), F.lit("axiom").alias("kind"), F.col("x.tag").alias("tag"), none.alias("term"), F.col("x.text").alias("node_repr"))
    return {"mentions": mentions, "entity_text": names.unionByName(said), "axiom_text": axiom_text, "nodes": roots.unionByName(nodes)}


# ---- texts of entities alone: axioms of usual shapes are cut at their quotes, and a table tells which pieces are IRIs ----

AS_IT_IS = r"^[^\\\x00-\x1f]*$"  # JSON in which a quote begins or ends a string
FEW = 3  # braces that a text may have without its depth being looked up
MOST_NAMES = 6


def _samples(path: str, kind: str, flags: str, inside: bool) -> list:
    """Values of a slot, of every usual shape, with their paths for names and texts."""
    if kind == "true":
        return [True]
    if kind == "range" or flags:
        return [(f"<{path}.0>", f"<{path}.1>")] if kind in ("iri", "ce") else []
    plain = [] if kind == "literal" else [f"<{path}>"]
    literals = [m.Literal(f"<{path}>", None, f"<{path}.lang>"), m.Literal(f"<{path}>", f"<{path}.datatype>")] if kind in ("literal", "value") else []
    return plain + literals + ([x for tag in EXPRESSIONS for x in _sample_nodes("ce", tag, path)] if kind == "ce" and not inside else [])


def _sample_nodes(of: str, tag: str, path: str) -> list[m.Node]:
    """Nodes of a type: names, literals, lists of two names, at most one expression of those."""
    fields = FIELDS[tag]
    if type_names()[f"{of}:" + ",".join(sorted(f[0] for f in fields))] != tag:
        return []
    each = product(*(_samples(f"{path}.{f[0]}", f[1], f[4], of == "ce") for f in fields))
    return [m.Node(tag, dict(zip((f[0] for f in fields), xs, strict=True))) for xs in each if sum(isinstance(x, m.Node) for x in xs) < 2]


def skeleton(data: Column, p: Column, most: int) -> Column:
    """JSON with its strings empty, but for the names of fields, of its pieces p; null where a quote may stand inside a string, or
    pieces are more than most. A string before a colon names a field."""
    piece = lambda i: F.get(p, F.lit(i))
    odd = lambda i: F.when(F.startswith(piece(i + 1), F.lit(":")), piece(i)).when(piece(i + 1).isNotNull(), "")
    return F.when(data.rlike(AS_IT_IS) & (F.size(p) <= most), F.concat_ws('"', *(odd(i) if i % 2 else piece(i) for i in range(most))))


def usual_shapes() -> list[tuple]:
    """(skeleton, pieces that are IRIs, then those of the annotation's subject, property and text) of usual axioms, with one
    annotation at most. Pieces are what stands between quotes, from 0."""
    note = "<note.property>"
    notes = [(), *(((note, x),) for x in _samples("note.value", "value", "", True))]
    found = []
    for a in (m.Node(x.tag, x.values, n) for tag in AXIOMS for x in _sample_nodes("axiom", tag, "") for n in notes):
        p = json.dumps(m.to_json(a), separators=(",", ":")).split('"')
        at = {x: i for i, x in enumerate(p)}
        iris = [at[x[0]] for x in m.mentions(a)]
        v = a.values.get("value")
        said = [at[a.values["subject"]], at[a.values["property"]], at[v.value if isinstance(v, m.Literal) else v]] if a.tag == "AnnotationAssertion" else [None] * 3
        if len(iris) <= MOST_NAMES:
            shape = '"'.join("" if i % 2 and p[i + 1][0] != ":" else x for i, x in enumerate(p))
            found.append((shape, *iris, *[None] * (MOST_NAMES - len(iris)), *said))
    return found


def entity_text_rows(axioms: DataFrame, depth: int | None = None) -> DataFrame:
    """entity_text of axioms (hash, data) in one pass: an axiom of a usual shape is cut at its quotes, any other goes the way of
    taken_apart(), row by row."""
    d = axioms.where(F.col("data").isNotNull()).select("hash", "data")
    x = F.col("data")
    if depth is None:
        depth = max(FEW, deepest(d.where(F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit(""))) > FEW)))
    places = [f"n{i}" for i in range(MOST_NAMES)] + ["subject", "property", "text"]
    known = usual_shapes()
    shapes = axioms.sparkSession.createDataFrame(known, "shape string, " + ", ".join(f"{c} int" for c in places))
    read = d.select("hash", "data", F.split(x, '"').alias("p"))
    read = read.withColumn("shape", skeleton(x, F.col("p"), max(k[0].count('"') for k in known) + 1))
    read = read.join(F.broadcast(shapes.withColumn("usual", F.lit(True))), "shape", "left")
    piece = lambda c: F.get(F.col("p"), F.col(c))
    # an array holds a null besides the names, for the row of what an annotation says
    quick = F.struct(F.array_distinct(F.array(*map(piece, places[:MOST_NAMES]), F.lit(None))).alias("names"), *(piece(c).alias(c) for c in places[MOST_NAMES:]))
    slots, types = constant(SLOTS, f"map<string,array<{SLOT}>>"), constant(type_names(), "map<string,string>")
    b, v = _Builder(), F.parse_json("data")

    def whole(y: Column, rows: Column) -> Column:
        names = F.array_distinct(F.transform(_mention_structs(y["notes"], rows), lambda z: z["entity_iri"]))
        said = lambda k, c: F.when(y["x"]["tag"] == "AnnotationAssertion", y["x"]["slots"][k]["members"][0][c])
        return F.struct(F.concat(names, F.array(F.lit(None).cast("string"))).alias("names"), said(1, "term").alias("subject"), said(0, "term").alias("property"), said(2, "value").alias("text"))

    parts = let(v, lambda z: F.struct(b.node(z, F.lit("axiom"), max(0, depth - 1)).alias("x"), b.notes(z).alias("notes")))
    slow = let(parts, lambda y: let(_rows(y["x"], F.lit(None).cast("string"), max(0, depth - 1)), lambda rows: whole(y, rows)))
    made = read.withColumn("slots", slots).withColumn("types", types).select("hash", F.when(F.col("usual"), quick).otherwise(slow).alias("y"))
    each = made.select("hash", "y.subject", "y.property", "y.text", F.explode("y.names").alias("iri"))
    local, named = local_name_of("iri"), F.col("iri").isNotNull()
    each = each.where(F.when(named, local != "").otherwise(F.col("subject").isNotNull()))
    return each.select("hash", F.coalesce("iri", "subject").alias("entity_iri"), F.when(named, LOCAL_NAME).otherwise(F.col("property")).alias("property"), F.when(named, local).otherwise(F.col("text")).alias("text"))
