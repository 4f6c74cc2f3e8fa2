"""Axioms on the driver: validation, structural dispatch, canonical form, rendering and the walk over nodes.

The walk is symbolic: leaves may be Python strings (API input, JSON rows) or Sql expressions (table templates), so one
walk gives mention rows and node rows for both.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from .spec import AXIOMS, DATATYPES, ENTITY_TYPES, EXPRESSIONS, FIELDS, MIN_MEMBERS, OPTIONAL, RANGES

_PREFIX = r"(?:[A-Za-z_][A-Za-z0-9_.-]*)?"
IRI = re.compile(rf"{_PREFIX}:[^\s\x00-\x1f]+\Z")
PREFIX_NAME = re.compile(rf"{_PREFIX}\Z")
NAMESPACE = re.compile(r"\S+:\S+\Z")
SELECTION_NAME = re.compile(r"[A-Za-z][A-Za-z0-9._/:-]{0,63}\Z")
LANG = re.compile(r"[A-Za-z]{2,3}(-[A-Za-z0-9]+)*\Z")
BUILTIN_PREFIXES = ("rdf", "rdfs", "owl", "xsd")
LOCAL_NAME = "local_name"


class ModelError(ValueError):
    """Input that is no axiom, expression, range or literal."""


@dataclass(frozen=True)
class Sql:
    """A string-valued SQL expression in place of a leaf."""

    text: str


@dataclass(frozen=True)
class Literal:
    value: Any
    datatype: Any = None
    lang: Any = None


@dataclass(frozen=True)
class Node:
    """An axiom, expression or range; values are leaves, Nodes, Literals or tuples of them."""

    tag: str
    values: dict = field(default_factory=dict)
    annotations: tuple = ()  # of (property, IRI or Literal), axioms only


def check_iri(text: Any) -> str:
    if not isinstance(text, str) or not IRI.match(text):
        raise ModelError(f"not an IRI (prefix:local): {text!r}")
    return text


def make(tag: str, annotations: tuple = (), **values: Any) -> Node:
    """A checked node; lists become tuples, annotations lose repeats."""
    out = {}
    for name, kind, _, _, flags in FIELDS[tag]:
        if kind == "true":
            out[name] = True
            continue
        if name not in values:
            if (tag, name) in OPTIONAL:
                out[name] = ()
                continue
            raise ModelError(f"{tag} lacks {name}")
        v = values[name]
        if flags:
            v = tuple(v)
            if (tag, name) not in OPTIONAL and len(v) < MIN_MEMBERS:
                raise ModelError(f"{tag}.{name} needs {MIN_MEMBERS} members")
        for x in v if flags else (v,):
            _check(tag, name, kind, x)
        out[name] = v
    if unknown := set(values) - {f[0] for f in FIELDS[tag]}:
        raise ModelError(f"{tag} has no {', '.join(sorted(unknown))}")
    if tag == "HasKey" and not out["has_key_object_properties"] and not out["has_key_data_properties"]:
        raise ModelError("HasKey needs a property")
    return Node(tag, out, tuple(dict.fromkeys(annotations)))


def _check(tag: str, name: str, kind: str, x: Any) -> None:
    if isinstance(x, Sql):
        return
    ok = {
        "iri": lambda: IRI.match(x) if isinstance(x, str) else False,
        "ce": lambda: (IRI.match(x) if isinstance(x, str) else isinstance(x, Node) and x.tag in EXPRESSIONS),
        "range": lambda: isinstance(x, Node) and x.tag in RANGES,
        "literal": lambda: isinstance(x, Literal),
        "value": lambda: isinstance(x, Literal) or (isinstance(x, str) and IRI.match(x)),
        "entity_type": lambda: x in ENTITY_TYPES,
        "datatype": lambda: x in DATATYPES,
    }[kind]()
    if not ok:
        raise ModelError(f"{tag}.{name}: {x!r} is no {kind}")


# ---- JSON ----------------------------------------------------------------------------------------------------------


def _literal(obj: dict) -> Literal:
    if not isinstance(obj.get("value"), str) or set(obj) - {"value", "datatype", "lang"} or len(obj) > 2:
        raise ModelError(f"no literal: {obj!r}")
    if "lang" in obj:
        if not LANG.match(obj["lang"]):
            raise ModelError(f"no language tag: {obj['lang']!r}")
        return Literal(obj["value"], None, obj["lang"])
    datatype = obj.get("datatype", "xsd:string")
    if datatype not in DATATYPES:
        raise ModelError(f"no datatype: {datatype!r}")
    return Literal(obj["value"], datatype)


def _fit(obj: dict, table: dict) -> str:
    """The type whose fields fit best: all required ones there, none unknown, the fewest declared."""
    keys = set(obj) - {"annotations"}
    best = None
    for tag, fields in table.items():
        declared = {f[0] for f in fields}
        required = {f[0] for f in fields if (tag, f[0]) not in OPTIONAL}
        if required <= keys <= declared and (best is None or len(declared) < len(FIELDS[best])):
            best = tag
    if best is None:
        near = max(table, key=lambda t: len(keys & {f[0] for f in table[t]}) - len(keys ^ {f[0] for f in table[t]}) / 100)
        names = {f[0] for f in table[near]}
        raise ModelError(f"closest to {near}: missing {sorted(names - keys)}, unknown {sorted(keys - names)}")
    return best


def _read(kind: str, x: Any) -> Any:
    if kind == "ce" and isinstance(x, dict):
        return parse(x, EXPRESSIONS)
    if kind == "range" and isinstance(x, dict):
        return parse(x, RANGES)
    if kind in ("literal", "value") and isinstance(x, dict):
        return _literal(x)
    return x


def parse(obj: dict, table: dict | None = None) -> Node:
    """A node from its JSON object; the type follows from the field names."""
    tag = _fit(obj, AXIOMS if table is None else table)
    values = {}
    for name, kind, _, _, flags in FIELDS[tag]:
        if name in obj and kind != "true":
            values[name] = tuple(_read(kind, x) for x in obj[name]) if flags else _read(kind, obj[name])
        if kind == "true" and obj.get(name) is not True:
            raise ModelError(f"{tag}.{name} must be true")
    notes = tuple((check_iri(a["property"]), _read("value", a["value"])) for a in obj.get("annotations", ()))
    return make(tag, notes, **values)


def to_json(x: Any, annotations: bool = True) -> Any:
    """Plain JSON value in field order; annotations last where there are any."""
    if isinstance(x, Literal):
        return {"value": x.value, "lang": x.lang} if x.lang is not None else {"value": x.value, "datatype": x.datatype}
    if isinstance(x, tuple):
        return [to_json(y) for y in x]
    if isinstance(x, Node):
        out = {k: to_json(v) for k, v in x.values.items()}
        if annotations and x.annotations:
            out["annotations"] = [{"property": p, "value": to_json(v)} for p, v in x.annotations]
        return out
    return x


def _compact(x: Any) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def _ordered(x: Any) -> Any:
    """JSON value with unordered lists sorted: strings as they are, objects by their compact form."""
    if isinstance(x, Node):
        unordered = {f[0] for f in FIELDS[x.tag] if f[4] == "u"}
        return {k: sorted((_ordered(y) for y in v), key=lambda y: y if isinstance(y, str) else _compact(y)) if k in unordered else _ordered(v) for k, v in x.values.items()}
    if isinstance(x, tuple):
        return [_ordered(y) for y in x]
    return to_json(x)


def canonical(axiom: Node) -> str:
    return _compact(_ordered(axiom))


def content_hash(axiom: Node) -> str:
    return hashlib.sha256(canonical(axiom).encode()).hexdigest()


# ---- rendering and walking -----------------------------------------------------------------------------------------


def parts(x: Any) -> list:
    """Functional-syntax text of a value as a list of strings and Sql; fields that are annotations or negation are left out."""
    if isinstance(x, Literal):
        return ['"', x.value, '"@', x.lang] if x.lang is not None else ['"', x.value, '"^^', x.datatype]
    if isinstance(x, tuple):
        out: list = []
        for i, y in enumerate(x):
            out += [", "] * bool(i) + parts(y)
        return out
    if isinstance(x, Node):
        shown = [(k, v) for k, v in x.values.items() if v is not True]
        out = [x.tag, "("]
        for i, (_, v) in enumerate(shown):
            inner = parts(v)
            if isinstance(v, tuple) and len(shown) > 1:
                inner = ["[", *inner, "]"]
            out += [", "] * bool(i) + inner
        return [*out, ")"]
    return [x]


def text_of(pieces: list) -> Any:
    """One string, or one Sql where a piece is."""
    if not any(isinstance(p, Sql) for p in pieces):
        return "".join(pieces)
    quoted = [p.text if isinstance(p, Sql) else "'" + p.replace("'", "''") + "'" for p in pieces]
    return Sql("(" + " || ".join(f"CAST({q} AS STRING)" if isinstance(p, Sql) else q for p, q in zip(pieces, quoted, strict=True)) + ")")


def render(x: Any) -> Any:
    return text_of(parts(x))


def mentions(axiom: Node) -> Iterator[tuple]:
    """(iri, role, position) of every mention, annotations first, then depth-first in field order."""
    for prop, value in axiom.annotations:
        yield prop, "AnnotationProperty", "property"
        if not isinstance(value, Literal):
            yield value, None, "value"
    yield from _inside(axiom, None)


def _inside(node: Node, inherited: str | None) -> Iterator[tuple]:
    for name, kind, role, position, flags in FIELDS[node.tag]:
        where = position or inherited
        if role == "@entity_type":
            role = node.values["entity_type"]
        for x in node.values[name] if flags else (node.values[name],):
            if isinstance(x, Node):
                yield from _inside(x, where)
            elif kind in ("iri", "ce", "value") and not isinstance(x, Literal):
                yield x, role, where


def walk_nodes(axiom: Node) -> list[dict]:
    """Node rows: node_id, parent_id, field, ord, list_size, kind, tag, term, node_repr (annotations left out)."""
    rows: list[dict] = []

    def visit(x: Any, parent: int, name: str, ord_: int, size: int) -> None:
        me = len(rows)
        row = {"node_id": me, "parent_id": parent, "field": name, "ord": ord_, "list_size": size, "tag": None, "term": None, "node_repr": None}
        rows.append(row)
        if isinstance(x, Node):
            row |= {"kind": "range" if x.tag in RANGES else "expr" if x.tag in EXPRESSIONS else "axiom", "tag": x.tag, "node_repr": render(x)}
            for fname, kind, _, _, flags in FIELDS[x.tag]:
                v = x.values[fname]
                if kind == "true":
                    continue
                if flags:
                    if not v:
                        rows.append({"node_id": len(rows), "parent_id": me, "field": fname, "ord": -1, "list_size": 0, "kind": "empty", "tag": None, "term": None, "node_repr": None})
                    for i, y in enumerate(v):
                        visit(y, me, fname, i, len(v))
                else:
                    visit(v, me, fname, 0, 1)
                    if kind in ("entity_type", "datatype"):
                        rows[-1]["kind"] = "enum"
        elif isinstance(x, Literal):
            row |= {"kind": "lang" if x.lang is not None else "typed", "term": render(x)}
        else:
            row |= {"kind": "iri", "term": x}

    visit(axiom, -1, "", 0, 1)
    return rows


def entity_texts(axiom: Node) -> list[tuple]:
    """(iri, property, text): the subject's annotation, and the local name of every distinct IRI."""
    out = []
    for iri in dict.fromkeys(m[0] for m in mentions(axiom)):
        if isinstance(iri, Sql):
            out.append((iri, LOCAL_NAME, Sql(f"substring({iri.text}, instr({iri.text}, ':') + 1)")))
        elif iri.split(":", 1)[1]:
            out.append((iri, LOCAL_NAME, iri.split(":", 1)[1]))
    if axiom.tag == "AnnotationAssertion":
        v = axiom.values["value"]
        out.append((axiom.values["subject"], axiom.values["property"], v.value if isinstance(v, Literal) else v))
    return out


def axiom_texts(axiom: Node) -> list[tuple]:
    """(property, text) of every annotation of the axiom."""
    return [(p, v.value if isinstance(v, Literal) else v) for p, v in axiom.annotations]


def rename(x: Any, old: str, new: str) -> Any:
    """x with IRI-typed values replaced; literals are untouched."""
    if isinstance(x, Node):
        kinds = {f[0]: f[1] for f in FIELDS[x.tag]}
        values = {k: rename(v, old, new) if kinds[k] in ("iri", "ce", "value", "range") else v for k, v in x.values.items()}
        notes = tuple(dict.fromkeys((rename(p, old, new), rename(v, old, new)) for p, v in x.annotations))
        return Node(x.tag, values, notes)
    if isinstance(x, tuple):
        return tuple(rename(y, old, new) for y in x)
    return new if isinstance(x, str) and x == old else x
