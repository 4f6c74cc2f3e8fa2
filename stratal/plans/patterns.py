"""Structural patterns over axioms, compiled to joins on the node table.

A pattern is a dict with "type" and the fields of that axiom or expression. A slot is "*" (anything), "?name" (a variable:
equal text wherever the name recurs) or an IRI; fields of expressions also take expression patterns, literal fields take
the rendered literal, unordered lists take a sibling "<field>_match" of "exact" (default) or "partial". All assignments of
list members are considered, also across fields; slots match data ranges too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.plans.constraints import WithTypes, axiom_table
from stratal.plans.model import IRI, ModelError
from stratal.plans.spec import AXIOMS, EXPRESSION_HOLDERS, EXPRESSIONS, FIELDS
from stratal.sources.ontology import Ontology

VARIABLE = re.compile(r"\?[a-zA-Z_][a-zA-Z0-9_]*\Z")


@dataclass(frozen=True)
class Pattern:
    tag: str
    fields: dict  # field -> slot, Pattern, or tuple of them
    modes: dict  # list field -> "exact" or "partial"


def parse_pattern(obj: dict) -> Pattern:
    tag = obj.get("type")
    if tag not in AXIOMS and tag not in EXPRESSIONS:
        raise ModelError(f"no pattern type: {tag!r}")
    fields, modes, known = {}, {}, {"type"}
    for name, kind, _, _, flags in FIELDS[tag]:
        if kind == "true":
            continue
        known |= {name, f"{name}_match"} if flags == "u" else {name}
        if name not in obj:
            raise ModelError(f"{tag} pattern lacks {name}")
        v = obj[name]
        fields[name] = tuple(map(_slot, v)) if flags else _slot(v)
        if flags:
            modes[name] = obj.get(f"{name}_match", "exact") if flags == "u" else "ordered"
            if modes[name] not in ("exact", "partial", "ordered"):
                raise ModelError(f"{name}_match must be exact or partial")
    if unknown := set(obj) - known:
        raise ModelError(f"{tag} pattern has no {', '.join(sorted(unknown))}")
    return Pattern(tag, fields, modes)


def _slot(x):
    if isinstance(x, dict):
        return parse_pattern(x)
    if not isinstance(x, str) or (x.startswith("?") and not VARIABLE.match(x)):
        raise ModelError(f"no slot: {x!r}")
    return x


class _Compiler:
    def __init__(self, nodes: DataFrame):
        self.nodes, self.count, self.bound = nodes, 0, {}

    def child(self, df: DataFrame, parent: str, name: str, condition=None) -> tuple[DataFrame, str]:
        """df joined with the children of a node in one field; returns the id prefix of the child's columns."""
        self.count += 1
        p = f"n{self.count}"
        rows = self.nodes.where(F.col("field") == name)
        if condition is not None:
            rows = rows.where(condition)
        cols = {"hash": "hash", "parent_id": parent, "node_id": f"{p}_id", "ord": f"{p}_ord", "list_size": f"{p}_size", "term": f"{p}_term", "node_repr": f"{p}_repr"}
        return df.join(rows.select(*(F.col(c).alias(a) for c, a in cols.items())), ["hash", parent]), p

    def slot(self, df: DataFrame, p: str, x) -> DataFrame:
        """What a slot asks of an already joined child beyond its existence."""
        if isinstance(x, Pattern):
            return self.fields(df, f"{p}_id", x)
        if x.startswith("?"):
            value = F.coalesce(f"{p}_term", f"{p}_repr")
            if x in self.bound:
                return df.where(value == F.col(self.bound[x]))
            self.bound[x] = f"v_{x[1:]}"
            return df.withColumn(self.bound[x], value)
        return df

    @staticmethod
    def condition(x):
        """What a slot asks of the child's own row."""
        if isinstance(x, Pattern):
            return (F.col("kind") == "expr") & (F.col("tag") == x.tag)
        if x == "*" or x.startswith("?"):
            return F.col("kind") != "empty"
        return F.col("kind").isin("iri", "enum", "typed", "lang") & (F.col("term") == x)

    def fields(self, df: DataFrame, parent: str, pattern: Pattern) -> DataFrame:
        for name, slots in pattern.fields.items():
            if not isinstance(slots, tuple):
                if slots != "*":
                    df, p = self.child(df, parent, name, self.condition(slots))
                    df = self.slot(df, p, slots)
                continue
            mode = pattern.modes[name]
            if not slots:
                if mode == "exact":
                    df, _ = self.child(df, parent, name, F.col("kind") == "empty")
                continue
            taken: list[str] = []
            for i, x in enumerate(slots):
                if mode == "ordered" and x == "*" and i:
                    continue  # the first member has checked the length
                condition = self.condition(x)
                if mode in ("ordered", "exact"):
                    condition = condition & (F.col("list_size") == len(slots))
                if mode == "ordered":
                    condition = condition & (F.col("ord") == i)
                df, p = self.child(df, parent, name, condition)
                if mode != "ordered":
                    for t in taken:
                        df = df.where(F.col(f"{p}_ord") != F.col(t))
                    taken.append(f"{p}_ord")
                df = self.slot(df, p, x)
        return df


def concrete_terms(pattern: Pattern) -> list[str]:
    """IRIs that every match mentions: slots that are neither variables nor literals, at any depth."""
    out: list[str] = []
    kinds = {f[0]: f[1] for f in FIELDS[pattern.tag]}
    for name, slots in pattern.fields.items():
        for x in slots if isinstance(slots, tuple) else (slots,):
            if isinstance(x, Pattern):
                out += concrete_terms(x)
            elif kinds[name] in ("iri", "ce", "value") and x != "*" and not x.startswith(("?", '"')) and IRI.match(x):
                out.append(x)
    return list(dict.fromkeys(out))


def match_bindings(o: Ontology, pattern: dict, within: tuple = ()) -> DataFrame:
    """(hash, v_<name>...) of every match: an axiom pattern matches axioms, an expression pattern any nested expression."""
    p = parse_pattern(pattern)
    if p.tag in AXIOMS:
        roots = o.nodes.where((F.col("parent_id") == -1) & (F.col("tag") == p.tag))
        types = (WithTypes((p.tag,)),)
    else:
        roots = o.nodes.where((F.col("kind") == "expr") & (F.col("tag") == p.tag))
        types = (WithTypes(EXPRESSION_HOLDERS),)
    terms = concrete_terms(p)
    if terms:  # axioms that mention them all, found in the relation that files keep sorted by IRI
        wanted = o.mentions.where(F.col("entity_iri").isin(*terms)).select("hash", "entity_iri").distinct()
        wanted = wanted.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("hash")
        roots = roots.join(wanted, "hash", "left_semi")
    c = _Compiler(o.nodes)
    found = c.fields(roots.select("hash", F.col("node_id").alias("root_id")), "root_id", p)
    if within:
        found = found.join(axiom_table(o, (*types, *within))[0].select("hash"), "hash", "left_semi")
    return found.select("hash", *c.bound.values()).distinct()


def match_axioms(o: Ontology, pattern: dict, limit: int | None = None, within: tuple = ()) -> DataFrame:
    """Hashes of the axioms that match, in hash order."""
    found = match_bindings(o, pattern, within).select("hash").distinct().orderBy("hash")
    return found if limit is None else found.limit(limit)
