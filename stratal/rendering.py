"""Display helpers of the tool surface: axiom lines, previews, diffs, drift and paging headers, error texts."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame

from stratal.facade import ConfirmationNeeded
from stratal.operators.mutations import NotFound
from stratal.plans import model as m
from stratal.plans.constraints import QueryError, SelectionNotFound
from stratal.sources.store import Conflict, StoreError

PREVIEW_ROWS, DIFF_ROWS, SHORT = 10, 20, 12


def plural(n: int, noun: str) -> str:
    return f"{n:,} {noun}" if n == 1 else f"{n:,} {noun[:-1] + 'ies' if noun.endswith('y') else noun + 's'}"


def axiom_line(h: str, axiom: m.Node, labels: dict[str, str] | None = None) -> str:
    """Short hash, functional form, labels of its IRIs and its annotations."""
    names = [f"{iri} = {labels[iri]!r}" for iri in dict.fromkeys(x[0] for x in m.mentions(axiom)) if labels and iri in labels]
    notes = "".join(f"\n    {p} {m.render(v)}" for p, v in axiom.annotations)
    return f"{h[:SHORT]}  {m.render(axiom)}" + (f"  [{'; '.join(names)}]" if names else "") + notes


def preview(rows: DataFrame, size: int) -> str:
    """The first rows of a written selection (hash and data, or entity_iri)."""
    out = [axiom_line(r["hash"], m.parse(json.loads(r["data"]))) if "hash" in rows.columns else r["entity_iri"] for r in rows.limit(PREVIEW_ROWS).collect()]
    return "\n".join(out + ([f"... {size - len(out):,} more"] if size > len(out) else []))


def diff(lines: Iterable[tuple[str, str]], total: int) -> str:
    """Lines marked +, - or =, at most DIFF_ROWS of them."""
    shown = [f"{sign} {text}" for _, (sign, text) in zip(range(DIFF_ROWS), lines, strict=False)]
    return "\n".join(shown + ([f"... {total - len(shown):,} more"] if total > len(shown) else []))


def drift_header(name: str, kind: str, size: int, present: int) -> str:
    return f"{name}: {plural(size, 'axiom' if kind == 'axiom' else 'entity')}" + (f", {size - present:,} missing" if present < size else "")


def paging_header(offset: int, shown: int, total: int) -> str:
    return f"Showing {offset + 1}-{offset + shown} of {total:,}" if shown else f"Showing 0 of {total:,}"


def error_text(e: Exception) -> str:
    """What a tool's caller reads of an error."""
    match e:
        case ConfirmationNeeded():
            return str(e)
        case SelectionNotFound():
            return f"Selection not found: {e.args[0]}"
        case NotFound():
            return f"Not found: {e.args[0]}"
        case Conflict():
            return f"The store changed meanwhile: {e}"
        case m.ModelError():
            return f"Invalid input: {e}"
        case QueryError() | StoreError():
            return str(e)
    return f"Internal error: {type(e).__name__}"
