"""Fill-in-the-middle: documents cut at two places and written as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

A text is held as its maximal character-class runs (separators, other characters), each with the units counted up to its
end. A cut after u units is found by binary search for the run that holds unit u, and its place inside the run by
arithmetic; no list of tokens is made. Units are tokens (a run of other characters with the separators before it, and
separators at the end of the text) or blocks of code points inside runs.

Where to cut and which form to take follow from a hash of seed and doc_id alone, so reruns, other partitions and retried
tasks agree. A text that contains a marker stays plain, which makes every output readable back: restored() needs nothing
but the output and its form.

Defined cases: null or empty text is plain, with 0 units and an empty output; a null doc_id hashes as the empty string;
rows that repeat are transformed alike; a text of separators alone is one token; other columns are not looked at; an
empty table gives an empty result. Cuts at the same place give an empty middle, cuts at the ends an empty prefix or suffix.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SEED = 42
MARKERS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
RATE = 50  # percent of the texts that are cut
SPM = 80  # percent of those in spm
FORM = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Runs:
    """Maximal class runs of a text: where each ends, the units up to there, and the code points of a unit inside it.

    A step of 0 says that the whole run is one unit or, for separators before a token, part of the next.
    """

    def __init__(self, text: str, block: int = 0):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        apart = (points == 32) | ((points >= 9) & (points <= 13))
        self.ends = np.append(np.flatnonzero(apart[1:] != apart[:-1]) + 1, len(points)) if len(points) else np.zeros(0, dtype=np.int64)
        self.starts = np.append(0, self.ends[:-1]) if len(points) else self.ends
        if block:
            units = -(-(self.ends - self.starts) // block)
        else:
            units = np.where(apart[self.starts], 0, 1)
            if len(units):
                units[-1] = 1  # separators at the end stand alone
        self.block, self.units = block, np.cumsum(units)

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, units: int) -> int:
        """Code points of the first so many units."""
        if units == 0:
            return 0
        k = int(np.searchsorted(self.units, units))
        if not self.block:
            return int(self.ends[k])
        inside = units - (int(self.units[k - 1]) if k else 0)
        return min(int(self.starts[k]) + inside * self.block, int(self.ends[k]))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str | None, seed: int = SEED, markers: tuple[str, str, str] = MARKERS, rate: int = RATE, spm: int = SPM, block: int = 0) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    runs = Runs(text, block)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(x in text for x in markers):
        return runs.n, "plain", None, None, text
    low, high = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    a, b = runs.offset(low), runs.offset(high)
    p, s, m = markers
    if h4 % 100 < spm:
        return runs.n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return runs.n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, markers: tuple[str, str, str] = MARKERS, rate: int = RATE, spm: int = SPM, block: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix_chars, middle_chars, output. block 0: units are tokens,
    else blocks of so many code points inside class runs. No marker may be part of another."""
    if len(set(markers)) < 3 or any(x == y or x in y for i, x in enumerate(markers) for j, y in enumerate(markers) if i != j):
        raise ValueError("markers must be three different strings, none inside another")
    if any(m[1:].find(m[0]) >= 0 for m in markers) or len({m[0] for m in markers}) > 1:
        raise ValueError("markers must share a first character that does not recur in them")
    small_batches(docs.sparkSession)

    import pyarrow as pa

    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, *transform(i, t.as_py(), seed, markers, rate, spm, block)) for i, t in zip(ids, batch.column(1), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, FORM)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text of an output, from the output and its form alone."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(a) + len(second) + 1)
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.char_length(b) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
