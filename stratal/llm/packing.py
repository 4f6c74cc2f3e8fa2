"""Best-fit packing of tokenised documents into sequences, after a Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the instance is its histogram: at most ``capacity`` counts, however many
documents there are. The driver solves the histogram (counts only), every document is then placed by its rank among the
pieces of its length. The reduction goes over the lengths from the longest: a bin is fixed when the longest item that
fits beside the current one dominates every other feasible set (it fills the bin, only one item fits, or no two items
that fit together exceed it). What is left is packed best-fit decreasing, many equal bins at a time.

Defined cases: null or empty text is the closing id alone (one piece of length 1); a document longer than the capacity is
cut into full pieces and a last shorter one; a null doc_id is carried; rows repeated whole are packed each; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, worker_state

CAPACITY = 2048
END_ID = 0
CACHE_ENTRIES = 250_000  # of each of a worker's two caches, which are emptied when full
ROWS_PER_RANK_GROUP = 20_000
UNUSUAL = r"[\x1c-\x1f\x85\u180e\u200b\u2028\u2029\ufeff]|<\|"
PLAIN = r"[\x21-\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u0148\u014a-\u017e]+"  # composed characters with simple lower case


def split_pattern(spec_json: str) -> str | None:
    """The pattern by which the tokenizer cuts pieces, if pieces end words and never cross white space."""
    spec = json.loads(spec_json)
    step = (spec["pre_tokenizer"].get("pretokenizers") or [{"type": ""}])[0]
    return step["pattern"]["Regex"] if spec["model"].get("end_of_word_suffix") == "</w>" and step["type"] == "Split" else None


class _Encoder:
    """ids of a text by the tokenizer, from caches over white-space chunks and their pieces.

    Pieces never cross white space in this vocabulary's pre-tokenizer, so ids of a text are those of its chunks in turn.
    Texts with characters on whose class libraries differ, and texts with special tokens, go through the tokenizer whole.
    """

    def __init__(self, spec_json: str, pattern: str | None):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_str(spec_json)
        self.model = self.tok.model
        self.chunked = pattern is not None
        self.pattern = regex.compile(pattern) if self.chunked else None
        self.unusual = regex.compile(UNUSUAL)
        self.plain = regex.compile(PLAIN)
        self.to_symbols = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _split(self, chunk: str) -> list[str] | None:
        """The chunk's pieces; None where only the tokenizer knows."""
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ".,;:!?":
                return [low[:-1], low[-1]]
            return self.pattern.findall(low)
        return self.pattern.findall(chunk.lower()) if self.plain.fullmatch(chunk) else None

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself; all other bytes have symbols of their own
        symbols = piece if piece.isascii() and piece.isprintable() else self.to_symbols(piece)[0][0]
        ids = [t.id for t in self.model.tokenize(symbols)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces.clear()
        self.pieces[piece] = out
        return out

    def _chunk(self, chunk: str) -> bytes:
        parts = self._split(chunk)
        known = self.pieces.get
        out = self._whole(chunk) if parts is None else b"".join([known(p) or self._piece(p) for p in parts])
        if len(chunk) <= 64:
            if len(self.chunks) >= CACHE_ENTRIES:
                self.chunks.clear()
            self.chunks[chunk] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not self.chunked or self.unusual.search(text):
            return self._whole(text)
        parts = text.split()
        found = list(map(self.chunks.get, parts))
        if None in found:
            found = [self._chunk(c) if f is None else f for c, f in zip(parts, found, strict=True)]
        return b"".join(found)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32). The tokenizer's file is read on the driver and sent to the executors."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec_json = f.read()
    name = f"encoder_{zlib.crc32(spec_json.encode('utf-8'))}"
    pattern = split_pattern(spec_json)
    sent = docs.sparkSession.sparkContext.broadcast(spec_json)  # one vocabulary: a few MB

    def run(batches):
        encode = worker_state(name, lambda: _Encoder(sent.value, pattern))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                view = memoryview(ids)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], type=t) for t in kinds], names=names)

    import pyarrow as pa

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the instance: counts by length -------------------------------------------------------------------------------


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple, int]], dict[int, int]]:
    """Bins fixed by dominance, as (((length, how many), ...), number of such bins), and the counts left."""
    left, fixed = dict(counts), []
    sizes = sorted(left)

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            sizes.pop(bisect_left(sizes, size))

    moved = True
    while moved:
        moved = False
        for big in sorted(sizes, reverse=True):
            while left.get(big):
                room = capacity - big
                own = left[big] > 1
                at = bisect_right(sizes, room)
                best = 0
                if at:
                    best = sizes[at - 1]
                    if best == big and not own:
                        best = sizes[at - 2] if at > 1 else 0
                if not best:  # nothing fits beside it
                    fixed.append((((big, 1),), left[big]))
                    take(big, left[big])
                    moved = True
                    break
                if best != room and _best_pair(sizes, left, big, room) > best:
                    break
                if best == big:
                    n = left[big] // 2
                    fixed.append((((big, 2),), n))
                    take(big, 2 * n)
                else:
                    n = min(left[big], left[best])
                    fixed.append((((big, 1), (best, 1)), n))
                    take(best, n)
                    take(big, n)
                moved = True
    return fixed, left


def _best_pair(sizes: list[int], left: dict[int, int], big: int, room: int) -> int:
    """Largest sum of two or more further items that fit into room, 0 if no two do (bounded from above by room)."""
    free = lambda s: left[s] - (s == big)
    smallest: list[int] = []  # the two smallest further items
    for s in sizes:
        smallest += [s] * min(2, free(s))
        if len(smallest) > 1:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return 0
    low = smallest[0]
    best, lo, hi = 0, 0, bisect_right(sizes, room) - 1
    while lo <= hi:  # two pointers over the sorted lengths
        a, b = sizes[lo], sizes[hi]
        if a + b > room or (lo == hi and free(a) < 2):
            hi -= 1
        else:
            best = max(best, a + b)
            lo += 1
    if 3 * low <= room:  # three or more may fill it
        best = max(best, room)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over counts; equal bins are kept as one entry with a number."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[tuple, int]]] = {}

    def put(room: int, pattern: tuple, n: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, pattern, n = capacity, (), -(-todo // (capacity // size))
            else:
                room = rooms[at]
                pattern, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            per = room // size
            full = min(n, todo // per)
            if full:
                put(room - per * size, (*pattern, (size, per)), full)
                todo -= full * per
            rest = n - full
            if rest and todo:  # fewer than per items are left: one bin takes them
                part = min(todo, per)
                put(room - part * size, (*pattern, (size, part)), 1)
                todo -= part
                rest -= 1
            if rest and pattern:
                put(room, pattern, rest)
    return [x for each in bins.values() for x in each]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """All bins of the instance: dominance first, best fit for the remainder."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(plan: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, items in each sequence, offset of the first) in order of rank."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    seq = 0
    for pattern, n in plan:
        at = 0
        for size, per in pattern:
            rows.setdefault(size, []).append((ranks.get(size, 0), seq, per, at))
            ranks[size] = ranks.get(size, 0) + n * per
            at += size * per
        seq += n
    return {size: np.array(x, dtype=np.int64) for size, x in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cutted = cut(pieces(docs, tokenizer_path, capacity, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    table = slots(solve(histogram, capacity))
    groups = max(16, -(-sum(histogram.values()) // ROWS_PER_RANK_GROUP))
    # rank among the pieces of a length: dealt over groups, so that a frequent length is ranked by many tasks
    dealt = cutted.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    starts = dealt.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "grp", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.join(starts, ["length", "grp"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1)

    def place(batches):
        for pdf in batches:
            seq, off = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            lengths, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                rows = table[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 1] + k // row[:, 2], row[:, 3] + (k % row[:, 2]) * size
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "start": pdf["start"], "length": lengths, "ids_crc32": pdf["ids_crc32"], "sequence_id": seq, "offset": off})

    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*order, "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
