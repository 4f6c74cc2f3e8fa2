"""Alignment of two tokenizers over the same texts, by the byte offsets at which their tokens end.

In a worker, token lengths are looked up by id and summed up to end offsets (cumsum), over many texts at once; offsets where tokens
of both sides end are the common cuts (intersect1d), which part the texts into groups; a token's group is found by searchsorted.
Tokens that end together are linked: per cut, each of one side with each of the other, expanded with repeat. Over the corpus, the
links of an id pair are counted in two shuffles, first by pair and salt, then by pair.

Two tokens that end together cover the same bytes up to there, so the shorter one is the end of the longer one. The number of
pairs is therefore bounded by the vocabularies, whatever the corpus: a token has no more suffixes than bytes. pair_bound()
gives the bound, and the counts are sent to the workers under it (a few MB for the two vocabularies used here), so no row
of a document is shuffled for them.

Defined cases: null and empty texts, and texts that a side does not give back byte by byte (such as a U+2581 that the second
side turns into a blank), have no tokens: zeros and an empty string of groups; a null doc_id is carried; rows that repeat count
each; special tokens' strings inside texts are plain text; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, worker_state

SALTS = 32
CHUNK = 1 << 19  # characters that a worker aligns at once; a longer text goes alone
ROW_GROUP = 32 << 20
FLUSH = 1 << 21  # links that a worker gathers before it adds them up
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ALIGNED = "doc_id long, ids_a array<int>, ids_b array<int>, sizes_a array<int>, sizes_b array<int>"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, then U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteSide:
    """A byte-level BPE from its JSON file: ids of texts, and the bytes of every id."""

    def __init__(self, spec_json: str):
        spec = json.loads(spec_json)
        symbols = byte_symbols()
        vocab = {t["content"]: t["id"] for t in spec["added_tokens"]} | spec["model"]["vocab"]
        special = {t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if i in special else bytes(symbols[c] for c in token)
        self.fast = self._ranked(spec)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(spec_json)
            self.slow.encode_special_tokens = True

    def _ranked(self, spec: dict):
        """An encoder that works by rank, where ids rise with the order of merges and texts are cut by the common pattern."""
        before, model = spec["pre_tokenizer"], spec["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ordered = all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged))
        plain = before and before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not spec["normalizer"]
        if not ordered or not plain or model.get("unk_token") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray | list[int]:
        if self.fast is not None:
            return self.fast.encode_to_numpy(" " + text, disallowed_special=())
        return self.slow.encode(" " + text, add_special_tokens=False).ids

    def gives_back(self, ids: np.ndarray | list[int], want: bytes) -> bool:
        # by rank, the pattern's pieces cover a text and tokens cover their piece
        return self.fast is not None or b"".join(map(self.bytes.__getitem__, ids)) == want


class PieceSide:
    """A sentencepiece model from its file's bytes: ids of texts, and the bytes of every id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.sp.encode(text)

    def gives_back(self, ids: list[int], want: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == want


def link(ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all tokens that end together; tokens of no bytes end where the one before does."""
    first_a, first_b = np.searchsorted(ends_a, cuts, "left"), np.searchsorted(ends_b, cuts, "left")
    of_a, of_b = np.searchsorted(ends_a, cuts, "right") - first_a, np.searchsorted(ends_b, cuts, "right") - first_b
    each = of_a * of_b
    place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)  # number of a link among those of its cut
    per_a = np.repeat(of_b, each)
    return np.repeat(first_a, each) + place // per_a, np.repeat(first_b, each) + place % per_a


def linked_ids(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, lengths: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked ids of a and b, and the group each link is of. Where no token is empty, one link closes each group."""
    last_a, last_b = np.cumsum(sizes_a) - 1, np.cumsum(sizes_b) - 1
    if lengths[0].all() and lengths[1].all():
        return a[last_a], b[last_b], np.arange(len(sizes_a))
    ends_a, ends_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
    at_a, at_b = link(ends_a, ends_b, ends_a[last_a])
    return a[at_a], b[at_b], np.searchsorted(last_a, at_a, "left")


class Aligner:
    """Both tokenizers in a worker, and the lengths of their tokens."""

    def __init__(self, spec_json: str, model: bytes):
        self.sides = ByteSide(spec_json), PieceSide(model)
        self.lengths = token_lengths(*(s.bytes for s in self.sides))
        self.distinct = all(x.all() for x in self.lengths)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """ids of both sides; none where a side does not give the text back."""
        if text:
            want, found = (" " + text).encode(), []
            for side in self.sides:
                ids = side.encode(text)
                if not side.gives_back(ids, want):
                    break
                found.append(np.asarray(ids, dtype=np.int32))
            else:
                return found[0], found[1]
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def align(self, texts: list[str | None]) -> tuple:
        """(ids of a, ids of b, tokens of a and of b per group; each flat, with the counts per text) of some texts.

        Both sides of a text have the same bytes, so end offsets run on from text to text alike.
        """
        encoded = [self.encode(t) for t in texts]
        n_a, n_b = ([len(x[k]) for x in encoded] for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in encoded]) if encoded else np.zeros(0, dtype=np.int32) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=self.distinct)
        sizes_a = np.bincount(np.searchsorted(cuts, ends_a, "left"), minlength=len(cuts))
        sizes_b = np.bincount(np.searchsorted(cuts, ends_b, "left"), minlength=len(cuts))
        upto = np.append(0, ends_a)[np.cumsum(n_a, dtype=np.int64)] if texts else np.zeros(0, dtype=np.int64)  # bytes up to each text's end
        n_groups = np.diff(np.searchsorted(cuts, upto, "right"), prepend=0)
        return (a, n_a), (b, n_b), (sizes_a, n_groups), (sizes_b, n_groups)


def token_lengths(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)


class Printer:
    """Group strings a1,a2|b1;a3|b2 from flat arrays of many texts, as rows of digits without a loop over tokens."""

    def __init__(self, width: int):
        digits = len(str(max(width - 1, 0))) + 1
        rows = [f"{i}{mark}".encode().ljust(digits, b"\0") for mark in ",|;" for i in range(width)]
        self.width, self.table = width, np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, digits)
        self.chars = (self.table != 0).sum(1)

    def __call__(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, groups: np.ndarray) -> list[str]:
        """groups: how many groups each text has."""
        after_a, after_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        rows = np.empty(len(a) + len(b), dtype=np.int64)
        # a token's place: those of its side before it, and the other side's of the groups before (or with) its group
        rows[np.arange(len(a)) + np.repeat(after_b - sizes_b, sizes_a)] = a
        rows[np.arange(len(b)) + np.repeat(after_a, sizes_b)] = b
        last = after_a + after_b - 1
        rows[last] += 2 * self.width
        rows[last - sizes_b] += self.width
        ends = np.append(0, np.cumsum(self.chars[rows]))[np.append(0, last + 1)][np.append(0, np.cumsum(groups))]
        flat = self.table[rows].ravel()
        text = flat[flat != 0].tobytes().decode("ascii")
        return [text[i : max(i, j - 1)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can end together: one's bytes are the end of the other's."""
    ids_a, ids_b = {}, {}
    for ids, side in ((ids_a, a), (ids_b, b)):
        for x in side:
            ids[x] = ids.get(x, 0) + 1
    total = 0
    for x, n in ids_a.items():  # tokens of b that end x, x itself among them
        total += n * sum(ids_b.get(x[i:], 0) for i in range(len(x) + 1))
    for y, n in ids_b.items():  # tokens of a that end y and are shorter
        total += n * sum(ids_a.get(y[i:], 0) for i in range(1, len(y) + 1))
    return total


def _lists(flat: np.ndarray, sizes):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat.astype(np.int32)))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and how many each row has."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def aligned_documents(docs: DataFrame, byte_json: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids_a, ids_b, and the tokens of each group (sizes_a, sizes_b). The files are read on
    the driver and sent to the workers."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(byte_json, encoding="utf-8") as f:
        spec_json = f.read()
    with open(piece_model, "rb") as f:
        model = f.read()
    name = f"aligner_{zlib.crc32(spec_json.encode())}_{zlib.crc32(model)}"
    sent = spark.sparkContext.broadcast((spec_json, base64.b64encode(model)))  # two vocabularies: a few MB

    import pyarrow as pa

    def chunks(batch):
        """(first row, texts) of at most CHUNK characters, or of one longer text."""
        first, texts, size = 0, [], 0
        for i, t in enumerate(batch.column(1)):
            text = t.as_py()
            if texts and size + len(text or "") > CHUNK:
                yield first, texts
                first, texts, size = i, [], 0
            texts.append(text)
            size += len(text or "")
        if texts:
            yield first, texts

    def run(batches):
        aligner = worker_state(name, lambda: Aligner(sent.value[0], base64.b64decode(sent.value[1])))
        for batch in batches:
            for first, texts in chunks(batch):
                found = [_lists(*x) for x in aligner.align(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *found], names=["doc_id", "ids_a", "ids_b", "sizes_a", "sizes_b"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, lengths: tuple[np.ndarray, np.ndarray], salts: int = SALTS) -> DataFrame:
    """(a, b, n): links of each id pair. A task adds up what it sees, rows then meet by pair and salt, then by pair."""
    import pyarrow as pa

    sent = aligned.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % salts
        waiting: list[np.ndarray] = []

        def flush():
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(np.full(len(codes), salt, dtype=np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "salt", "n"])

        for batch in batches:
            a, b, _ = linked_ids(*(_flat(batch.column(i))[0] for i in range(4)), sent.value)
            waiting.append(a.astype(np.int64) << 32 | b)
            if sum(map(len, waiting)) > FLUSH:
                waiting.append(np.zeros(0, dtype=np.int64))
                yield flush()
        if waiting:
            yield flush()

    salted = aligned.select("ids_a", "ids_b", "sizes_a", "sizes_b").mapInArrow(run, "a int, b int, salt int, n long").groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def align_tokens(docs: DataFrame, byte_json: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its b),
    count_sum (over links, how often their pair is linked in the corpus), groups (a1,a2|b1;a3|b2,b3)."""
    spark = docs.sparkSession
    with open(byte_json, encoding="utf-8") as f, open(piece_model, "rb") as g:
        lengths = token_lengths(ByteSide(f.read()).bytes, PieceSide(g.read()).bytes)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")  # rows of long arrays
    aligned = cut(aligned_documents(docs, byte_json, piece_model, id_col, text_col), ROW_GROUP)
    counted = cut(pair_counts(aligned, lengths, salts))
    best = counted.groupBy("b").agg(F.max("n").alias("most"))
    # at most pair_bound() rows, whatever the corpus
    pairs = counted.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")).toPandas()
    code = pairs["a"].to_numpy(np.int64) << 32 | pairs["b"].to_numpy(np.int64)
    order = np.argsort(code)
    sent = spark.sparkContext.broadcast((code[order], pairs["n"].to_numpy(np.int64)[order], pairs["best"].to_numpy(np.int64)[order], lengths))
    width = max(map(len, lengths))

    import pyarrow as pa

    def part(batch):
        codes, n, is_best, long = sent.value
        (a, n_a), (b, n_b), (sizes_a, groups), (sizes_b, _) = (_flat(batch.column(i)) for i in range(1, 5))
        link_a, link_b, group = linked_ids(a, b, sizes_a, sizes_b, long)
        at = np.searchsorted(codes, link_a.astype(np.int64) << 32 | link_b)
        last = np.cumsum(groups)
        after = np.searchsorted(group, last, "left")  # links up to each row's end
        per_row = lambda x: np.diff(np.append(0, np.cumsum(x))[after], prepend=0)
        shown = worker_state(f"printer_{width}", lambda: Printer(width))(a, b, sizes_a, sizes_b, groups)
        longs = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, groups, np.diff(after, prepend=0), per_row(is_best[at]), per_row(n[at]))]
        return pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(shown, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    def run(batches):
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:  # rows of about CHUNK tokens at a time
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
                yield part(pa.RecordBatch.from_arrays([batch.column(i).slice(at, to - at) for i in range(5)], names=batch.schema.names))
                at = to

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
