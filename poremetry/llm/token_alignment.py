"""Alignment of two tokenizers' tokens over the same text.

Both token sequences tile the text's bytes. ``merge_asof`` finds for each token start the other side's token that covers it; the two
directions together are all overlaps, and places where tokens of both sides end cut the text into groups. How many documents hold a pair of
ids linked is counted over all documents, joined back to every batch's distinct pairs, and meets the batch's documents in a cogrouped step.

A task holds the tokens of a small part of a batch at a time, and a batch's lists are cut into short rows: Parquet's writer and reader hold
many rows at once, whatever their size.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from poremetry.llm.bpe import byte_characters
from poremetry.llm.common import in_pieces, map_texts
from poremetry.workspace import materialize

BATCH_BYTES = 4 << 20  # text whose distinct id pairs are listed together
PART_BYTES = 256 << 10  # text of a batch that is aligned at once
ROW_BYTES = 64  # what a row of a batch counts besides its text
LIST_ENTRIES = 1024  # of a batch's lists in a row
# Fixed value: how byte-level vocabularies cut text before they merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"


class ByteLevel:
    """Byte-level BPE of a tokenizer file; special tokens in a text are plain text. Ids are merge ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = {c: i for i, c in enumerate(byte_characters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Sentence pieces with byte fallback; the model adds the space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """One tokenizer with the bytes of its ids."""

    def __init__(self, tokenizer):
        self.encode = tokenizer.encode
        self.bytes = tokenizer.bytes
        self.sizes = np.array([len(b) for b in tokenizer.bytes], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


@functools.lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Both tokenizers, read once per Python worker."""
    return Side(ByteLevel(a_path)), Side(Pieces(b_path))


@functools.lru_cache(maxsize=1)
def numerals(top: int) -> np.ndarray:
    """Every id as decimal digits followed by ``,``, ``|`` or ``;``, in that order."""
    return np.array([f"{i}{end}".encode() for i in range(top) for end in ",|;"], object)


def tokens(texts: list[str | None], a: Side, b: Side) -> tuple[list[pd.DataFrame], np.ndarray]:
    """Per side a frame (doc, id, at, end) of all tokens of a batch, and the number of text bytes of every document with tokens.

    Places count through the batch: no two documents share one. Texts whose bytes do not come back from both sides have no tokens.
    """
    full = [i for i, t in enumerate(texts) if t]
    chosen = [texts[i] for i in full]
    coded = list(zip(full, chosen, a.encode(chosen), b.encode(chosen)))
    whole = [(" " + t).encode("utf-8", "surrogatepass") for _, t, _, _ in coded]
    coded = [(c, w) for c, w in zip(coded, whole) if a.joined(c[2]) == w and b.joined(c[3]) == w]
    docs = np.array([c[0] for c, _ in coded], np.int64)
    frames = []
    for k, side in ((2, a), (3, b)):
        n = np.array([len(c[k]) for c, _ in coded], np.int64)
        ids = np.fromiter((i for c, _ in coded for i in c[k]), np.int64, int(n.sum()))
        end = np.cumsum(side.sizes[ids])
        frames.append(pd.DataFrame({"doc": np.repeat(docs, n), "id": ids, "at": end - side.sizes[ids], "end": end, "row": np.arange(len(ids))}))
    return frames, docs


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of a, of b) of all overlapping token pairs of a batch, each once, in no special order.

    A token start lies in exactly one token of the other side of its document: the last one that starts there or before.
    """
    in_b = pd.merge_asof(a[["doc", "at", "row"]], b[["doc", "at", "row"]], on="at", by="doc", suffixes=("_a", "_b"))
    in_a = pd.merge_asof(b[["doc", "at", "row"]], a[["doc", "at", "row"]], on="at", by="doc", suffixes=("_b", "_a"))
    # where both start together both directions name the same pair
    later = a["at"].to_numpy()[in_a["row_a"].to_numpy()] < in_a["at"].to_numpy()
    return (np.concatenate([in_b["row_a"].to_numpy(), in_a["row_a"].to_numpy()[later]]),
            np.concatenate([in_b["row_b"].to_numpy(), in_a["row_b"].to_numpy()[later]]))


def group_texts(a: pd.DataFrame, b: pd.DataFrame, docs: np.ndarray, top: int) -> tuple[np.ndarray, list[bytes]]:
    """Per document of ``docs`` the number of groups and their text ``a1,a2|b1;a3|b2``. Documents follow each other in both frames."""
    ends = [f["end"].to_numpy() for f in (a, b)]
    closes = [np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True)]
    group = [np.cumsum(c) - c for c in closes]
    groups = int(closes[0].sum())
    n = [np.bincount(g, minlength=groups) for g in group]
    # within a group all of a's tokens come before all of b's
    place_a = np.arange(len(a)) + (np.cumsum(n[1]) - n[1])[group[0]]
    place_b = np.arange(len(b)) + np.cumsum(n[0])[group[1]]
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a] = a["id"].to_numpy() * 3 + closes[0]
    code[place_b] = b["id"].to_numpy() * 3 + 2 * closes[1]
    shown = numerals(top)[code].tolist()
    rows = [np.searchsorted(f["doc"].to_numpy(), docs, "right") for f in (a, b)]
    last = rows[0] + rows[1]
    first = np.append(0, last[:-1]) if len(last) else last
    per_doc = np.diff(np.append(0, np.append(0, np.cumsum(closes[0]))[rows[0]])) if len(docs) else np.zeros(0, np.int64)
    return per_doc, [b"".join(shown[i:j])[:-1] for i, j in zip(first, last)]


def cut(items: Iterable, size: Callable[..., int], most: int) -> Iterator[list]:
    """The items in order, in lists that end where their sizes reach ``most``."""
    part, total = [], 0
    for item in items:
        part.append(item)
        total += size(item)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


PER_TEXT = ("n_a", "n_b", "n_groups", "n_links")


def align_part(texts: list[str | None], a: Side, b: Side) -> dict:
    """Per text its counts, digest and number of distinct id pairs, and those pairs, text after text, with how often they are linked."""
    (left, right), docs = tokens(texts, a, b)
    row_a, row_b = overlaps(left, right)
    base = len(b.bytes)
    doc = left["doc"].to_numpy()[row_a]
    pair = left["id"].to_numpy()[row_a] * base + right["id"].to_numpy()[row_b]
    n = len(texts)
    groups, shas = np.zeros(n, np.int64), np.full(n, "", object)
    counted, shown = group_texts(left, right, docs, max(len(a.bytes), base))
    groups[docs] = counted
    for d, text in zip(docs, shown):
        shas[d] = hashlib.sha256(text).hexdigest()
    held, times = np.unique(doc << 32 | pair, return_counts=True)
    size = lambda d: np.bincount(d, minlength=n)
    return {"n_a": size(left["doc"]), "n_b": size(right["doc"]), "n_groups": groups, "n_links": size(doc), "groups_sha256": shas, "n_held": size(held >> 32),
            "held": (held & 0xFFFFFFFF).astype(np.int32), "times": times.astype(np.int32)}


def align_batch(ids: list, texts: list[str | None], a: Side, b: Side) -> dict:
    """A batch: per document its counts and, as positions in the batch's list of distinct id pairs, its distinct pairs.

    Copies of one text are aligned once. The tokens of a part of the texts are held at a time.
    """
    place = {}
    which = np.array([place.setdefault(t, len(place)) for t in texts], np.int64)
    parts = [align_part(part, a, b) for part in cut(place, lambda t: len(t or ""), PART_BYTES)]
    whole = {k: np.concatenate([part[k] for part in parts]) for k in parts[0]}
    pairs, slots = np.unique(whole["held"], return_inverse=True)
    n_held = whole["n_held"]
    copies = np.repeat(np.bincount(which, minlength=len(place)), n_held)
    in_docs = np.bincount(slots, weights=copies, minlength=len(pairs)).astype(np.int64)
    ends = np.cumsum(n_held)
    return {
        "doc_id": ids, **{k: whole[k][which] for k in (*PER_TEXT, "groups_sha256")}, "slot_from": (ends - n_held)[which], "slot_to": ends[which],
        "slots": slots.astype(np.int32), "times": whole["times"], "pairs": pairs, "in_docs": in_docs}


PER_DOC = (*PER_TEXT, "groups_sha256", "slot_from", "slot_to")
LISTS = {"slots": pa.int32(), "times": pa.int32(), "pairs": pa.int32(), "in_docs": pa.int64()}


def batch_rows(number: int, made: dict, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A batch's documents, a row each, and its lists, each row with the entries from ``at`` on; the other columns are null."""
    n = len(made["doc_id"])
    pieces = -(-max(len(made[k]) for k in LISTS) // LIST_ENTRIES)
    kinds = {"doc_id": id_kind, **{k: pa.string() if k == "groups_sha256" else pa.int64() for k in PER_DOC}}
    of_batch = lambda rows: pa.array(np.full(rows, number, np.int64))
    names = ["batch", *kinds, "at", *LISTS]
    yield pa.RecordBatch.from_arrays(
        [of_batch(n), *[pa.array(made[k], kind) for k, kind in kinds.items()], pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.list_(kind)) for kind in LISTS.values()]],
        names=names)
    at = np.arange(pieces + 1) * LIST_ENTRIES
    lists = [pa.ListArray.from_arrays(pa.array(np.minimum(at, len(made[k])), pa.int32()), pa.array(made[k], kind)) for k, kind in LISTS.items()]
    yield pa.RecordBatch.from_arrays(
        [of_batch(pieces), *[pa.nulls(pieces, kind) for kind in kinds.values()], pa.array(at[:-1], pa.int32()), *lists], names=names)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of ``batch_rows`` for batches of documents; every batch has a number of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        id_kinds = [pa.int64()]

        def rows():
            for piece in in_pieces(batches):
                id_kinds[0] = piece.column(0).type
                yield from zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())

        first = TaskContext.get().partitionId() << 33
        for k, batch in enumerate(cut(rows(), lambda row: ROW_BYTES + len(row[1] or ""), BATCH_BYTES)):
            ids, texts = map(list, zip(*batch))
            yield from batch_rows(first + k, align_batch(ids, texts, a, b), id_kinds[0])

    columns = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in PER_DOC)
    schema = f"batch bigint, doc_id {kind}, {columns}, at int, slots array<int>, times array<int>, pairs array<int>, in_docs array<bigint>"
    return map_texts(docs, run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Tokenizer a is byte-level BPE (a JSON file) on a space and the text, b sentence pieces that add the space; both paths must hold on every
    worker. A link is a pair of token occurrences that share bytes; a group runs from one common token end to the next. The count of an id
    pair is the number of rows that hold it linked; ``n_best`` counts the links whose count is the highest of their a id.

    Null and empty texts, and texts that a side does not give back byte by byte, have no tokens: zeros and an empty ``groups_sha256``. Equal rows
    count as rows of their own. Null ids are kept. Other columns are ignored. The batches' rows are written once, as tokens are costly to make.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    batches = materialize(aligned(rows, a_path, b_path))
    base = F.lit(len(sides(a_path, b_path)[1].bytes))
    held = batches.where("at is not null").select("batch", "at", F.posexplode(F.arrays_zip("pairs", "in_docs")).alias("k", "p")).select(
        "batch", (F.col("at") + F.col("k")).alias("slot"), F.col("p.pairs").alias("pair"), "p.in_docs")
    counts = held.groupBy("pair").agg(F.sum("in_docs").alias("n"))
    counts = materialize(counts.withColumn("a", F.floor(F.col("pair") / base)))
    # one row per id of a: as many as its vocabulary has
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("top")))
    known = counts.join(best, "a").select("pair", F.when(F.col("n") == F.col("top"), -F.col("n")).otherwise(F.col("n")).alias("n"))
    # the count of every distinct pair of a batch; a negative count is the highest of its a id. The optimizer knows the pairs' written size only
    found = held.join(known.hint("merge"), "pair").select(F.col("batch").alias("of"), "slot", "n")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *PER_TEXT, "n_best", "count_sum", "groups_sha256"]

    def run(batch: pa.Table, listed: pa.Table) -> pa.Table:
        of_doc = pc.is_null(batch["at"])
        per_doc, lists = batch.filter(of_doc), batch.select(["at", "slots", "times"]).filter(pc.invert(of_doc)).sort_by("at")
        slots, times = (lists[c].combine_chunks().flatten().to_numpy() for c in ("slots", "times"))
        count = np.zeros(int(slots.max()) + 1 if len(slots) else 0, np.int64)
        if len(slots):
            count[listed["slot"].to_numpy()] = listed["n"].to_numpy()
        number = count[slots]
        sums = np.append(0, np.cumsum(np.abs(number) * times))
        bests = np.append(0, np.cumsum(np.where(number < 0, times, 0)))
        lo, hi = per_doc["slot_from"].to_numpy(), per_doc["slot_to"].to_numpy()
        made = {"n_best": pa.array(bests[hi] - bests[lo]), "count_sum": pa.array(sums[hi] - sums[lo])}
        return pa.table([made[c] if c in made else per_doc[c] for c in names], names=names)

    longs = ", ".join(f"{c} bigint" for c in (*PER_TEXT, "n_best", "count_sum"))
    return batches.drop("pairs", "in_docs").groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(
        run, f"doc_id {kind}, {longs}, groups_sha256 string")
