"""BPE encoding and decoding with an index of pair occurrences."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from poremetry.llm.common import in_pieces, map_texts

# How the vocabulary file's pre-tokenizer splits normalised text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
CACHED_WORDS = 150_000  # per generation; two generations are held


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class WordBpe:
    """Word-end BPE of a tokenizer file: lower case, NFC, white space dropped, special tokens read as such."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.inner = [ids[c] for c in byte_characters()]
        self.final = [ids[c + WORD_END] for c in byte_characters()]
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.pair_of = {rank: (pair, new) for pair, (rank, new) in self.merges.items()}
        self.recent: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def segment(self, words: list[str]) -> list[list[int]]:
        """Token ids of many words at once.

        Every pair of neighbouring symbols is listed under its rank with all its positions; active ranks are applied in ascending
        order, positions from left to right, and each merge updates the lists of the pairs beside it.
        """
        symbols, after, before, starts = [], [], [], []
        for word in words:
            raw = word.encode()
            base = len(symbols)
            starts.append(base if raw else -1)
            symbols += [self.inner[b] for b in raw[:-1]]
            if raw:
                symbols.append(self.final[raw[-1]])
                n = len(raw)
                after += [*range(base + 1, base + n), -1]
                before += [-1, *range(base, base + n - 1)]
        merges, places, active = self.merges, {}, []
        for at, nxt in enumerate(after):
            if nxt >= 0 and (found := merges.get((symbols[at], symbols[nxt]))):
                places.setdefault(found[0], []).append(at)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            todo = places.pop(rank, None)
            if not todo:
                continue
            (left, right), new = self.pair_of[rank]
            todo.sort()
            for k, at in enumerate(todo):
                nxt = after[at]
                if symbols[at] != left or nxt < 0 or symbols[nxt] != right:
                    continue
                symbols[at], symbols[nxt] = new, -1
                after[at] = after[nxt]
                if after[nxt] >= 0:
                    before[after[nxt]] = at
                lower = False
                for p in (before[at], at):
                    if p >= 0 and after[p] >= 0 and (found := merges.get((symbols[p], symbols[after[p]]))):
                        listed = places.get(found[0])
                        if listed is None:
                            places[found[0]] = [p]
                            heapq.heappush(active, found[0])
                        else:
                            listed.append(p)
                        lower |= found[0] < rank
                if lower and k + 1 < len(todo):  # a better pair has come up: it goes first
                    places.setdefault(rank, []).extend(todo[k + 1:])
                    heapq.heappush(active, rank)
                    break
        out = []
        for at in starts:
            ids = []
            while at >= 0:
                ids.append(symbols[at])
                at = after[at]
            out.append(ids)
        return out

    def pieces(self, text: str) -> list[str]:
        """Normalised words of a text, special tokens among them."""
        if self.cut and "<|" in text:
            out = []
            for i, part in enumerate(self.cut.split(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased one by one, without the rule for word ends
        return PIECES.findall(text.lower())

    def look_up(self, words: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Ids (as bytes) and decoded text of every distinct word; unseen ones are segmented together."""
        found, unseen = {}, []
        for word in words:
            entry = self.recent.get(word) or self.older.get(word)
            if entry:
                found[word] = entry
            elif word in self.specials:
                found[word] = self._entry([self.specials[word]])
            else:
                unseen.append(word)
        for word, ids in zip(unseen, self.segment(unseen)):
            found[word] = self._entry(ids)
        self.recent.update(found)
        if len(self.recent) > CACHED_WORDS:
            self.older, self.recent = self.recent, {}
        return found

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), self.decode(ids)

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, word ends and special tokens shown, as the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Per text its ids as little-endian 32-bit integers and its decoded text, a bounded number of characters at a time."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < 2_000_000):
                size += len(texts[stop] or "")
                stop += 1
            split = [self.pieces(t or "") for t in texts[start:stop]]
            table = self.look_up(set().union(*split))
            for words in split:
                entries = [table[w] for w in words]
                yield b"".join([e[0] for e in entries]), " ".join([e[1] for e in entries])
            start = stop


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a file, read once per Python worker."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for every row: token ids and the text decoded from them.

    ``path`` is a vocabulary file that every worker has. Null and empty texts have no ids; rows may repeat; further columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in in_pieces(batches):
            rows = list(bpe.encode_batch(batch.column(1).to_pylist()))
            ids = pa.array([np.frombuffer(r[0], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, made where the ids are, so that no ids leave a task.

    Null and empty texts have no tokens and the digests of nothing; rows may repeat; an empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in in_pieces(batches):
            counts, ids, decoded = [], [], []
            for raw, shown in bpe.encode_batch(batch.column(1).to_pylist()):
                counts.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(shown.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
