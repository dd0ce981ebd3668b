"""Language identification with a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from poremetry.llm.common import in_pieces, map_texts

LETTER = regex.compile(r"\p{L}")
WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 8  # per width
CLASSES = 64
# Bounds of what is fitted on: labelled rows, and windows of each.
TRAIN_ROWS = 4000
TRAIN_WINDOWS = 2
EPOCHS = 8
UNDETERMINED = "und"


def byte_classes() -> np.ndarray:
    """Letters without case, UTF-8 continuation bytes by their low five bits, lead bytes by length, the rest as one class."""
    table = np.zeros(256, np.int32)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    table[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 31)
    table[0xC0:0xE0] = 61
    table[0xC2:0xC6] = 60
    table[0xC3] = 59
    table[0xE0:0xF0] = 62
    table[0xF0:] = 63
    return table


BYTE_CLASS = byte_classes()


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes of all windows of all texts, the text of each window, and the bytes in it. Every byte is in one window."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    raw = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist()))
    grid = BYTE_CLASS[np.frombuffer(raw, np.uint8)].reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    lengths = np.array([len(t) for t in texts], np.int64)
    used = np.minimum(WINDOW, lengths[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
    return grid, owner, used


@dataclass
class ByteNetwork:
    """Filters of several widths over byte classes, maximum over the window, ReLU, softmax."""

    labels: list[str]
    kernels: list[np.ndarray]  # (width, CLASSES, FILTERS)
    biases: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 0) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        size = FILTERS * len(WIDTHS)
        return cls(labels, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(size, np.float32),
                   rng.normal(0, 0.3, (size, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def responses(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of every filter over each window, and where it is."""
        best, where = [], []
        for kernel in self.kernels:
            width = len(kernel)
            n = WINDOW - width + 1
            r = sum(kernel[k][grid[:, k:k + n]] for k in range(width))
            at = r.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0])
        return np.concatenate(best, axis=1), np.concatenate(where, axis=1)

    def tables(self) -> list[np.ndarray]:
        """Filter responses for every pair and triple of classes, so that a window costs one look-up per position and width."""
        two, three, four = self.kernels
        pair = (two[0][:, None] + two[1][None]).reshape(-1, FILTERS)
        triple = (three[0][:, None, None] + three[1][None, :, None] + three[2][None, None]).reshape(-1, FILTERS)
        front = (four[0][:, None] + four[1][None]).reshape(-1, FILTERS)
        back = (four[2][:, None] + four[3][None]).reshape(-1, FILTERS)
        return [pair, triple, front, back]

    def probabilities(self, grid: np.ndarray, tables: list[np.ndarray], block: int = 512) -> np.ndarray:
        out = []
        for start in range(0, len(grid), block):
            g = grid[start:start + block]
            pairs = g[:, :-1] * CLASSES + g[:, 1:]
            best = np.concatenate([
                tables[0][pairs].max(axis=1), tables[1][pairs[:, :-1] * CLASSES + g[:, 2:]].max(axis=1),
                (tables[2][pairs[:, :-2]] + tables[3][pairs[:, 2:]]).max(axis=1)], axis=1)
            out.append(self.softmax(best))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def softmax(self, best: np.ndarray) -> np.ndarray:
        scores = np.maximum(best + self.biases, 0) @ self.weights + self.offsets
        scores -= scores.max(axis=1, keepdims=True)
        e = np.exp(scores)
        return e / e.sum(axis=1, keepdims=True)

    def train(self, grid: np.ndarray, target: np.ndarray, seed: int = 0, rate: float = 0.02, batch: int = 128) -> None:
        """Adam on the cross entropy; languages weigh alike, so a rare one is not drowned."""
        rng = np.random.default_rng(seed)
        weight = (len(target) / np.maximum(1, np.bincount(target, minlength=len(self.labels))) / len(self.labels)).astype(np.float32)
        parts = [*self.kernels, self.biases, self.weights, self.offsets]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(grid))
            for start in range(0, len(order), batch):
                rows = order[start:start + batch]
                x, y = grid[rows], target[rows]
                best, where = self.responses(x)
                hidden = np.maximum(best + self.biases, 0)
                slope = self.softmax(best)
                slope[np.arange(len(y)), y] -= 1
                slope *= weight[y][:, None] / len(y)
                back = (slope @ self.weights.T) * (hidden > 0)
                gradients = []
                for i, kernel in enumerate(self.kernels):
                    g = np.zeros_like(kernel)
                    part, at = back[:, i * FILTERS:(i + 1) * FILTERS], where[:, i * FILTERS:(i + 1) * FILTERS]
                    for k in range(len(kernel)):
                        np.add.at(g[k], (np.take_along_axis(x, at + k, axis=1), np.arange(FILTERS)[None]), part)
                    gradients.append(g)
                gradients += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(parts, gradients, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNetwork:
    """Trains on at most TRAIN_ROWS labelled rows outside the held-out fold, taken in hash order, TRAIN_WINDOWS windows of each.

    Labelled rows are counted first; then tasks send only rows with a hash in the lowest share that holds about four times TRAIN_ROWS of them, so
    that what reaches the driver does not grow with the number of partitions. Where many rows share one hash or have no letter, the sample may be smaller.
    Without any labelled row the network has no languages and every answer is ``und``.
    """
    size = F.length(text)
    start = lambda k: F.greatest(F.lit(1), (size * k / TRAIN_WINDOWS).cast("int"))
    labelled = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id)))
    top = min((1 << 64) - 1, (1 << 64) * 4 * TRAIN_ROWS // max(1, labelled.count())) - (1 << 63)
    rows = labelled.where((F.xxhash64(doc_id, lang) <= F.lit(top)) & F.col(text).rlike(r"\p{L}")).select(
        F.xxhash64(doc_id, lang).alias("h"), F.col(lang).alias("lang"),
        F.array(*[F.substring(F.col(text), start(k), F.lit(WINDOW)) for k in range(TRAIN_WINDOWS)]).alias("parts"))
    sample = rows.orderBy("h", "lang", "parts").limit(TRAIN_ROWS).collect()
    labels = sorted({r.lang for r in sample})
    network = ByteNetwork.fresh(labels)
    pairs = [(p.encode()[:WINDOW], labels.index(r.lang)) for r in sample for p in r.parts if LETTER.search(p)]
    if pairs:
        grid, owner, _ = windows_of([p for p, _ in pairs])
        network.train(grid, np.array([t for _, t in pairs])[owner])
    return network


def classify(network: ByteNetwork, texts: list[str | None], tables: list[np.ndarray]) -> tuple[list[str], list[float]]:
    """Language and score of whole texts: the mean softmax over all windows, weighted by their bytes."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not network.labels:
        return langs, scores
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    start = 0
    while start < len(known):
        stop, size = start, 0
        while stop < len(known) and (stop == start or size < 1 << 20):
            size += len(texts[known[stop]])
            stop += 1
        rows = known[start:stop]
        grid, owner, used = windows_of([texts[i].encode() for i in rows])
        p = network.probabilities(grid, tables) * used[:, None]
        total = np.zeros((len(rows), len(network.labels)))
        np.add.at(total, owner, p)
        total /= total.sum(axis=1, keepdims=True)
        for i, best, score in zip(rows, total.argmax(axis=1), total.max(axis=1)):
            langs[i], scores[i] = network.labels[best], float(min(1.0, score))
        start = stop
    return langs, scores


def predict(docs: DataFrame, network: ByteNetwork, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, without a shuffle.

    ``und`` with score 0 for null texts and texts without a letter. Language, source and id of a row are no inputs. Repeated rows get the
    same answer; an empty table gives an empty result; further columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in in_pieces(batches):
            langs, scores = classify(network, batch.column(2).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, network: ByteNetwork, least: float = 0.4, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is found with a score of at least ``least``."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in in_pieces(batches):
            langs, scores = classify(network, batch.column(place).to_pylist(), tables)
            yield batch.filter(pa.array([lang != UNDETERMINED and s >= least for lang, s in zip(langs, scores)], pa.bool_()))

    return map_texts(docs, run, docs.schema)
