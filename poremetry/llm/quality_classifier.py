"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poremetry.llm.common import in_pieces, map_texts
from poremetry.llm.language_id import held_out

PASSAGE = 512  # bytes
HIDDEN, GATES = 24, 12
THRESHOLD = 0.7
# Bounds of what is fitted on: labelled rows, and passages of each, spread evenly.
TRAIN_ROWS = 6000
TRAIN_PASSAGES = 48
EPOCHS = 40


def byte_kinds() -> np.ndarray:
    """Kinds of bytes that a passage is described by: kinds of letters, digits, spaces, and single punctuation marks."""
    kinds = np.full(256, 0)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "#", "*", "%", "$",
              "&", "|", "<>", "@", "-_=+", "'\"", ":;", "/\\", "()[]{}", "~^`"]
    for i, group in enumerate(groups, start=1):
        kinds[[ord(c) for c in group]] = i
    kinds[128:] = len(groups) + 1
    return kinds


BYTE_KIND = byte_kinds()
KINDS = int(BYTE_KIND.max()) + 1
FEATURES = KINDS + 5


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text (an empty text is one empty passage), and the text of each passage."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(t.ljust(n * PASSAGE, b"\0") for t, n in zip(texts, counts.tolist())), np.uint8).reshape(-1, PASSAGE)
    owner = np.repeat(np.arange(len(texts)), counts)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(counts) - counts
    used = np.clip(lengths[owner] - (np.arange(len(owner)) - first[owner]) * PASSAGE, 0, PASSAGE)
    kinds = BYTE_KIND[raw]
    flat = (kinds + (np.arange(len(raw)) * KINDS)[:, None]).ravel()
    shares = np.bincount(flat, minlength=len(raw) * KINDS).reshape(-1, KINDS).astype(np.float32)
    shares[:, 0] -= PASSAGE - used  # the padding
    shares /= np.maximum(1, used)[:, None]
    out = np.zeros((len(raw), FEATURES), np.float32)
    out[:, :KINDS] = np.sqrt(np.maximum(0, shares))
    wide = raw.astype(np.uint32)
    grams = wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24
    grams.sort(axis=1)
    fresh = 1 + (grams[:, 1:] != grams[:, :-1]).sum(axis=1)
    out[:, KINDS] = np.minimum(1, fresh / np.maximum(1, used - 3 + (used < PASSAGE)))  # share of distinct 4-byte pieces
    out[:, KINDS + 1] = np.log1p(used) / 6
    out[:, KINDS + 2] = np.log1p(lengths[owner]) / 10
    words = shares[:, 4] + shares[:, 5]
    out[:, KINDS + 3] = np.minimum(2, 0.1 / np.maximum(0.01, words))
    lead = (kinds[:, 1:] == 2) & (kinds[:, :-1] != 2)
    out[:, KINDS + 4] = lead.sum(axis=1) / np.maximum(1, used) * 10
    return out, owner


@dataclass
class GatedAttention:
    """h = tanh(xW + b); attention softmax(u . (tanh(hV) * sigmoid(hG))) over a document's passages; logistic score of the weighted sum."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]  # W, b, V, G, u, c, d

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, seed: int = 0) -> GatedAttention:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return cls(mean, scale, [draw(FEATURES, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATES), draw(HIDDEN, GATES), draw(GATES), draw(HIDDEN), np.zeros(1)])

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w, b, v, g, u, c, d = self.parts
        h = np.tanh(x @ w + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ g)))
        e = (t * s) @ u
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, e)
        a = np.exp(e - top[owner])
        a /= np.bincount(owner, a, n)[owner]
        z = np.zeros((n, HIDDEN))
        np.add.at(z, owner, a[:, None] * h)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ c + d[0])))}

    def scores(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return self.forward((features - self.mean) / self.scale, owner, n)["p"]

    def train(self, features: np.ndarray, owner: np.ndarray, target: np.ndarray, seed: int = 0, batch: int = 256, rate: float = 0.01) -> None:
        rng = np.random.default_rng(seed)
        x_all = (features - self.mean) / self.scale
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(target) + 1))
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        step = 0
        for _ in range(EPOCHS):
            bags = rng.permutation(len(target))
            for k in range(0, len(bags), batch):
                chosen = bags[k:k + batch]
                rows = np.concatenate([order[starts[i]:starts[i + 1]] for i in chosen])
                own = np.repeat(np.arange(len(chosen)), starts[chosen + 1] - starts[chosen])
                x, y = x_all[rows], target[chosen]
                w, b, v, g, u, c, d = self.parts
                f = self.forward(x, own, len(chosen))
                h, t, s, a = f["h"], f["t"], f["s"], f["a"]
                slope = (f["p"] - y) / len(y)
                dz = slope[:, None] * c
                da = (dz[own] * h).sum(axis=1)
                de = a * (da - np.bincount(own, a * da, len(chosen))[own])
                dt, ds = de[:, None] * u * s * (1 - t * t), de[:, None] * u * t * s * (1 - s)
                dh = (a[:, None] * dz[own] + dt @ v.T + ds @ g.T) * (1 - h * h)
                gradients = [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, f["z"].T @ slope, slope.sum(keepdims=True)]
                step += 1
                for p, grad, m, r in zip(self.parts, gradients, first, second):
                    grad = grad + 1e-4 * p
                    m += 0.1 * (grad - m)
                    r += 0.01 * (grad * grad - r)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(r / (1 - 0.99 ** step)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> GatedAttention:
    """Trains on at most TRAIN_ROWS labelled documents outside the held-out fold, taken in hash order.

    Labelled ids are sampled first (a bounded table, so it may be broadcast); their passages are encoded where the texts are. Several labels of
    one id count as the smallest; of several rows of one id the one whose passages hash smallest is taken, before anything reaches the driver. Without labelled documents every score is 0.5.
    """
    ids = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("labelled")).agg(
        F.min(label).alias("target")).orderBy(F.xxhash64("labelled"), "labelled").limit(TRAIN_ROWS)
    rows = docs.select(F.col(doc_id).alias("labelled"), F.col(text).alias("text")).join(F.broadcast(ids), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = []
            for content in batch.column("text").to_pylist():
                x, _ = passages([(content or "").encode()])
                keep = np.unique(np.linspace(0, len(x) - 1, min(len(x), TRAIN_PASSAGES)).astype(int))
                found.append(x[keep].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("labelled").cast(pa.string()), batch.column("target").cast(pa.int32()), pa.array(found, pa.binary())],
                                             names=["labelled", "target", "x"])

    encoded = map_texts(rows, run, "labelled string, target int, x binary")
    one_each = encoded.groupBy("labelled", "target").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x"))["x"].alias("x"))
    sample = sorted(one_each.collect(), key=lambda r: (r.labelled, r.x))
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(np.float64) for r in sample]
    if not bags:
        blank = GatedAttention.fresh(np.zeros(FEATURES), np.ones(FEATURES))
        blank.parts[5][:] = 0
        return blank
    x = np.concatenate(bags)
    model = GatedAttention.fresh(x.mean(axis=0), x.std(axis=0) + 0.02)
    model.train(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([float(r.target) for r in sample]))
    return model


def score_texts(model: GatedAttention, texts: list[str | None]) -> np.ndarray:
    """Scores of whole texts, a bounded number of characters at a time."""
    out = np.zeros(len(texts))
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < 1 << 20):
            size += len(texts[stop] or "")
            stop += 1
        x, owner = passages([(t or "").encode() for t in texts[start:stop]])
        out[start:stop] = model.scores(x, owner, stop - start)
        start = stop
    return out


def score(docs: DataFrame, model: GatedAttention, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, without a shuffle; predicted is 1 from THRESHOLD on.

    Only the text is an input. Null and empty texts are one empty passage and get a score too; repeated rows get the same
    score; an empty table gives an empty result; further columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            p = score_texts(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: GatedAttention, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted to be good."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            yield batch.filter(pa.array(score_texts(model, batch.column(place).to_pylist()) >= THRESHOLD, pa.bool_()))

    return map_texts(docs, run, docs.schema)
