"""Suffix-array removal of repeated passages, against plain dictionaries of all windows."""

import random

import numpy as np
import pytest

from poremetry.llm import suffix_dedup as sd


def plain(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept) by a dictionary of all strings."""
    first = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        if i is not None:
            for at in range(len(raw) - length + 1):
                w = raw[at:at + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if i is not None and first[raw[at:at + length]] < i:
                gone[at:at + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def as_rows(df):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=key)


def expected(rows, length=50):
    return sorted(plain(rows, length), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    vocabulary = [word() for _ in range(60)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            cut = rng.randint(0, 20)
            parts += [passage[cut:], text(rng.randint(0, 15))]
        rows.append((rng.randint(0, 1000), " ".join(parts)))
    rows += [(rows[3][0] + 7, rows[3][1]), (rows[3][0] + 7, rows[3][1]), (rows[5][0], rows[7][1])]
    return rows


@pytest.mark.parametrize("text", [b"", b"a", b"\0\0\0\0\0\0\0\0\0\0\0\0", b"banana" * 9, b"\xff" * 40 + b"\xfe" + b"\xff" * 40, bytes(range(256)) * 3])
def test_suffix_array_and_prefixes(text):
    array = np.frombuffer(text, np.uint8)
    order = sd.suffix_array(array)
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))

    def common(a, b):
        n = 0
        while n < min(len(a), len(b), 50) and a[n] == b[n]:
            n += 1
        return n

    shared = sd.common_prefixes(array, order, 50)
    assert shared.tolist() == [common(text[order[r - 1]:], text[order[r]:]) if r else 0 for r in range(len(text))]


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_windows(spark, monkeypatch, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_rows(sd.remove_repeats(df)) == expected(rows)


def test_small_shards_merge_and_common_anchors(monkeypatch):
    """Shards of a few pieces, batches of a few documents and windows dealt out one by one give the same spans."""
    rows = [(i, t) for i, t in enumerate(t for _, t in corpus(9, 80))]
    monkeypatch.setattr(sd, "SHARD_BYTES", 700)
    monkeypatch.setattr(sd, "LANES", 3)
    docs = [(i, 0, 0, t.encode()) for i, t in rows]
    codec = sd.Codec(docs[0][3])
    text = np.frombuffer(b"".join(d[3] for d in docs), np.uint8)
    starts, _, offset = sd.cut(text, np.cumsum([len(d[3]) for d in docs]), 50, np.zeros(0, np.uint64))
    anchors, n = np.unique(sd.names(text, starts, offset, 50), return_counts=True)
    for common in (np.zeros(0, np.uint64), anchors[np.argsort(-n)[:20]], anchors):
        buckets = {}
        for k in range(0, len(docs), 7):
            for bucket, packed in sd.batch_pieces(docs[k:k + 7], 50, 5, common, codec):
                buckets.setdefault(bucket, []).append(packed)
        spans = {}
        for blobs in buckets.values():
            for doc, _, at, size in zip(*sd.resolve(blobs, 50, codec)):
                spans.setdefault(int(doc), []).append(at * 128 + size)
        for (i, size, removed, count, _), (doc, raw) in zip(plain(rows), rows):
            starts, ends = sd.covered(np.array(spans.get(doc, []), np.int64))
            assert (removed, count) == (int((ends - starts).sum()), len(starts)), doc


def test_long_document_in_parts(spark, monkeypatch):
    """A document that is longer than a batch is cut in overlapping parts."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    docs = [(0, 0, 0, long[9_000:12_000].encode()), (1, 0, 0, long.encode())]
    monkeypatch.setattr(sd, "BATCH_BYTES", 2_000)
    monkeypatch.setattr(sd, "STEP_BYTES", 1_000)
    import pyarrow as pa

    table = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([0, 0]), pa.array([d[3] for d in docs], pa.binary())], names=["doc_id", "tag", "text"])
    blobs = [p for part in sd._batches(iter([table])) for _, p in sd.batch_pieces(part, 50, 1, np.zeros(0, np.uint64), sd.Codec())]
    doc, _, at, size = sd.resolve(blobs, 50, sd.Codec())
    starts, ends = sd.covered((at * 128 + size)[doc == 1])
    assert set(doc) == {1} and list(zip(starts, ends)) == [(9_000, 12_000)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x" * 80), (4, "x" * 80), (5, "x" * 49), (6, "x" * 50), (6, "x" * 81), (None, None), (7, "é" * 40), (8, "aé" + "é" * 40)]
    df = spark.createDataFrame([(i, t, "a", 1, i) for i, t in rows], "doc_id bigint, text string, tag string, spans int, span bigint")
    assert as_rows(sd.remove_repeats(df)) == expected(rows)
    assert sd.remove_repeats(df.limit(0)).count() == 0
    shown = spark.createDataFrame([("a" * 60, 2), ("a" * 60, 1)], "body string, nr int")
    assert {(r.doc_id, r.n_removed) for r in sd.remove_repeats(shown, doc_id="nr", text="body").collect()} == {(1, 0), (2, 60)}


def test_resolving_takes_few_bytes_per_byte_of_pieces():
    import tracemalloc

    pick = random.Random(5)
    words = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 9))) for _ in range(3000)]
    docs = [(i, 0, 0, " ".join(pick.choices(words, k=400)).encode()) for i in range(1200)]
    docs += [(i + 5000, 0, 0, t[:900] + b" x " + t[900:1500] + b" y " + t[1500:]) for i, _, _, t in docs]
    codec = sd.Codec()
    blobs = [packed for lo in range(0, len(docs), 600) for _, packed in sd.batch_pieces(docs[lo:lo + 600], 50, 1, np.zeros(0, np.uint64), codec)]
    pieces = sum(len(codec.unpack(b, **sd.KINDS)[0]) for b in blobs)
    tracemalloc.start()
    doc, _, _, _ = sd.resolve(blobs, 50, codec)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(doc) and peak < 15 * pieces, (peak, pieces)
