"""Token alignment against a byte-by-byte comparison, and the byte-level encoder against the tokenizers library."""

import collections
import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from poremetry.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello world, how are you?", "", None, "a", "naïve café — “quotes” 日本語 🙂🙂", "tabs\tand\n\nnew  lines   ", "<|endoftext|> is <s> text </s> <unk> <0x41>",
         "x" * 300, " leading", "trailing ", "Hello world, how are you?", "▁ is a piece mark", "ﬁne ligature ½", " hard space", "12345 67890", "é",
         "the same words the same words"]


def plain(texts):
    """Rows without ids, in the order of ``texts``."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = ta.sides(A, B)
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    docs = []
    for text in texts:
        a = lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if a_side.joined(a) != whole or b_side.joined(b) != whole:
            a, b = [], []
        over = [[t for t, i in enumerate(ids) for _ in side.bytes[i]] for ids, side in ((a, a_side), (b, b_side))]
        links = sorted(set(zip(*over)))
        ends = []
        for ids, side in ((a, a_side), (b, b_side)):
            at, found = 0, {}
            for t, i in enumerate(ids):
                at += len(side.bytes[i])
                found[at] = t + 1
            ends.append(found)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, p, q = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[p:ends[0][e]])) + "|" + ",".join(map(str, b[q:ends[1][e]])))
            p, q = ends[0][e], ends[1][e]
        docs.append((a, b, [(a[i], b[j]) for i, j in links], groups))
    held = collections.Counter(pair for d in docs for pair in set(d[2]))
    best = collections.defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(len(a), len(b), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, links, g in docs]


def rows_of(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("size", [1, 60, 1 << 22])
def test_equals_byte_comparison(spark, monkeypatch, size):
    """Any batch size: counts of id pairs are those of the whole table."""
    monkeypatch.setattr(ta, "BATCH_BYTES", size)
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, pair int, slots string").repartition(3)
    assert rows_of(ta.align(df, A, B)) == [(i, *r) for i, r in enumerate(plain([t for _, t, *_ in rows]))]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ta.align(empty, A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in ta.align(nothing, A, B).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")}
    shown = spark.createDataFrame([("two words", "k")], "body string, nr string")
    assert [r.doc_id for r in ta.align(shown, A, B, doc_id="nr", text="body").collect()] == ["k"]


def test_very_long_text(spark):
    text = "some words and more of them, " * 20_000
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    assert rows_of(ta.align(df, A, B)) == [(1, *r) for r in plain([text, text])]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_encoder_equals_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    global LIBRARY
    if "LIBRARY" not in globals():
        LIBRARY = Tokenizer.from_file(A)
        LIBRARY.encode_special_tokens = True
    assert ta.sides(A, B)[0].encode([text])[0] == LIBRARY.encode(" " + text, add_special_tokens=False).ids


def test_a_part_of_a_batch_is_aligned_at_once(monkeypatch):
    """The tokens of a whole batch are never held together, and the parts give what one part gives."""
    a, b = ta.sides(A, B)
    texts = [None if i % 7 == 3 else "some words, " * (i % 40) + str(i % 50) for i in range(4000)]
    sent = []

    class Watched:
        bytes, sizes, joined = a.bytes, a.sizes, staticmethod(a.joined)

        @staticmethod
        def encode(part):
            sent.append(sum(map(len, part)))
            return a.encode(part)

    whole = ta.align_batch(list(range(4000)), texts, a, b)
    monkeypatch.setattr(ta, "PART_BYTES", 2000)
    parts = ta.align_batch(list(range(4000)), texts, Watched, b)
    assert sum(sent) > 10_000 and max(sent) < 3000
    assert {k: list(v) for k, v in parts.items()} == {k: list(v) for k, v in whole.items()}


def test_written_rows_are_short(spark):
    """Rows of a batch stay short, however many id pairs a text or a batch has."""
    rows = [(i, " ".join(str((i * 7919 + k * k) % 99991) for k in range(3000))) for i in range(4)]
    batches = ta.aligned(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), A, B).collect()
    assert len({r.batch for r in batches}) == 1
    assert sum(len(r.slots or []) for r in batches) > 2 * len(batches)
    assert max(len(r[c] or []) for r in batches for c in ("slots", "times", "pairs", "in_docs")) <= 1024


def test_rows_without_text_do_not_gather(spark, monkeypatch):
    monkeypatch.setattr(ta, "BATCH_BYTES", 6400)
    nothing = spark.range(1000).selectExpr("id doc_id", "if(id % 2 = 0, '', null) text").coalesce(1)
    assert ta.aligned(nothing, A, B).select("batch").distinct().count() >= 10
    assert ta.align(nothing, A, B).where("n_a = 0 and groups_sha256 = ''").count() == 1000
