import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from poremetry.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \n\t", "It's we're I'LL don't 'tis ''s", "ΑΣ ΣΑΣ σας ΑΣ.", "İstanbul ǅ ﬁ", "é é Å", "a<|endoftext|>B<|startoftext|> <|end|>",
       "x" * 3000, "aaaa" * 50 + " " + "ab" * 99, "12345 ½ ²３ Ⅷ", "日本語テキスト 😀👩‍👩‍👧 \x00\x1c\x1d\x85​ z", "!!!###$$$ ... —", "퟿�"]


def texts():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéßñ' .,0129!<|>\n ́Σ日"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(400)]
    return ODD + made + pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()


def test_same_ids_and_text_as_the_library():
    reference = Tokenizer.from_file(PATH)
    ours = bpe.WordBpe(PATH)
    given = texts()
    for text, (raw, shown), want in zip(given, ours.encode_batch(given), reference.encode_batch(given, add_special_tokens=False)):
        assert np.frombuffer(raw, "<u4").tolist() == want.ids, text[:80]
        assert shown == reference.decode(want.ids, skip_special_tokens=False)


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "The cat", "x"), (3, "The cat", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = sorted(bpe.digests(docs, PATH).collect())
    assert [r.n_tokens for r in out] == [0, 0, 2, 2] and out[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.decoded for r in bpe.encode(docs, PATH).collect()) == ["", "", "the</w> cat</w>", "the</w> cat</w>"]
    assert bpe.digests(docs.where("doc_id < 0"), PATH).count() == 0
