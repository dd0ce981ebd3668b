import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from poremetry.llm import ngram_join as nj

SPACE = "\x20\t\n\x0b\x0c\r"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE[1:]:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows):
    """Components by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            common = len(sets[i] & sets[k])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[k]) - common):
                root[find(i)] = find(k)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return sorted((rows[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(rows)))


def corpus(seed):
    """Near copies at all distances, chains, a shared passage, hot exact copies, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t\n", "one", "one", "One two", "a b c", "A  b\nc", "a b c d", "é É", "É É"]
    base, passage = make(120), make(60)
    for _ in range(60):  # a large group of near copies, some too far away
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    chain = make(100)
    for _ in range(25):  # every step links with the next one only
        chain = chain[2:] + make(2)
        texts.append(" ".join(chain))
    for _ in range(25):
        texts.append(" ".join(make(rng.randrange(5, 60)) + passage + make(rng.randrange(12))))
    texts += [" ".join(base)] * 40 + [" ".join(make(rng.randrange(4, 80))) for _ in range(40)]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    return rows + rows[:5] + [(rows[7][0], "another text under a known id")]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed, monkeypatch):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, token string, n int").repartition(5)
    assert sorted(tuple(r) for r in nj.join(docs).collect()) == brute(rows)


def test_needed_prefixes():
    for n in range(1, 400):
        size, least = nj.sketch_size(n)
        assert 1 <= least <= size <= n
        for m in range(n, n * 100 // 85 + 1):
            overlap = -(-85 * (n + m) // 185)
            assert overlap >= nj.needed(n) and n - overlap <= size - least


def test_merged_counts_and_probes_decide_like_whole_sets():
    """Every pair of random sets: the T-occurrence test against the overlap of the whole sets; most pairs end without a probe."""
    rng = np.random.default_rng(5)
    base = [rng.choice(3000, n, replace=False) for n in (60, 61, 90)]
    sets = [np.union1d(b[rng.random(len(b)) < keep], rng.choice(3000, 4)) for b in base for keep in (0.8, 0.9, 0.97, 1.0) for _ in range(8)]
    df = np.bincount(np.concatenate(sets))
    rows = []
    for tokens in sets:
        order = sorted((int(df[t]), int(t)) for t in tokens if df[t] > 1)
        cut = len(order) - nj.needed(len(tokens)) + 1
        if cut > 0:
            part = np.array([t for _, t in order])
            rows.append((tokens, (len(tokens), order[cut - 1], part[:cut], np.sort(part[cut:]))))
    linked = 0
    for i, (a, side_a) in enumerate(rows):
        for b, side_b in rows[:i]:
            common = len(np.intersect1d(a, b))
            want = 100 * common >= 85 * (len(a) + len(b) - common)
            assert nj.reaches(side_a, side_b) == nj.reaches(side_b, side_a) == want
            linked += want
    assert linked > 100 and len(rows) > 60


def test_keep_one(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(5, long), (3, long), (3, long), (9, long + " end"), (2, None), (1, "other words stand here alone")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, node string")
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_keep_one_with_helper_names(spark):
    rows = [(1, "one two three four five", 1, 2, 3, 4, 5), (2, "one two three four five", 1, 2, 3, 4, 5), (3, "six seven eight nine", 1, 2, 3, 4, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id int, _kept int, _n int, _key int, _single int")
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert nj.join(docs).count() == 0 and nj.keep_one(docs).count() == 0
    same = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert sorted(tuple(r) for r in nj.join(same).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_group_of_near_copies_needs_few_tries(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    texts = [" ".join(base)]
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(90), rng.randrange(1, 4)):
            copy[at] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    tried, probe = [], nj._linked

    def counted(pairs, sets):
        tried.append(pairs.count())
        return probe(pairs, sets)

    monkeypatch.setattr(nj, "_linked", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(tuple(r) for r in nj.join(docs).collect()) == brute(rows)
    assert sum(tried) <= 5 * len(rows)


def test_null_ids_and_ids_with_two_texts(spark):
    make = lambda c: [f"{c}{i}" for i in range(60)]
    near = lambda ws: " ".join([*ws[:-1], "z"])
    a, b, c, d = (make(x) for x in "abcd")
    rows = [(None, " ".join(make("u"))), (None, " ".join(make("u"))), (9, " ".join(a)), (9, " ".join(b)), (3, " ".join(b)), (None, near(b)),
            (None, " ".join(c)), (None, near(c)), (None, None), (None, " \n"), (4, None), (4, None), (8, " ".join(d)), (8, near(d)), (8, "x y z one two three")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, _key int").repartition(3)
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r._key for r in kept.collect())
    assert [k for k in got if k not in (0, 1, 6, 7, 8, 9, 10, 11, 12, 13)] == [2, 4, 14]
    assert [len({*got} & {*g}) for g in [(0, 1), (6, 7), (8, 9), (10, 11), (12, 13)]] == [1, 1, 2, 1, 1]
    named = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in nj.join(docs).collect()), key=str)
    assert len(named) == len(rows) and (True, 0, 57, 3) in named and (True, 0, 57, None) in named


def test_chain_through_a_null_id(spark):
    base = [f"w{i}" for i in range(100)]
    middle = base[5:] + [f"m{i}" for i in range(5)]
    end = middle[5:] + [f"e{i}" for i in range(5)]
    docs = spark.createDataFrame([(7, " ".join(base)), (None, " ".join(middle)), (2, " ".join(end))], "doc_id bigint, text string")
    assert {r.component_id for r in nj.join(docs).collect()} == {2}
    assert [r.doc_id for r in nj.keep_one(docs).collect()] == [2]
