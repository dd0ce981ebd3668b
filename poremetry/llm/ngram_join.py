"""N-gram Jaccard join by T-occurrence search over inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from poremetry.llm.common import fresh, hash_filter, in_pieces, map_texts
from poremetry.operators.contract import smallest_reachable
from poremetry.workspace import materialize, row_count

SHINGLE = 4  # words
SIMILARITY = 85  # per cent of the union that two linked sets share
EXTRA = 10  # per cent of a set by which the sketching prefix is longer than needed
ROUND_GAIN = 20  # a round of single tries is followed by another when one in so many pairs links
CHUNK = 1 << 19  # shingles that a task holds at once

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 4-grams of a text; a shorter text is one shingle, a text without words none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([hashes[x] for x in words], np.uint64)
    if len(w) < SHINGLE:
        return _finish(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(w))], np.uint64))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = _finish(h * _MIX[0] + w[k:k + n] * _MIX[k])
    return np.unique(h)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    raw = xxhash.xxh3_128_digest(tokens.tobytes())
    return tuple(np.frombuffer(raw, "<i8").tolist())


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """Least overlap of a set of n shingles with any set that it links with."""
    return -(-n * SIMILARITY // 100)


def sketch_size(n: int) -> tuple[int, int]:
    """Length of a sketching prefix, in hash order, and how many of its tokens any partner holds at least.

    A partner misses at most n - needed(n) tokens, so it holds all but that many of any subset.
    """
    more = max(1, n * EXTRA // 100)
    size = min(n, n - needed(n) + more)
    return size, size - (n - needed(n))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: documents (id, key, n, s1, s2), prefix tokens (token, s1), and counts of tokens known to be shared (s1, shared).

    Documents of a task are combined: a token of several of its sets leaves it once, without a set (s1 null).
    """
    hashes = _WordHashes()

    def flush(ids, keys, facts, tokens):
        known, at = {}, []
        for k, (n, s1, s2) in enumerate(facts):
            if n and (s1, s2) not in known:
                known[s1, s2] = k
                at.append(k)
        token = np.concatenate([tokens[k] for k in at]) if at else np.zeros(0, np.uint64)
        owner = np.repeat(np.array([facts[k][1] for k in at], np.int64), [len(tokens[k]) for k in at]) if at else np.zeros(0, np.int64)
        distinct, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
        repeated = count[inverse] > 1
        sets, shared = np.unique(owner[repeated], return_counts=True)
        alone = token[~repeated].view(np.int64)
        marks = distinct[count > 1].view(np.int64)
        size = [len(facts), len(alone), len(marks), len(sets)]
        n_rows = sum(size)

        def column(kind, *parts):
            pieces = []
            for length, part in zip(size, parts):
                pieces.append(pa.nulls(length, kind) if part is None else pa.array(part, kind))
            return pa.concat_arrays(pieces)

        batch = pa.RecordBatch.from_arrays([
            column(pa.int64(), ids, None, None, None),
            column(pa.int64(), keys, None, None, None),
            column(pa.int64(), [f[0] for f in facts], None, None, None),
            column(pa.int64(), [f[1] for f in facts], owner[~repeated], None, sets),
            column(pa.int64(), [f[2] for f in facts], None, None, None),
            column(pa.int64(), None, alone, marks, None),
            column(pa.int64(), None, None, None, shared.astype(np.int64))],
            names=["doc_id", "key", "n", "s1", "s2", "token", "shared"])
        for start in range(0, n_rows, 1 << 16):
            yield batch.slice(start, 1 << 16)

    ids, keys, facts, tokens, held = [], [], [], [], 0
    for batch in in_pieces(batches):
        ids += batch.column(0).to_pylist()
        keys += batch.column(1).to_pylist()
        for text in batch.column(2).to_pylist():
            found = shingle_set(text, hashes)
            facts.append((len(found), *signature(found)))
            part = found[:sketch_size(len(found))[0]]
            tokens.append(part)
            held += len(part)
        if held > CHUNK:
            yield from flush(ids, keys, facts, tokens)
            ids, keys, facts, tokens, held = [], [], [], [], 0
    if facts:
        yield from flush(ids, keys, facts, tokens)


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the tokens dealt to this task, how many of each set are held by another set too; other rows pass through."""
    token, owner, id_type = [], [], pa.int64()
    for batch in batches:
        is_token = batch.column("token").is_valid()
        rest = batch.filter(pc.invert(is_token)).drop_columns(["token"])
        id_type = rest.schema.field("doc_id").type
        if rest.num_rows:
            yield rest
        part = batch.filter(is_token)
        token.append(part.column("token").to_numpy(zero_copy_only=False))
        known = part.column("s1")
        owner.append(np.stack([known.fill_null(0).to_numpy(zero_copy_only=False), known.is_null().to_numpy(zero_copy_only=False).astype(np.int64)]))
    if not token:
        return
    token, (owner, mark) = np.concatenate(token), np.concatenate(owner, axis=1)
    order = np.lexsort((mark, owner, token))
    token, owner, mark = token[order], owner[order], mark[order]
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])
    token, owner, mark = token[first], owner[first], mark[first]
    _, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
    spread = np.bincount(inverse, mark)[inverse] + count[inverse] if len(token) else count
    sets, shared = np.unique(owner[(mark == 0) & (spread > 1)], return_counts=True)
    none = pa.nulls(len(sets), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(len(sets), id_type), none, none, pa.array(sets, pa.int64()), none, pa.array(shared, pa.int64())],
        names=["doc_id", "key", "n", "s1", "s2", "shared"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in in_pieces(batches):
        found = [shingle_set(t, hashes) for t in batch.column("text").to_pylist()]
        named = [signature(f) for f in found]
        yield pa.RecordBatch.from_arrays([
            batch.column("key"), pa.array([s[0] for s in named], pa.int64()), pa.array([s[1] for s in named], pa.int64()),
            pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["key", "s1", "s2", "tokens"])


def _held(asked: np.ndarray, held: np.ndarray) -> int:
    """How many of ``asked`` a binary search finds in the sorted ``held``."""
    if not len(held):
        return 0
    return int((held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked).sum())


def reaches(a: tuple, b: tuple) -> bool:
    """Whether two sets (n, end, short tokens, sorted long tokens) share enough to link.

    The set whose short tokens end first in the order of frequency asks: all it shares by short tokens are short tokens of the other. Only if
    those reach the required overlap less the number of its long tokens, the long ones are probed.
    """
    (n, end, short, long), (o_n, o_end, o_short, o_long) = (a, b) if a[1] <= b[1] else (b, a)
    required = -(-SIMILARITY * (n + o_n) // (100 + SIMILARITY))
    o_short = np.sort(o_short)
    hits = _held(short, o_short)
    return hits >= required - len(long) and hits + _held(long, o_short) + _held(long, o_long) >= required


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs that reach the required overlap."""
    for batch in batches:
        sides = []
        for side in ("a", "b"):
            parts = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(f"short_{side}"), batch.column(f"long_{side}"))]
            n, *end = (batch.column(f"{c}_{side}").to_pylist() for c in ("n", "end_df", "end_token"))
            sides.append([(n[i], (end[0][i], end[1][i]), *(values[at[i]:at[i + 1]] for values, at in parts)) for i in range(batch.num_rows)])
        keep = [reaches(a, b) for a, b in zip(*sides)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Written (a, b): the candidate pairs that link."""
    facts = [c for c in index.columns if c != "node"]
    of = lambda side: index.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in facts])
    return materialize(map_texts(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b"), _probe, "a bigint, b bigint"))


def _sizes_fit(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _indexed(sets: DataFrame) -> DataFrame:
    """Written (node, n, short, long, end_df, end_token): every set that can have a partner, with its tokens divided by the length of their lists.

    Of the T tokens that any partner shares at least, the T - 1 most frequent ones are long. Fewer long lists would merge those of passages that
    many sets share, and pairs would grow with the square of such a group.
    The lists of the others are merged; those of single sets have nothing to merge. Long lists are kept by set, not by token: whether a
    list names a set is a binary search in that set's row, and no frequent token becomes a hot group. ``end_df`` and ``end_token`` name the
    last short token in the order of frequency.
    """
    each = sets.select("node", F.explode("tokens").alias("token"))
    frequency = materialize(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    ranked = each.join(frequency, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    least = F.ceil(F.col("n") * SIMILARITY / F.lit(100)).cast("int")
    sized = ranked.join(sets.select("node", F.col("n").cast("int").alias("n")), "node").where(F.size("common") >= least)
    long = F.ceil(F.col("n") * SIMILARITY / F.lit(100)).cast("int") - 1
    cut = sized.withColumn("cut", F.size("common") - long)
    return materialize(cut.select(
        "node", "n", F.slice("common", F.lit(1), F.col("cut"))["token"].alias("short"),
        F.array_sort(F.slice("common", F.col("cut") + 1, long)["token"]).alias("long"),
        F.element_at("common", F.col("cut"))["df"].alias("end_df"), F.element_at("common", F.col("cut"))["token"].alias("end_token")))


def _postings(index: DataFrame) -> DataFrame:
    """Written short inverted lists (token, node, n, rest); ``rest`` counts the set's tokens from this one on, in the order of frequency."""
    common = F.size("short") + F.size("long")
    lists = index.select("node", "n", F.posexplode("short").alias("at", "token"), common.alias("common"))
    return materialize(lists.select("token", "node", "n", (F.col("common") - F.col("at")).alias("rest")))


def _try_pivots(asking: DataFrame, pivots: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Written pairs (a, b): every asking row's node with the pivot that most of its lists name, unless the pair was tried before.

    ``pivots`` has one row (token, p: struct of node and n, side) per list and side.
    """
    named = asking.join(pivots, "token").where((F.col("node") != F.col("p.node")) & _sizes_fit(F.col("n"), F.col("p.n")))
    merged = named.groupBy("node", "side", F.col("p.node").alias("pivot")).agg(F.count(F.lit(1)).alias("hits"))
    nearest = merged.groupBy("node", "side").agg(F.max(F.struct("hits", -F.col("pivot"), F.col("pivot")))["pivot"].alias("pivot"))
    pairs = nearest.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    return materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))


def _placed(lists: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists with the component of every set, written, and (token, main) of the lists that hold several: the largest one."""
    placed = materialize(lists.join(groups, "node", "left").select(*lists.columns, F.coalesce("root", "node").alias("part")))
    parts = placed.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"))
    return placed, materialize(parts.groupBy("token").agg(
        F.max(F.struct("k", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "main"))


def _links(sets: DataFrame) -> DataFrame:
    """(node, root) of every set that links with another.

    First every set is tried with two others: of all that stand in its lists, the one with the fewest rarer tokens (the middle of a group of near
    copies has hardly any) and the last. While enough of such pairs link, sets outside the largest component of a list are tried with a member
    of that component, drawn anew in each round with weights that favour the middle. A round tries one pair a set. Then only
    pairs from different components are left: within a list the sets outside its largest component are tried with the others where enough tokens follow
    the shared one. A tried pair's short tokens are merged to a count, and only where that reaches the required overlap less the number of long
    lists, the long ones are probed (see ``reaches``).
    Nothing is capped, so no link between components is lost.
    """
    index = _indexed(sets)
    lists = _postings(index)
    rarer = F.col("n") - F.col("rest")
    ends = materialize(lists.groupBy("token").agg(
        F.min(F.struct(rarer.alias("rarer"), "node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi"), F.min("node").alias("first")).where(
        "first < hi.node").select("token", F.struct("lo.node", "lo.n").alias("lo"), "hi"))
    tried = _try_pivots(lists, ends.select("token", F.posexplode(F.array("lo", "hi")).alias("side", "p")), None)
    found = _linked(tried, index)
    groups = smallest_reachable(found)
    placed, mixed = _placed(lists, groups)
    latest, gained, rounds = tried, row_count(found), 0
    while gained and ROUND_GAIN * gained >= row_count(latest):
        rounds += 1
        rows = placed.join(mixed, "token")
        uniform = (F.pmod(F.xxhash64(F.lit(rounds), "node"), F.lit(1 << 30)) + 1) / F.lit(1 << 30)
        weighted = F.struct((-F.log(uniform) * (rarer + 1)).alias("key"), "node", "n")
        drawn = rows.where("part = main").groupBy("token").agg(F.min(weighted).alias("p"))
        pivots = materialize(drawn.select("token", F.struct("p.node", "p.n").alias("p"), F.lit(0).alias("side")))
        latest = _try_pivots(rows.where("part <> main"), pivots, tried)
        more = _linked(latest, index)
        gained = row_count(more)
        if gained:
            tried = materialize(tried.unionByName(latest))
            found = materialize(found.unionByName(more))
            groups = smallest_reachable(found)
            placed, mixed = _placed(lists, groups)
    rows = placed.join(mixed, "token")
    minor = materialize(rows.where("part <> main"))
    other = placed.select("token", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "rest", "part")])
    least = lambda a, b: F.ceil((a + b) * SIMILARITY / F.lit(100 + SIMILARITY))
    crossing = minor.join(other, "token").where(
        (F.col("part") != F.col("o_part")) & ((F.col("o_part") == F.col("main")) | (F.col("node") < F.col("o_node")))
        & _sizes_fit(F.col("n"), F.col("o_n")) & (F.least("rest", "o_rest") >= least(F.col("n"), F.col("o_n"))))
    pairs = materialize(crossing.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct())
    if not row_count(pairs):
        return groups
    more = _linked(pairs, index)
    return smallest_reachable(found.unionByName(more)) if row_count(more) else groups


def _row_key(doc_id: Column, text: Column) -> Column:
    """Names a document by its id, which may be null, and its text."""
    return F.xxhash64(doc_id.isNull(), doc_id, text)


def _first(doc_id: str, key: str) -> Column:
    """(id, key) of the row with the smallest id; a null id comes last."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("open"), F.col(doc_id).alias("id"), F.col(key).alias("key")))


def _components(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, n, component, kept): every row with the smallest id of its component and the key of the row that stands for it.

    Rows are named by ``_row_key``, so a null id or one id with several texts is no obstacle. Rows without a shingle stand for themselves.
    """
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", _row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    dealt = map_texts(given, _sketches, "doc_id bigint, key bigint, n bigint, s1 bigint, s2 bigint, token bigint, shared bigint")
    mixed = dealt.repartition(F.coalesce("token", "doc_id", "key", "s1"), F.col("token").isNull() & F.col("s2").isNull())
    facts = materialize(map_texts(mixed, _count_shared, "doc_id bigint, key bigint, n bigint, s1 bigint, s2 bigint, shared bigint"))
    features = facts.where("n IS NOT NULL").select("doc_id", "key", "n", "s1", "s2")
    shared = facts.where("shared IS NOT NULL").groupBy("s1").agg(F.sum("shared").alias("shared"))
    reps = materialize(features.where("n > 0").groupBy("s1", "s2", "n").agg(_first("doc_id", "key").alias("f")).select(
        "s1", "s2", "n", F.col("f.id").alias("rep"), F.col("f.key").alias("key")))
    missing = F.col("n") - F.ceil(F.col("n") * SIMILARITY / F.lit(100))
    size = F.least("n", missing + F.greatest(F.lit(1), F.floor(F.col("n") * EXTRA / F.lit(100))))
    open_reps = materialize(reps.join(shared, "s1").where(F.col("shared") >= size - missing).select("s1", "s2", "n", "rep", "key"))

    keys = open_reps.select("key").distinct()
    texts = given.where(hash_filter(keys, "key")(F.col("key"))).join(keys, "key", "left_semi")  # most texts stay where they are
    built = map_texts(texts.select("key", "text"), _sets, "key bigint, s1 bigint, s2 bigint, tokens array<bigint>")
    sets = materialize(built.join(open_reps, ["key", "s1", "s2"]).dropDuplicates(["s1", "s2"]).select(
        F.monotonically_increasing_id().alias("node"), "n", "s1", "s2", "rep", "key", "tokens"))
    groups = _links(sets)
    members = sets.select("node", "s1", "s2", "rep", "key").join(groups, "node")
    names = materialize(members.groupBy("root").agg(_first("rep", "key").alias("first")))
    renamed = members.join(names, "root").select("s1", "s2", "first")
    own = materialize(reps.join(renamed, ["s1", "s2"], "left").select(
        "s1", "s2", F.when(F.col("first").isNull(), F.col("rep")).otherwise(F.col("first.id")).alias("component"),
        F.coalesce("first.key", "key").alias("kept")))
    some = F.col("n") > 0
    return features.join(own, ["s1", "s2"], "left").select(
        "doc_id", "key", "n", F.when(some, F.col("component")).otherwise(F.col("doc_id")).alias("component"),
        F.when(some, F.col("kept")).otherwise(F.col("key")).alias("kept"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): for every row its set size and the smallest id reachable over links.

    Two documents link when their sets of word 4-grams share 85 % of their union. Equal sets are joined first, under a
    128-bit name. Sets with too few shared tokens in a prefix of their hash order cannot have a partner and leave the search; the rest
    are merged and probed (see ``_links``). Null and empty texts have an empty set and link with nothing; rows with one id
    may repeat, also with different texts; rows with a null id take part in links, and a component without any id has a null
    ``component_id``; an empty table gives an empty result; further columns are ignored.
    """
    return _components(docs, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of every component: that with the smallest id; one with a null id only where no other has one.

    The decision is made per id and text, so an id with several unlinked texts keeps each of them. Rows without words link with
    nothing and stay, repeated ones of one id once, those with a null id all.
    """
    key, single, own, named, n = fresh(docs, "_key", "_single", "_id", "_kept", "_n")
    chosen = materialize(_components(docs, doc_id, text).where("key = kept").groupBy(F.col("doc_id").alias(own), F.col("key").alias(named)).agg(
        F.count(F.lit(1)).alias(n)), twice=F.max(F.col(n) > 1))
    keyed = docs.withColumn(key, _row_key(F.col(doc_id).cast("bigint"), F.col(text)))
    kept = keyed.join(chosen.select(own, named), (F.col(key) == F.col(named)) & F.col(doc_id).cast("bigint").eqNullSafe(F.col(own)), "left_semi")
    if chosen.metrics["twice"]:
        blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        kept = kept.withColumn(single, F.when(F.col(doc_id).isNull() & blank, F.monotonically_increasing_id())).dropDuplicates([doc_id, key, single])
    return kept.select(*docs.columns)
