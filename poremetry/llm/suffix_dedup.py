"""Removal of passages that stand in an earlier document, by suffix arrays over content-defined shards.

Two equal strings of ``length`` bytes choose the same anchor inside them (the ``GRAM`` bytes of smallest hash), so text is cut into
pieces of neighbouring windows with one anchor, and the anchor's hash names the bucket where all windows with that content meet. A
bucket sorts its distinct pieces shard by shard (Larsson-Sadakane refinement) and reads off equal windows from Kasai's common prefixes.
Shards hold whole families (pieces with one anchor); the sorted window lists of a family that is larger are merged by binary search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from poremetry.llm.common import map_texts
from poremetry.workspace import materialize

GRAM = 12  # bytes of an anchor
BATCH_BYTES = 8 << 20  # text whose pieces a task packs together
STEP_BYTES = 1 << 20  # text that is cut into pieces at once; longer documents are cut in several steps
BUCKET_BYTES = 12 << 20  # pieces of an average bucket; there are as many buckets as the input needs
SHARD_BYTES = 1 << 20  # pieces whose suffixes are sorted together
FILL_PIECES = 8192  # pieces that are laid out at once for comparison
LANES = 4096  # places where Kasai's scan goes on at once
SAMPLE_SHARE = 32  # one row in so many decides which anchors count as common (this moves work, not results)
COMMON_ANCHORS = 2000  # at most so many common anchors; an anchor is common from this part of all pieces on
SAMPLE_TEXT = 1 << 18  # bytes of sampled text that serve as compression dictionary
ALONE = 255  # in place of an anchor's offset: the piece is one window with a common anchor
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as big-endian numbers; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), ">u8", padded.data, 0, (1,)).astype(np.uint64)


def mixed(words: np.ndarray) -> np.ndarray:
    h = words * SPREAD
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return values if reach == width else np.minimum(values[:reach - width], values[width - reach:])


def spread_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def cut(text: np.ndarray, ends: np.ndarray, length: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, offset of the anchor) of the pieces of some texts that stand one after the other, each up to its end.

    A piece is a run of windows with the same anchor. Windows with a common anchor stand alone.
    """
    n = len(text) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    words = words_at(text)
    h = mixed(mixed(words) ^ np.append(words[GRAM - 8:], np.zeros(GRAM - 8, np.uint64)))
    low = np.uint64((1 << 24) - 1)
    found = sliding_minimum((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)[:n]
    anchor = (found & low).astype(np.int64)
    inside = np.ones(n, bool)
    for end in ends:
        inside[max(0, end - length + 1):end] = False
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    if len(common) and first.any():
        starts = np.flatnonzero(first)
        known = np.isin(hash_at(text, anchor[starts], GRAM), common)
        alone = known[np.maximum(np.cumsum(first) - 1, 0)] & inside
        first |= alone
    else:
        alone = np.zeros(n, bool)
    starts = np.flatnonzero(first)
    count = np.diff(np.append(np.cumsum(inside)[starts] - 1, inside.sum()))
    return starts, count.astype(np.int64), np.where(alone[starts], ALONE, anchor[starts] - starts)


def hash_at(text: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` bytes from every place on; at least eight."""
    rows = np.lib.stride_tricks.sliding_window_view(text, 8)
    h = np.zeros(len(places), np.uint64)
    for step in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        h = mixed(h ^ rows[places + step].view(">u8").ravel().astype(np.uint64))
    return h


def names(text: np.ndarray, starts: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """What pieces with equal windows have in common: the hash of the anchor, or of the whole content where a window stands alone."""
    alone = offset == ALONE
    name = np.empty(len(starts), np.uint64)
    name[~alone] = hash_at(text, (starts + offset)[~alone], GRAM)
    name[alone] = hash_at(text, starts[alone], length)
    return name


def equal_pieces(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """(one place of every distinct piece, number of its distinct piece for every piece); compares all bytes."""
    table = np.zeros((len(starts), widest + 1), np.uint8)
    for lo in range(0, len(starts), FILL_PIECES):
        first, bytes_ = starts[lo:lo + FILL_PIECES], sizes[lo:lo + FILL_PIECES]
        rows = np.repeat(np.arange(lo, lo + len(first)), bytes_)
        table[rows, spread_ranges(np.zeros(len(first), np.int64), bytes_)] = text[spread_ranges(first, bytes_)]
    table[:, widest] = sizes - sizes.min() + 1 if len(sizes) else 0
    _, place, group = np.unique(table.view(f"S{widest + 1}").ravel(), return_index=True, return_inverse=True)
    return place, group


def smallest(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    out = np.full(groups, np.iinfo(np.int64).max)
    np.minimum.at(out, group, values)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order: Larsson-Sadakane refinement.

    ``rank`` is the first place of a suffix's group in the order. Each round orders the members of groups that are not single yet by the
    group of the suffix that starts as far ahead as the order is deep already, which doubles that depth.
    """
    n = len(text)
    words = words_at(text)
    order = np.argsort(words, kind="stable")
    new = np.append(True, words[order[1:]] != words[order[:-1]])
    head = np.flatnonzero(new)
    sizes = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 8
    while len(slots):
        members = order[slots]
        ahead = members + h
        key = rank[members] * (n + h + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + h + 1, n - members)  # what ends goes first
        sort = np.argsort(key, kind="stable")
        members, key = members[sort], key[sort]
        order[slots] = members
        new = np.append(True, key[1:] != key[:-1])
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(members)))
        rank[members] = np.repeat(slots[head], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that every suffix shares with the one before it in the order, up to ``depth``: Kasai's scan in many lanes.

    In text order a suffix shares at least one byte less than its predecessor did, so each step only goes on from there.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = words_at(np.concatenate([text, np.zeros(depth + 8, np.uint8)]))
    shared = np.zeros(n, np.int64)
    stride = max(1, -(-n // LANES))
    at = np.arange(0, n, stride)
    have = np.zeros(len(at), np.int64)
    for _ in range(stride):
        here = at < n
        at, have = at[here], have[here]
        other = before[at]
        have = np.where(other < 0, 0, np.maximum(have - 1, 0))
        going = np.flatnonzero((other >= 0) & (have < depth))
        while len(going):
            a, b, k = at[going], other[going], have[going]
            differ = words[a + k] ^ words[b + k]
            # leading equal bytes of eight
            more = np.full(len(going), 8)
            some = differ != 0
            more[some] = (7 - np.floor(np.log2(differ[some].astype(np.float64)) / 8).clip(0, 7)).astype(np.int64)
            slip = some & ((differ >> ((7 - np.minimum(more, 7)).astype(np.uint64) * np.uint64(8))) == 0)
            more[slip] += 1  # the logarithm rounds up just below a power of two
            have[going] = np.minimum(np.minimum(k + more, depth), n - np.maximum(a, b))
            going = going[(more == 8) & (have[going] < depth) & (np.maximum(a, b) + have[going] < n)]
        shared[at] = have
        at = at + 1
    return shared[order]


def window_classes(text: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of every window, one place of every class in ascending order of content) for windows of one shard."""
    order = suffix_array(text)
    shared = common_prefixes(text, order, length)
    wanted = np.zeros(len(text), bool)
    wanted[windows] = True
    block = np.cumsum(shared < length)  # suffixes with an equal window follow each other
    kept = wanted[order]
    number = np.full(len(text), -1, np.int64)
    blocks, place, group = np.unique(block[kept], return_index=True, return_inverse=True)
    number[order[kept]] = group
    return number[windows], order[kept][place]


def contents(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(text, length)[at].view(f"S{length}").ravel()


def window_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from every place on."""
    words, n = words_at(text), len(text) - length + 1
    h = np.zeros(n, np.uint64)
    for step in [*range(0, length - 7, 8), length - 8]:
        h ^= words[step:step + n]
        h *= SPREAD
        h ^= h >> np.uint64(31)
    return h


def in_shards(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the pieces of every shard."""
    shard = (np.cumsum(sizes) - 1) // SHARD_BYTES
    edges = np.flatnonzero(np.append(True, np.diff(shard) != 0)) if len(shard) else shard
    for lo, hi in zip(edges, np.append(edges[1:], len(sizes))):
        yield np.arange(lo, hi)


def whole_families(family: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the pieces in parts of about SHARD_BYTES that hold whole families (pieces of one name); others share no window."""
    order = np.argsort(family, kind="stable")
    head = np.append(True, family[order[1:]] != family[order[:-1]])
    part = ((np.cumsum(sizes[order]) - sizes[order])[head] // SHARD_BYTES)[np.cumsum(head) - 1]
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def may_share(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Whether a piece has a window whose hash comes twice. The others cannot share a window and need no sorting."""
    sizes = counts + length - 1
    parts = []
    for mine in in_shards(sizes):
        local = text[spread_ranges(starts[mine], sizes[mine])]
        begin = np.cumsum(sizes[mine]) - sizes[mine]
        parts.append(window_hashes(local, length)[spread_ranges(begin, counts[mine])])
    h = np.concatenate(parts)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.add.reduceat(twice, np.cumsum(counts) - counts) > 0


def smallest_documents(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For every window of distinct pieces, piece by piece: the smallest document that has its content.

    Shards of bounded size are sorted on their own. Their sorted lists of distinct windows are merged by binary search.
    """
    sizes = counts + length - 1
    merged, least, parts = np.zeros(0, f"S{length}"), np.zeros(0, np.int64), []
    for mine in in_shards(sizes):
        local = text[spread_ranges(starts[mine], sizes[mine])]
        begin = np.cumsum(sizes[mine]) - sizes[mine]
        number, place = window_classes(local, spread_ranges(begin, counts[mine]), length)
        lists = contents(local, place, length)
        docs = smallest(np.repeat(doc[mine], counts[mine]), number, len(place))
        at = np.searchsorted(merged, lists)
        known = np.zeros(len(lists), bool)
        inner = at < len(merged)
        known[inner] = merged[at[inner]] == lists[inner]
        least[at[known]] = np.minimum(least[at[known]], docs[known])
        merged = np.insert(merged, at[~known], lists[~known])
        least = np.insert(least, at[~known], docs[~known])
        parts.append((number, lists))
    if len(parts) == 1:
        return least[parts[0][0]]
    return np.concatenate([least[np.searchsorted(merged, lists)[number]] for number, lists in parts] or [least])


def lost_runs(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, bytes) of the runs of windows that a document smaller than the piece's own, ``least``, has."""
    lost = smallest_documents(text, starts, counts, least, length) < np.repeat(least, counts)
    number = np.repeat(np.arange(len(counts)), counts)
    offset = spread_ranges(np.zeros(len(counts), np.int64), counts)
    other = number[1:] != number[:-1]
    opens = lost & np.append(True, ~lost[:-1] | other)
    closes = lost & np.append(~lost[1:] | other, True)
    return number[opens], offset[opens], offset[closes] - offset[opens] + length


class Codec:
    """Compression with a dictionary of sampled text, as the packed values are small."""

    def __init__(self, sample: bytes = b"", level: int = 6):
        known = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if sample else None
        if known:
            known.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=known).compress
        self.decompress = zstandard.ZstdDecompressor(dict_data=known).decompress

    def pack(self, **arrays: np.ndarray) -> bytes:
        """Named columns in one compressed value; numbers are laid out byte by byte, as their upper bytes are alike."""
        parts = [pa.array([a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()], pa.binary()) for a in arrays.values()]
        batch = pa.RecordBatch.from_arrays(parts, names=list(arrays))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return self.compress(sink.getvalue().to_pybytes())

    def unpack(self, packed: bytes, **kinds) -> list[np.ndarray]:
        batch = pa.ipc.open_stream(self.decompress(packed)).read_next_batch()
        planes = lambda name, kind: np.frombuffer(batch.column(name)[0].as_py(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
        return [np.ascontiguousarray(planes(name, kind).T).view(kind).ravel() for name, kind in kinds.items()]


def delta(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


KINDS = {"text": np.uint8, "size": np.uint8, "offset": np.uint8, "doc": np.int64, "tag": np.int64, "at": np.int64, "piece": np.int64, "gone": np.int64}


def batch_pieces(docs: list[tuple[int, int, int, bytes]], length: int, buckets: int, common: np.ndarray, codec: Codec) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed pieces) of a batch of (doc_id, tag, offset, bytes).

    Equal pieces of the batch travel once, with all their places in the smallest document; in its later documents they are gone already.
    """
    ids, tags, shift = (np.array([d[i] for d in docs], np.int64) for i in range(3))
    text = np.frombuffer(b"".join(d[3] for d in docs), np.uint8)
    ends = np.cumsum([len(d[3]) for d in docs])
    parts, done = [], 0
    for k in range(len(docs)):
        if ends[k] - done >= STEP_BYTES or k == len(docs) - 1:
            parts.append([done, *cut(text[done:ends[k]], ends[np.searchsorted(ends, done, "right"):k + 1] - done, length, common)])
            done = ends[k]
    starts = np.concatenate([p[0] + p[1] for p in parts])
    counts, offset = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    if not len(starts):
        return
    name = names(text, starts, offset, length)
    owner = np.searchsorted(ends, starts, "right")
    base = shift - np.append(0, ends[:-1])
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0))
    for lo, hi in zip(heads, np.append(heads[1:], len(by))):
        mine = by[lo:hi]
        sizes = counts[mine] + length - 1
        doc, tag, at = ids[owner[mine]], tags[owner[mine]], starts[mine] + base[owner[mine]]
        _, same = np.unique(name[mine], return_inverse=True)
        piece = np.arange(len(mine))
        again = np.flatnonzero(np.bincount(same)[same] > 1)
        if len(again):
            place, group = equal_pieces(text, starts[mine][again], sizes[again], 2 * length)
            piece[again] = again[place][group]
        least = smallest(doc, piece, len(mine))
        later = doc > least[piece]
        chosen = np.unique(piece)
        new = np.zeros(len(mine), np.int64)
        new[chosen] = np.arange(len(chosen))
        yield int(bucket[mine[0]]), codec.pack(
            text=text[spread_ranges(starts[mine][chosen], sizes[chosen])], size=sizes[chosen].astype(np.uint8), offset=offset[mine][chosen].astype(np.uint8),
            doc=delta(doc[~later]), tag=delta(tag[~later]), at=delta(at[~later]), piece=delta(new[piece[~later]]),
            gone=np.concatenate([delta(doc[later]), delta(tag[later]), delta(at[later]), counts[mine][later]]))


def resolve(blobs: list[bytes], length: int, codec: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, tag, first byte, number of bytes) of the strings of a bucket that also start in a smaller document."""
    parts = [codec.unpack(b, **KINDS) for b in blobs]
    gone = [np.split(p[7], 4) for p in parts]
    out = [[np.cumsum(g[0]), np.cumsum(g[1]), np.cumsum(g[2]), g[3] + length - 1] for g in gone if len(g[0])]
    text = np.concatenate([p[0] for p in parts])
    sizes = np.concatenate([p[1] for p in parts]).astype(np.int64)
    doc, tag, at = (np.concatenate([np.cumsum(p[i]) for p in parts]) for i in (3, 4, 5))
    shift = np.cumsum([0, *[len(p[1]) for p in parts]])
    piece = np.concatenate([np.cumsum(p[6]) + s for p, s in zip(parts, shift)])
    starts = np.cumsum(sizes) - sizes
    gram = names(text, starts, np.concatenate([p[2] for p in parts]).astype(np.int64), length)
    # Anchors of one document only are of no interest.
    _, group = np.unique(gram, return_inverse=True)
    top = group.max() + 1 if len(group) else 0
    low, high = smallest(doc, group[piece], top), -smallest(-doc, group[piece], top)
    kept = (low != high)[group]
    if kept.any():
        chosen = np.flatnonzero(kept)
        place, distinct = equal_pieces(text, starts[chosen], sizes[chosen], 2 * length)
        rename = np.full(len(sizes), -1, np.int64)
        rename[chosen] = distinct
        seen = rename[piece] >= 0
        doc, tag, at, which = doc[seen], tag[seen], at[seen], rename[piece[seen]]
        least = smallest(doc, which, len(place))
        later = doc > least[which]
        count = sizes[chosen[place]] - length + 1
        out.append([doc[later], tag[later], at[later], count[which[later]] + length - 1])
        doc, tag, at, which = doc[~later], tag[~later], at[~later], which[~later]
        # Anchors with several distinct pieces: their windows are compared.
        family = group[chosen[place]]
        open_ = np.flatnonzero(np.bincount(family, minlength=top)[family] > 1)
        found = []
        for part in whole_families(family[open_], count[open_] + length - 1) if len(open_) else []:
            part = open_[part]
            part = part[may_share(text, starts[chosen[place[part]]], count[part], length)]
            if len(part):
                number, run_at, run_size = lost_runs(text, starts[chosen[place[part]]], count[part], least[part], length)
                found.append((part[number], run_at, run_size))
        if found:
            run_piece, run_at, run_size = (np.concatenate(c) for c in zip(*found))
            by = np.argsort(run_piece, kind="stable")
            run_piece, run_at, run_size = run_piece[by], run_at[by], run_size[by]
            runs = np.bincount(run_piece, minlength=len(place))
            first = np.cumsum(runs) - runs
            many = runs[which]
            pick = spread_ranges(first[which], many)
            out.append([np.repeat(doc, many), np.repeat(tag, many), np.repeat(at, many) + run_at[pick], run_size[pick]])
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Documents in batches of about BATCH_BYTES; a longer document comes in overlapping parts."""
    held, size = [], 0
    for batch in rows:
        for doc, tag, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            raw, length = text, len(text)
            for start in range(0, length, STEP_BYTES):
                part = raw[start:start + STEP_BYTES + 63]
                held.append((doc, tag, start, part))
                size += len(part)
                if size >= BATCH_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def common_anchors(docs: DataFrame, length: int) -> list[int]:
    """Hashes of at most COMMON_ANCHORS anchors that hold a large part of a share of the rows' pieces.

    Their windows are dealt out one by one by their whole content, so that no bucket has to hold all of them.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _batches(rows):
            text = np.frombuffer(b"".join(d[3] for d in docs), np.uint8)
            starts, _, offset = cut(text, np.cumsum([len(d[3]) for d in docs]), length, np.zeros(0, np.uint64))
            if len(starts):
                anchors, n = np.unique(names(text, starts, offset, length), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    share = docs.where(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(SAMPLE_SHARE)) == 0)
    # pieces have 20 windows on average, so every 40th byte starts one at least in all but odd texts
    total = (share.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0) // 40
    seen = map_texts(share, run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    return [r.anchor for r in seen.where(F.col("n") > max(1000, total // COMMON_ANCHORS)).orderBy(F.desc("n"), "anchor").limit(COMMON_ANCHORS).collect()]


def sample_text(docs: DataFrame, rows: int) -> bytes:
    """Up to SAMPLE_TEXT bytes of text from about 1,000 of ``rows`` rows that a hash picks, at most 1 KB of each."""
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(max(1, rows // 1024))) == 0).select(F.substring("text", 1, 1024).alias("text"))
    return b"".join(r.text for r in picked.limit(2048).collect())[:SAMPLE_TEXT]


def repeated_spans(docs: DataFrame, length: int, total: int, sample: bytes) -> DataFrame:
    """(doc_id, tag, spans): byte ranges (start * 128 + size) that also start in a smaller document; ranges overlap and touch.

    ``total`` is the number of bytes of all texts, ``sample`` some of them.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(total * 3.5 / BUCKET_BYTES))
    common = np.array(common_anchors(docs, length), np.int64).view(np.uint64)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sample)
        for batch in _batches(rows):
            packed = list(batch_pieces(batch, length, buckets, common, codec))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int32()), pa.array([p[1] for p in packed], pa.binary())], names=["bucket", "packed"])

    def merge(table: pa.Table) -> pa.Table:
        doc, tag, at, size = resolve(table.column("packed").to_pylist(), length, Codec(sample))
        return pa.table({"doc_id": doc, "tag": tag, "span": at * 128 + size})

    found = map_texts(docs, deal, "bucket int, packed binary").groupBy("bucket").applyInArrow(merge, "doc_id bigint, tag bigint, span bigint")
    return found.groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans"))


def covered(spans: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal ranges that the spans cover."""
    if spans is None or not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, sizes = np.divmod(spans, 128)
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate((starts + sizes)[by])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(new[1:], True)]


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row: its text without what an earlier document has.

    A byte goes if a string of ``length`` bytes over it also starts in a row with a smaller id; strings are judged on the input. ``kept``
    is what remains, as bytes (a cut may split a character). Ids are whole numbers; ``length`` is 16 to 60.

    A null text counts as empty. Texts shorter than ``length`` stay whole. Rows with a null id stay whole and take nothing from others.
    Rows with the same id do not judge each other; equal rows get equal results. Other columns are ignored.
    """
    if not 16 <= length <= 60:
        raise ValueError("length must be 16 to 60 bytes")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    # Without repeated ids the id names a row; else a hash of the text tells rows of one id apart.
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").limit(1).count()
    rows = rows.withColumn("tag", F.xxhash64("text") if twice else F.lit(0).cast("bigint")).select("doc_id", "tag", "text")
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("bytes")).first()
    sample = sample_text(rows, facts.rows)
    spans = materialize(repeated_spans(rows.where("doc_id is not null"), length, facts.bytes, sample))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sample)
        for batch in batches:
            out = []
            for packed, found in zip(batch.column(1), batch.column(2)):
                raw = codec.decompress(packed.as_py()) if packed.as_py() else b""
                starts, ends = covered(found.values.to_numpy(zero_copy_only=False) if found.is_valid else None)
                kept = b"".join([raw[a:b] for a, b in zip(np.append(0, ends), np.append(starts, len(raw)))])
                out.append((len(raw), len(raw) - len(kept), len(starts), kept))
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sample, 3)
        for batch in batches:
            small = [codec.compress(t) if t else b"" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], names=["doc_id", "tag", "text"])

    small = map_texts(rows, squeeze, "doc_id bigint, tag bigint, text binary")
    joined = small.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return map_texts(joined, apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
