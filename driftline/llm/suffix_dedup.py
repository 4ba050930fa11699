"""Removal of repeated substrings with suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document with a smaller id, or earlier in
the same document. Equal strings are brought together without comparing shards pair by pair:

1. In every window of LENGTH bytes the smallest hashed k-gram (the leftmost of equals) is the window's anchor. It depends on
   the window's bytes only. Anchors are counted over all documents, packed by hash range; windows whose anchor occurs once
   cannot repeat.
2. The stretch of windows around each other anchor goes to the shard of the anchor's hash. Equal stretches of one task are
   sent once, with their first place; the later ones are gone at once.
3. Each shard builds the suffix array of its stretches by Larsson-Sadakane refinement (until LENGTH bytes are told apart),
   gets common prefixes by Kasai's rule, and so has the classes of equal windows, in sorted order, each with its first place.
4. A hash range that is too large for one shard, since an anchor is in a great part of all documents, is split into several
   shards. Each of them lists its classes sorted by a 128-bit hash of the window. The lists are cut into as many slices as the
   range's size asks for, and the lists of a slice are merged two by two: every class of one is looked up in the other by
   binary search. Equal hashes stand for equal windows there.
5. The later places of each class, as spans, are joined to the documents.

The working tables and shuffle files of each step go once the next one is written, so that the disk holds those of one step at a time.

Defined results: a null text is empty; texts shorter than LENGTH stay whole; strings never cross documents. Rows that agree in
doc_id and text are one document to each other (they stay alike); rows that agree in the id only are ordered by a hash of
the text; a null id comes after all others. An empty table gives an empty result. A long text is taken in
pieces that overlap by LENGTH - 1 bytes. Ids are whole numbers: an id that is no number is an error of the cast. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import corpus_size, discard, release, table, text_of, workdir, written
from .shingles import mix, runs

LENGTH = 100
GRAM = 16
#: Bytes handled at a time within a task (a longer document is taken in overlapping pieces), anchors per packed block,
#: anchors per hash range when counting, bytes of stretches per shard, slices of a hash range for each of its shards, rounds in which
#: the hash ranges are dealt to shards (the shuffle holds those of one round beside the table of all), and the same for the documents.
PIECE, BLOCK, RANGE, SHARD, SLICES, ROUNDS, HALVES = 1 << 22, 400_000, 1_000_000, 6_000_000, 4, 4, 2
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For joined texts: the starts of the runs of windows that share an anchor, the last window of each, and its anchor.

    ends: for each text its end in data. Windows are named by their first byte.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    words = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    key = (mix(words[: n - gram + 1] + _U(0x9E3779B97F4A7C15)) + words[gram - 8 : gram - 8 + n - gram + 1]) * _U(0xBF58476D1CE4E5B9)
    key ^= key >> _U(31)
    key = (key & ~_LOW) | np.arange(len(key), dtype=np.uint64)  # the leftmost of equals
    width = length - gram + 1
    best = _sliding_min(key, width)
    # Windows that end within their own text.
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, dtype=np.int32)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    valid = np.cumsum(inside[: len(best)]) > 0
    at = (best & _LOW).astype(np.int64)
    change = np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])])
    first = np.nonzero(change)[0]
    last = np.append(first[1:], len(best)) - 1
    keep = valid[first]
    return first[keep], last[keep], at[first[keep]]


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, from running minima of blocks in both directions."""
    n = len(key)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = key
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def gram_hashes(data: np.ndarray, at: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the k-gram at each of the places."""
    words = np.ndarray(shape=(max(0, len(data) - 7),), dtype="<u8", buffer=data.data, strides=(1,))
    return mix(mix(words[at]) + words[at + gram - 8]) if len(at) else np.zeros(0, np.uint64)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined pieces of bounded size: data, ends, number of the text and offset in it of each part.

    A long text comes in parts that overlap by length - 1 bytes, so that each window lies in exactly one of them.
    """
    parts, total = [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            cut = t[at : at + PIECE]
            if total + len(cut) > PIECE and parts:
                yield _joined(parts)
                parts, total = [], 0
            parts.append((i, at, cut))
            total += len(cut)
            if at + PIECE >= len(t):
                break
            at += PIECE - length + 1
    if parts:
        yield _joined(parts)


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p[2] for p in parts) + bytes(16), dtype=np.uint8)
    ends = np.cumsum([len(p[2]) for p in parts])
    return data[: ends[-1] + 16], ends, np.array([p[0] for p in parts]), np.array([p[1] for p in parts])


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by Larsson-Sadakane refinement, until they are told apart by `depth` leading bytes.

    The first key is the leading eight bytes. From then on only groups that are still tied are sorted again, by the ranks of
    the suffixes h bytes further on, and h doubles. The end of the data sorts as zero bytes.
    """
    n = len(data)
    key = np.ndarray(shape=(n,), dtype=">u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    ranked = key[order]
    head = np.empty(n, dtype=bool)
    head[:1], head[1:] = True, ranked[1:] != ranked[:-1]
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # of each place, the first one of its group
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = place, -1
    h = 8
    tied = np.nonzero(~(head & np.append(head[1:], True)))[0]  # places in groups of two or more
    while len(tied) and h < depth:
        suffix = order[tied]
        both = (place[tied].astype(np.uint64) << _U(32)) | (rank[np.minimum(suffix + h, n)] + 1).astype(np.uint64)
        by = np.argsort(both)
        both, suffix = both[by], suffix[by]
        order[tied] = suffix
        head = np.empty(len(tied), dtype=bool)
        head[:1], head[1:] = True, both[1:] != both[:-1]
        first = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        place[tied] = rank[suffix] = first
        tied = tied[~(head & np.append(head[1:], True))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, cap: int) -> np.ndarray:
    """For each place of the order, the common prefix with the suffix before it, up to about `cap`, by Kasai's rule.

    Taken in text order, where the neighbour moves along by one byte the prefix gets shorter by one; only elsewhere, and at
    the starts of stretches, are bytes compared, eight at a time.
    """
    n = len(order)
    prior = np.full(n, -1, dtype=np.int64)
    prior[order[1:]] = order[:-1]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (prior[1:] != prior[:-1] + 1) | (prior[:-1] < 0)
    fresh[starts] = True
    at = np.nonzero(fresh)[0]
    words = np.ndarray(shape=(n,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    size = np.zeros(len(at), dtype=np.int64)
    live = np.nonzero(prior[at] >= 0)[0]
    while len(live):
        a, b = at[live] + size[live], prior[at[live]] + size[live]
        ok = (a < n) & (b < n)
        x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        same = np.where(ok, np.where(x == 0, 8, _zero_bytes(x)), 0)
        size[live] += same
        live = live[(same == 8) & (size[live] < cap)]
    top = np.zeros(n, dtype=np.int64)
    top[at] = size
    run = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(top[run] - (np.arange(n) - run), 0)[order]


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the lowest bytes are zero."""
    low = x & (~x + _U(1))
    return np.log2(np.maximum(low, _U(1)).astype(np.float64)).astype(np.int64) >> 3


def spans_of(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes covered by the windows at sorted places, neighbours joined."""
    cut = np.nonzero(np.diff(places) != 1)[0]
    return places[np.concatenate([[0], cut + 1])], places[np.append(cut, len(places) - 1)] + length


class _Stretches:
    """Stretches of one hash range: bytes, and where each comes from."""

    def __init__(self, ids, keys, pos, anchor, sizes, data):
        self.ids, self.keys, self.pos, self.anchor, self.sizes, self.data = ids, keys, pos, anchor, sizes, data

    @staticmethod
    def read(rows: list[dict]) -> _Stretches:
        col = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in rows])
        return _Stretches(col("ids", np.int64), col("keys", np.int64), col("pos", np.int64), col("anchor", np.uint64), col("sizes", np.int64), col("data", np.uint8))


def _doc_order(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Dense rank of (id, key); equal for the same document."""
    by = np.lexsort((keys, ids))
    new = np.concatenate([[False], (ids[by][1:] != ids[by][:-1]) | (keys[by][1:] != keys[by][:-1])])
    out = np.empty(len(ids), dtype=np.int64)
    out[by] = np.cumsum(new)
    return out


def _emit_spans(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, length: int, rows: list) -> None:
    """Rows of spans by document for the removed windows (ids, keys, at)."""
    if not len(ids):
        return
    by = np.lexsort((at, keys, ids))
    ids, keys, at = ids[by], keys[by], at[by]
    new = np.nonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))[0]
    for a, b in zip(new, np.append(new[1:], len(ids)), strict=True):
        start, end = spans_of(at[a:b], length)
        rows.append({"kind": 0, "id": int(ids[a]), "key": int(keys[a]), "a": start.tobytes(), "b": end.tobytes()})


_FOUND = "kind int, bucket int, slice int, id bigint, key bigint, a binary, b binary, c binary, d binary, e binary, f binary"
_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("slice", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), *[(c, pa.binary()) for c in "abcdef"]])


def _windows(s: _Stretches, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes with separators, the stretch of each byte, and the starts of the stretches."""
    m = len(s.sizes)
    starts = np.concatenate([[0], np.cumsum(s.sizes + 1)[:-1]])
    data = np.full(int(s.sizes.sum()) + m, 0xFF, dtype=np.uint8)
    stretch = np.repeat(np.arange(m), s.sizes + 1)
    inner = np.ones(len(data), dtype=bool)
    inner[starts + s.sizes] = False
    data[inner] = s.data
    return data, stretch, starts


def resolve(s: _Stretches, length: int, rows: list, bucket: int = 0, slices: int = 0) -> None:
    """Spans of the repeated windows of one shard; with slices, its classes sorted by hash and cut into these as well."""
    doc = _doc_order(s.ids, s.keys)
    # Equal stretches: the first place stands for them, the others are gone whole.
    begin = np.concatenate([[0], np.cumsum(s.sizes)[:-1]])
    raw = s.data.tobytes()
    seen: dict[bytes, int] = {}
    keep = []
    for i in np.lexsort((s.pos, doc)):
        body = raw[begin[i] : begin[i] + s.sizes[i]]
        j = seen.setdefault(body, i)
        if j == i:
            keep.append(i)
        elif doc[i] != doc[j] or s.pos[i] != s.pos[j]:
            rows.append({"kind": 0, "id": int(s.ids[i]), "key": int(s.keys[i]), "a": np.int64(s.pos[i]).tobytes(), "b": np.int64(s.pos[i] + s.sizes[i]).tobytes()})
    keep = np.array(keep)
    inner = np.zeros(len(s.data) + 1, dtype=np.int32)
    np.add.at(inner, begin[keep], 1), np.add.at(inner, begin[keep] + s.sizes[keep], -1)
    one = _Stretches(s.ids[keep], s.keys[keep], s.pos[keep], s.anchor[keep], s.sizes[keep], np.frombuffer(b"".join(raw[begin[i] : begin[i] + s.sizes[i]] for i in keep), np.uint8))
    doc = doc[keep]
    data, stretch, starts = _windows(one, length)
    order = suffix_array(data, length)
    prefix = common_prefixes(data, order, starts, length + int(one.sizes.max()) + 8)
    offset = np.arange(len(data)) - starts[stretch]
    window = (offset + length <= one.sizes[stretch])[order]
    cls = np.cumsum(prefix < length)[window]
    at = order[window]
    own = stretch[at]
    place = one.pos[own] + offset[at]
    head = np.nonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))[0]
    count = np.diff(np.append(head, len(cls)))
    # The first place of each class: the least document, then the least byte.
    rank = doc[own] * (int(place.max()) + 1) + place if int(doc.max() + 1) * (int(place.max()) + 1) < 1 << 62 else None
    if rank is None:
        by = np.lexsort((place, doc[own]))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(np.concatenate([[False], (doc[own][by][1:] != doc[own][by][:-1]) | (place[by][1:] != place[by][:-1])]))
    first = np.minimum.reduceat(rank, head)
    gone = rank != np.repeat(first, count)
    _emit_spans(one.ids[own[gone]], one.keys[own[gone]], place[gone], length, rows)
    if not slices:
        return
    lead = np.nonzero(~gone)[0]
    lead = lead[np.nonzero(np.concatenate([[True], cls[lead][1:] != cls[lead][:-1]]))[0]]
    low, high = _window_hashes(data, at[lead], length)
    by = np.lexsort((high, low))
    low, high, lead = low[by], high[by], lead[by]
    width = -(-(1 << 64) // slices)
    bounds = np.append(np.searchsorted(low, np.array([width * k for k in range(slices)], np.uint64)), len(low))
    for k in range(slices):
        x, y = bounds[k], bounds[k + 1]
        if x < y:
            who = lead[x:y]
            rows.append({"kind": 1, "bucket": bucket, "slice": k, "a": low[x:y].tobytes(), "b": high[x:y].tobytes(), "c": one.ids[own[who]].tobytes(), "d": one.keys[own[who]].tobytes(), "e": place[who].tobytes()})


def _window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the windows at the given places."""
    words = np.ndarray(shape=(len(data),), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    low, high = np.full(len(at), length, np.uint64), np.full(len(at), ~length & (1 << 64) - 1, np.uint64)
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for k in steps:
        low, high = mix(low ^ words[at + k]), mix((high + words[at + k]) * _U(0x9E3779B97F4A7C15))
    return low, high


def _shard(length: int):
    def run(group: pa.Table) -> pa.Table:
        got = group.to_pylist()
        rows: list[dict] = [{"kind": 0, "id": r["id"], "key": r["key"], "a": r["a"], "b": r["b"]} for r in got if r["kind"] == 1]
        plain = [r for r in got if r["kind"] == 0]
        if plain:
            shards = plain[0]["shards"]
            resolve(_Stretches.read(plain), length, rows, plain[0]["bucket"], SLICES * shards if shards > 1 else 0)
        return pa.Table.from_pylist(rows, schema=_FOUND_SCHEMA)

    return run


class _Classes:
    """Classes in the order of their keys, distinct ones: of each the key (16 bytes of hash) and the first place."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray):
        self.key, self.ids, self.keys, self.at = key, ids, keys, at

    @staticmethod
    def read(row: dict) -> _Classes:
        words = np.stack([np.frombuffer(row[c], np.uint64) for c in "ab"], axis=1)
        key = words.astype(">u8").view("S16")[:, 0]  # sorts as the pair of words does
        return _Classes(key, *(np.frombuffer(row[c], np.int64) for c in "cde"))

    def take(self, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[by], self.keys[by], self.at[by]


def merge_classes(a: _Classes, b: _Classes) -> tuple[_Classes, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Both lists as one, with the lesser place where a class is in both, and the other places (ids, keys, at), which go.
    A place that is in both lists, as of rows that are repeated, stays once and does not go."""
    if len(a.key) < len(b.key):
        a, b = b, a
    spot = np.searchsorted(a.key, b.key)
    hit = np.zeros(len(b.key), dtype=bool)
    inside = np.nonzero(spot < len(a.key))[0]
    hit[inside] = a.key[spot[inside]] == b.key[inside]
    mine, its = spot[hit], np.nonzero(hit)[0]
    (ai, ak, ap), (bi, bk, bp) = a.take(mine), b.take(its)
    same = (ai == bi) & (ak == bk)
    later = (bi < ai) | (bi == ai) & (bk < ak) | same & (bp < ap)  # a's place is the later one
    other = ~(same & (ap == bp))
    lost = tuple(np.where(later, x, y)[other] for x, y in ((ai, bi), (ak, bk), (ap, bp)))
    cols = []
    for x, y in ((a.ids, b.ids), (a.keys, b.keys), (a.at, b.at)):
        x = x.copy()
        x[mine[later]] = y[its[later]]
        cols.append(np.insert(x, spot[~hit], y[~hit]))
    return _Classes(np.insert(a.key, spot[~hit], b.key[~hit]), *cols), lost


def _merge(length: int):
    """One slice of the classes of several shards: all but the first place of each class go."""

    def run(group: pa.Table) -> pa.Table:
        lists = [_Classes.read(r) for r in group.select(list("abcde")).to_pylist()]
        rows: list[dict] = []
        while len(lists) > 1:
            pairs = [merge_classes(a, b) for a, b in zip(lists[::2], lists[1::2], strict=False)]
            for _, lost in pairs:
                if len(lost[0]):
                    _emit_spans(*lost, length, rows)
            lists = [c for c, _ in pairs] + lists[2 * len(pairs) :]
        return pa.Table.from_pylist(rows, schema=_FOUND_SCHEMA)

    return run


_PACKED = "block string, bucket int, kind int, docs int, counts binary, hashes binary, ids binary, keys binary"


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _runs(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Of each piece: data, and for each run its text, offset of the piece, first and last window, anchor place and hash."""
    for data, ends, number, offset in pieces(texts, length):
        first, last, at = anchors(data[:-16] if len(data) else data, ends, length)
        part = np.searchsorted(ends, first, side="right")
        begin = np.concatenate([[0], ends[:-1]])[part] if len(part) else np.zeros(0, np.int64)
        yield data, number[part], offset[part] - begin, first, last, at, gram_hashes(data, at)


def _pack_anchors(length: int, bits: int):
    def out(ids: list, keys: list, sets: list[np.ndarray], name: str) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], dtype=np.uint32)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        bucket = (hashes >> _U(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, ordered = bucket[order], hashes[order]
        rows = [(name, int(bucket[a]), 0, len(sets), None, ordered[a:b].tobytes(), None, None) for a, b in runs(bucket)]
        where = int(np.frombuffer(name.encode(), np.uint8).astype(np.int64).sum() * 2654435761 % (1 << bits))
        rows.append((name, where, 1, len(sets), n.tobytes(), (hashes >> _U(64 - bits)).astype(np.uint32).tobytes(), np.array(ids, np.int64).tobytes(), np.array(keys, np.int64).tobytes()))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[p.split()[0] for p in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        ids, keys, sets, total = [], [], [], 0
        for batch in batches:
            texts = _texts(batch)
            own: list[list[np.ndarray]] = [[] for _ in texts]
            for _, number, _, _, _, _, hashes in _runs(texts, length):
                for a, b in runs(number):
                    own[number[a]].append(hashes[a:b])
            for i, doc, key in zip(range(len(texts)), batch.column("id").to_pylist(), batch.column("key").to_pylist(), strict=True):
                ids.append(doc), keys.append(key)
                sets.append(np.concatenate(own[i]) if own[i] else np.zeros(0, np.uint64))
                total += len(sets[-1]) + 1
                if total >= BLOCK:
                    yield out(ids, keys, sets, f"{part}-{block}")
                    ids, keys, sets, total, block = [], [], [], 0, block + 1
        if ids:
            yield out(ids, keys, sets, f"{part}-{block}")

    return run


def _count_anchors(group: pa.Table) -> pa.Table:
    got = group.to_pylist()
    plain = [r for r in got if r["kind"] == 0]
    rows = [(r["block"], 1, r["bucket"], r["counts"], r["hashes"], r["ids"], r["keys"]) for r in got if r["kind"] == 1]
    if plain:
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in plain])
        order = np.argsort(hashes)
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        many = np.empty(len(hashes), dtype=bool)
        many[order] = np.concatenate([[False], same]) | np.append(same, False)
        at = 0
        for r in plain:
            n = len(r["hashes"]) // 8
            rows.append((r["block"], 0, r["bucket"], None, np.packbits(many[at : at + n]).tobytes(), None, None))
            at += n
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "kind", "bucket", "counts", "hashes", "ids", "keys"])


def _return_bits(group: pa.Table) -> pa.Table:
    got = group.to_pylist()
    head = next(r for r in got if r["kind"] == 1)
    counts = np.frombuffer(head["counts"], np.uint32)
    bucket = np.frombuffer(head["hashes"], np.uint32)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    size = dict(zip(names.tolist(), np.diff(np.append(first, len(bucket))).tolist(), strict=True))
    start = dict(zip(names.tolist(), first.tolist(), strict=True))
    many = np.zeros(len(bucket), dtype=bool)
    for r in got:
        if r["kind"] == 0:
            n, a = size[r["bucket"]], start[r["bucket"]]
            many[order[a : a + n]] = np.unpackbits(np.frombuffer(r["hashes"], np.uint8), count=n).astype(bool)
    ends = np.cumsum(counts)
    some = [bool(many[e - c : e].any()) for e, c in zip(ends, counts, strict=True)]
    pick = np.nonzero(some)[0]
    ids, keys = np.frombuffer(head["ids"], np.int64)[pick], np.frombuffer(head["keys"], np.int64)[pick]
    bits = [np.packbits(many[ends[i] - counts[i] : ends[i]]).tobytes() for i in pick]
    return pa.Table.from_arrays([pa.array(ids), pa.array(keys), pa.array(bits, pa.binary())], names=["id", "key", "bits"])


_STRETCH = "bucket int, block string, kind int, size bigint, ids binary, keys binary, pos binary, anchor binary, sizes binary, data binary, id bigint, key bigint, a binary, b binary"


def _cut_stretches(length: int, bits: int):
    """Stretches around repeated anchors by hash range; equal ones of a batch once, the later ones as spans (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = _texts(batch)
            ids, keys = np.array(batch.column("id").to_pylist(), np.int64), np.array(batch.column("key").to_pylist(), np.int64)
            known = [None if b is None else np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for b in batch.column("bits").to_pylist()]
            keep = [i for i, k in enumerate(known) if k is not None]
            used = np.zeros(len(texts), dtype=np.int64)
            for data, number, shift, first, last, at, hashes in _runs([texts[i] for i in keep], length):
                number = np.array(keep)[number] if len(number) else number
                # How often each anchor's run has been seen within its document so far gives its bit.
                many = np.zeros(len(number), dtype=bool)
                for a, b in runs(number):
                    i = number[a]
                    many[a:b] = known[i][used[i] : used[i] + b - a]
                    used[i] += b - a
                f, e, number, shift, hashes = first[many], last[many] + 1, number[many], shift[many], hashes[many]
                if not len(f):
                    continue
                size = e - f + length - 1
                block += 1
                yield _stretch_rows(f"{part}-{block}", data, ids[number], keys[number], f + shift, f, size, hashes, bits, length)

    return run


def _stretch_rows(name: str, data, ids, keys, pos, at, size, hashes, bits: int, length: int) -> pa.RecordBatch:
    raw = data.tobytes()
    order = np.lexsort((pos, keys, ids))
    seen: dict[bytes, int] = {}
    keep, rows, spans = [], [], {}
    for i in order.tolist():
        body = raw[at[i] : at[i] + size[i]]
        j = seen.setdefault(body, i)
        if i == j:
            keep.append(i)
        elif ids[i] != ids[j] or keys[i] != keys[j] or pos[i] != pos[j]:
            spans.setdefault((int(ids[i]), int(keys[i])), []).append((int(pos[i]), int(pos[i] + size[i])))
    keep = np.array(keep)
    bucket = (hashes[keep] >> _U(64 - bits)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    keep, bucket = keep[by], bucket[by]
    for a, b in runs(bucket):
        k = keep[a:b]
        body = b"".join(raw[at[i] : at[i] + size[i]] for i in k.tolist())
        rows.append((int(bucket[a]), name, 0, len(body), ids[k].tobytes(), keys[k].tobytes(), pos[k].astype(np.int64).tobytes(), hashes[k].tobytes(), size[k].astype(np.int64).tobytes(), body, None, None, None, None))
    for n, ((i, key), own) in enumerate(spans.items()):
        a, b = np.array(own, np.int64).T
        rows.append((hash((i, key, n)) % (1 << bits), name, 1, 0, None, None, None, None, None, None, i, key, np.ascontiguousarray(a).tobytes(), np.ascontiguousarray(b).tobytes()))
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[p.split()[0] for p in _STRETCH.split(", ")])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply the spans to each text."""
    for batch in batches:
        out = []
        for text, starts, ends in zip(_texts(batch), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            n = len(text)
            if not starts:
                out.append((n, 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            a, b = np.concatenate([np.frombuffer(x, np.int64) for x in starts]), np.concatenate([np.frombuffer(x, np.int64) for x in ends])
            by = np.argsort(a, kind="stable")
            a, b = a[by], np.maximum.accumulate(b[by])
            new = np.nonzero(np.concatenate([[True], a[1:] > b[:-1]]))[0]
            a, b = a[new], b[np.append(new[1:], len(b)) - 1]
            kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), n], strict=True))
            out.append((n, n - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """id, key, starts, ends (arrays of packed offsets) for each document of docs (doc_id, id, key, text) that loses bytes."""
    spark = docs.sparkSession
    out = workdir(spark, "suffix-dedup")
    rows, total = corpus_size(docs)
    bits = min(24, max(3, math.ceil(math.log2(max(1, total / 40 / RANGE)))))
    packed = docs.select("id", "key", "text").mapInArrow(_pack_anchors(length, bits), _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count_anchors, "block string, kind int, bucket int, counts binary, hashes binary, ids binary, keys binary")
    answers = counted.groupBy("block").applyInArrow(_return_bits, "id bigint, key bigint, bits binary")
    answers = written(answers.groupBy("id", "key").agg(F.first("bits").alias("bits")), f"{out}/anchors")
    release(spark)
    wide = min(24, max(4, math.ceil(math.log2(max(1, total / (shard / 2))))))
    parts = []
    for k in range(HALVES):
        some = docs.select("id", "key", "text").where(F.pmod(F.xxhash64("id"), F.lit(HALVES)) == k)
        some = some.join(answers.hint("shuffle_hash"), ["id", "key"]).mapInArrow(_cut_stretches(length, wide), _STRETCH)
        parts.append(written(some, f"{out}/stretches/{k}"))
        release(spark)
    discard(spark, f"{out}/anchors")
    stretches = reduce(DataFrame.unionByName, parts)
    # A hash range that is too large is dealt over several shards, block by block.
    large = stretches.groupBy("bucket").agg(F.sum("size").alias("total")).where(F.col("total") > shard).select("bucket", F.ceil(F.col("total") / shard * 2).cast("int").alias("shards"))
    dealt = stretches.join(large, "bucket", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("block"), F.col("shards")).cast("int"))
    parts = []
    for k in range(ROUNDS):
        some = dealt.where(F.col("bucket") % ROUNDS == k).groupBy("bucket", "shard").applyInArrow(_shard(length), _FOUND)
        parts.append(written(some, f"{out}/found/{k}"))
        release(spark)
    discard(spark, f"{out}/stretches")
    found = reduce(DataFrame.unionByName, parts)
    merged = found.where("kind = 1").groupBy("bucket", "slice").applyInArrow(_merge(length), _FOUND)
    spans = found.where("kind = 0").select("id", "key", "a", "b").unionByName(merged.select("id", "key", "a", "b"))
    spans = written(spans.groupBy("id", "key").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends")), f"{out}/spans")
    release(spark)
    discard(spark, f"{out}/found")
    return spans


def suffix_dedup(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("key"), "text")
    spans = repeated_spans(rows, length, shard)
    return rows.join(spans.hint("shuffle_hash"), ["id", "key"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(_finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
