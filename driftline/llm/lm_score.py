"""Language-model scores by masked pseudo-likelihood.

The vocabulary holds the most frequent words of all documents and grows with their distinct words; any other word is
predicted as one rare word and then spelled by a character model (trigrams, backing off) counted over all rare words. So
each word has a probability of its own. As context a rare word stands by a hash of its ending. A bidirectional
window network (two words on either side, one hidden layer, a softmax over word classes and one within the class) learns in
numpy to predict masked words: in each of two rounds every block of documents trains on every second word of all its documents
from the same start, and the blocks' weights are averaged by the number of their words, in a tree. The rounds take turns, so
that every word of every document is a target once. Texts are turned into ids once, which training and scoring read.
The score of a document is the sum, over each of its words, of the log probability of the word given the words on both sides,
and of its spelling if it is rare. Very long texts are taken in pieces of their ids.

Defined results: null and empty texts have no words, a sum of 0 and a mean of 0; repeated rows score alike; without any
word the network stays at its start; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, workdir, written

#: Classes and words in each, at least; from GROWTH times the fourth root of the distinct words, both grow with that.
CLASSES, IN_CLASS, GROWTH = 32, 64, 2
WORDS = CLASSES * IN_CLASS
#: The id of any rare word as a target; rows of embeddings for endings of rare words, for each word of a class; weight of
#: the shorter context in the spelling.
RARE, ENDINGS, BACK = 0, 16, 2.0
WIDTH, SIDE = 24, 2
ROUNDS, BATCH, RATE = 2, 4096, 0.1
#: Keeps rows of embeddings that were seen a few times only, as most endings of rare words, from learning those places by heart.
DAMP = 1e-3
#: Words that are scored at once, words that a task counts before it lets them go, characters split at once.
PIECE, FLUSH, CHARACTERS = 1 << 13, 2_000_000, 1 << 22
#: Words of a block that is trained by itself, at least; weights in a slice, and slices in one mean.
BLOCK, SLICE, FAN = 2_000_000, 1 << 12, 32
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in small letters, and for each the number of its text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    words, of = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty word there
    return words.filter(full), of.filter(full).to_numpy()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []

    def out() -> pa.RecordBatch:
        word, n = pa.chunked_array(held, pa.string()).value_counts().flatten()
        held.clear()
        return pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

    for batch in batches:
        texts = batch.column(0)
        for a, b in _groups(pc.utf8_length(texts).to_pylist(), CHARACTERS):
            held.append(_split(texts.slice(a, b - a))[0])
            if sum(map(len, held)) > FLUSH:
                yield out()
    if held:
        yield out()


def shape(distinct: int) -> tuple[int, int]:
    """Classes and words in each for so many distinct words."""
    side = math.ceil(GROWTH * distinct**0.25)
    return (side, side) if side * side > WORDS else (CLASSES, IN_CLASS)


def vocabulary(docs: DataFrame, out: str) -> tuple[DataFrame, dict[str, int], int, int]:
    """All words with their counts, the ids of the frequent ones by rank (ties by the word), and the shape. RARE is alone in the
    first class, so that rare words need one softmax only.

    The words are those from the least count at which they fit; the counts of counts tell it, so nothing is sorted whole.
    """
    sums = docs.select(text_of().alias("text")).mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    sums = written(sums, f"{out}/words")
    times = sorted((r["n"], r["k"]) for r in sums.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect())
    classes, in_class = shape(sum(k for _, k in times))
    room, least = (classes - 1) * in_class, None
    while times and times[-1][1] <= room:
        least, k = times.pop()
        room -= k
    top = [] if least is None else sums.where(F.col("n") >= least).collect()
    known = {r["word"]: i for i, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["word"])), in_class)}
    return sums, known, classes, in_class


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each character of the words and their ends (a line feed, which no word has) after the two before it, 21 bits each;
    and the place of its word."""
    text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    a, b, c = np.concatenate([[10], text[:-2]]), text[:-1], text[1:]
    return np.where(b == 10, 10, a) << 42 | b << 21 | c, np.cumsum(b == 10) - 1


def _trigrams(known: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in known]
            if rare:
                keys, of = _spelled([w for w, _ in rare])
                keys, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, np.array([n for _, n in rare], float)[of])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    return run


class Spelling:
    """The probability of a rare word by its characters: trigrams, interpolated with bigrams, single ones and any other."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        low = (1 << 21) - 1
        self.levels = []  # for each length of context: sorted keys and their counts, sorted contexts and theirs
        for bits in (0, 21, 42):
            part = keys[order] & ((1 << (bits + 21)) - 1)
            own, at = np.unique(part, return_inverse=True)
            before, over = np.unique(part >> 21, return_inverse=True)
            self.levels.append((own, np.bincount(at, n[order], len(own)), before, np.bincount(over, n[order], len(before))))
        self.base = 1.0 / (low + 1)
        self.keys = keys[order]
        self.log_p = np.log(self._p(self.keys)) if len(keys) else np.zeros(0)
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int64)  # the place of a key by its hash; of those with equal hashes, one
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands among those that were counted, if it is there."""
        at = self.slots[self._slot(keys)]
        other = np.nonzero(self.keys[at] != keys)[0]
        at[other] = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
        return at

    @staticmethod
    def _find(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, n[at], 0.0)

    def _p(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), self.base)
        for bits, (own, n, before, m) in zip((0, 21, 42), self.levels, strict=True):
            part = keys & ((1 << (bits + 21)) - 1)
            p = (self._find(own, n, part) + BACK * p) / (self._find(before, m, part >> 21) + BACK)
        return p

    def each(self, words: list[str]) -> np.ndarray:
        """The log probability of each word with its end."""
        keys, of = _spelled(words)
        log = np.empty(len(keys))
        at = self._place(keys) if len(self.keys) else np.zeros(len(keys), np.int64)
        seen = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        log[seen] = self.log_p[at[seen]]
        log[~seen] = np.log(self._p(keys[~seen]))
        return np.bincount(of, log, len(words))

    def log_probability(self, words: list[str]) -> float:
        """Of all the words together, with their ends."""
        return float(self.each(words).sum())


class Room:
    """Arrays that step after step fills anew: fresh ones of this size would cost a fault for each of their pages."""

    def __init__(self):
        self._held: dict[str, np.ndarray] = {}

    def of(self, name: str, rows: int, width: int) -> np.ndarray:
        """The array of that name, with whatever is in it."""
        if name not in self._held or self._held[name].size < rows * width:
            self._held[name] = np.empty(rows * width * 9 // 8, np.float32)
        return self._held[name][: rows * width].reshape(rows, width)


class Network:
    """emb, place (a weight per side position), bias, classes, class bias, words and word bias.

    Texts come as lanes of ids: a stream with SIDE ids of the edge between texts, cut into rows as long as the distance between two
    places that are predicted, which stand first in their rows. So each id is looked up once, the sums over the sides are additions
    of shifted lanes, and nothing is summed for places that are not predicted.
    """

    def __init__(self, seed: int = 0, classes: int = CLASSES, in_class: int = IN_CLASS):
        draw = np.random.default_rng(seed)
        f = np.float32
        self.classes, self.in_class, self.room = classes, in_class, Room()
        #: The layers of the classes and of the words by columns, each with its bias in the last row.
        self.top, self.low = np.zeros((WIDTH + 1, classes), f), np.zeros((WIDTH + 1, classes * in_class), f)
        self.p = [
            draw.normal(0, 0.1, (in_class * (classes + ENDINGS) + 1, WIDTH)).astype(f),  # words, endings, beyond the ends of a text
            np.ones((len(_OFFSETS), WIDTH), f),
            np.zeros(WIDTH, f),
            *(x for layer in (self.top, self.low) for x in (layer[:-1].T, layer[-1])),
        ]

    def __reduce__(self):
        return _network, (self.classes, self.in_class, self.flat())

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for x in self.p:
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def _hidden(self, lanes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """The embeddings of each lane, the part of them at each side position, the hidden layer at the rows, and the same with a 1
        for the bias of what follows."""
        rows, step = lanes.shape
        emb = self.room.of("emb", step * rows, WIDTH)
        self.p[0].take(lanes.T.ravel(), axis=0, out=emb, mode="clip")
        emb = emb.reshape(step, rows, WIDTH)
        sides = [emb[place] for place in _sides(rows, step)]
        sums, part = (self.room.of(x, len(sides[0]), WIDTH) for x in ("sums", "part"))
        np.multiply(sides[0], self.p[1][0], out=sums)
        for side, weight in zip(sides[1:], self.p[1][1:], strict=True):
            np.multiply(side, weight, out=part)
            sums += part
        if len(at) < len(sums):
            sums = sums.take(at - _before(step), axis=0, out=part[: len(at)], mode="clip")
        sums += self.p[2]
        h = self.room.of("h", len(at), WIDTH + 1)
        h[:, :-1] = np.tanh(sums, out=sums)
        h[:, -1] = 1
        return emb, sides, sums, h

    def _of_classes(self, h: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], None]]:
        """Room for the logits of the classes, and what fills it."""
        return self.room.of("classes", len(h), self.classes), lambda z: np.matmul(h, self.top, out=z)

    def _of_words(self, h: np.ndarray, cuts: list[tuple[int, int, int]]) -> tuple[np.ndarray, Callable[[np.ndarray], None]]:
        """The same for the words in their classes, for rows by class."""

        def fill(z: np.ndarray) -> None:
            for c, a, b in cuts:
                np.matmul(h[a:b], self.low[:, c * self.in_class : (c + 1) * self.in_class], out=z[a:b])

        return self.room.of("words", len(h), self.in_class), fill

    def _sorted(self, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """An order by class of the rows that are not rare, the bounds of each class in it, and these rows. A rare word is alone
        in its class."""
        order, cuts = _by_class(cls)
        if cuts and cuts[0][0] == RARE:
            rare = cuts[0][2]
            order, cuts = order[rare:], [(c, a - rare, b - rare) for c, a, b in cuts[1:]]
        return order, cuts, h.take(order, axis=0, out=self.room.of("sorted", len(order), WIDTH + 1), mode="clip")

    def stream_log_probability(self, lanes: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of the words at the first places of some rows, each given the ids on both its sides."""
        h = self._hidden(lanes, at)[-1]
        cls, of = np.divmod(word, self.in_class)
        out = _log_share(*self._of_classes(h), cls)
        order, cuts, h = self._sorted(h, cls)
        out[order] += _log_share(*self._of_words(h, cuts), of[order])
        return out

    def stream_step(self, lanes: np.ndarray, at: np.ndarray, word: np.ndarray, state: list[np.ndarray]) -> None:
        """One Adagrad step on the words at the first places of some rows."""
        rows, step = lanes.shape
        emb, sides, own, h = self._hidden(lanes, at)
        scale = np.float32(1 / len(word))
        cls, of = np.divmod(word, self.in_class)
        z = _share_error(*self._of_classes(h), cls, scale)
        back = np.matmul(z, self.top[:-1].T, out=self.room.of("back", len(h), WIDTH))
        top, low = h.T @ z, self.room.of("low", *self.low.shape)
        order, cuts, sorted_h = self._sorted(h, cls)
        z = _share_error(*self._of_words(sorted_h, cuts), of[order], scale)
        low.fill(0)
        more = self.room.of("more", len(order), WIDTH)
        for c, a, b in cuts:
            part = slice(c * self.in_class, (c + 1) * self.in_class)
            np.matmul(sorted_h[a:b].T, z[a:b], out=low[:, part])
            np.matmul(z[a:b], self.low[:-1, part].T, out=more[a:b])
        back[order] += more
        slope = np.multiply(own, own, out=own)
        back *= np.subtract(1, slope, out=slope)
        spread = back
        if len(at) < len(sides[0]):
            spread = self.room.of("spread", len(sides[0]), WIDTH)
            spread.fill(0)
            spread[at - _before(step)] = back
        each, part, place = self.room.of("each", step * rows, WIDTH), self.room.of("part", len(spread), WIDTH), np.empty_like(self.p[1])
        each.fill(0)
        lane = each.reshape(step, rows, WIDTH)
        for k, (side, own) in enumerate(zip(sides, _sides(rows, step), strict=True)):
            lane[own] += np.multiply(spread, self.p[1][k], out=part)
            place[k] = np.einsum("nw,nw->w", side, spread)
        ids = lanes.T.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(self.p[0]) <= 1 << 16 else ids, kind="stable")
        ranked = ids[order]
        first = np.nonzero(np.diff(ranked, prepend=-1))[0]
        touched, sums = ranked[first], np.add.reduceat(each.take(order, axis=0, out=emb.reshape(each.shape), mode="clip"), first, axis=0)
        seen = state[0].take(touched, axis=0)
        seen += sums * sums
        state[0][touched] = seen
        self.p[0][touched] = self.p[0].take(touched, axis=0) - _moved(sums, seen, DAMP, np.empty_like(sums))
        for p, grad, seen in zip(self.p[1:], (place, back.sum(axis=0), top[:-1].T, top[-1], low[:-1].T, low[-1]), state[1:], strict=True):
            p, grad, seen = p.T, grad.T, seen.T  # the large ones lie by columns
            x = self.room.of("move", 1, p.size).reshape(p.shape)
            seen += np.multiply(grad, grad, out=x)
            p -= _moved(grad, seen, 1e-4, x)

    def _windows(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single contexts as lanes of their own, and the rows in their middle."""
        stream = np.insert(context, SIDE, len(self.p[0]) - 1, axis=1)
        return stream.reshape(-1, 1), np.arange(len(context)) * stream.shape[1] + SIDE

    def log_probability(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of each word given its context, a row of ids."""
        return self.stream_log_probability(*self._windows(context), word)

    def step(self, context: np.ndarray, word: np.ndarray, state: list[np.ndarray]) -> None:
        """One Adagrad step on words and their contexts."""
        self.stream_step(*self._windows(context), word, state)


def _moved(grad: np.ndarray, seen: np.ndarray, damp: float, out: np.ndarray) -> np.ndarray:
    """By how much Adagrad moves weights whose squared gradients have added up to `seen`."""
    np.sqrt(seen, out=out)
    out += np.float32(damp)
    np.divide(grad, out, out=out)
    out *= np.float32(RATE)
    return out


def _network(classes: int, in_class: int, flat: np.ndarray) -> Network:
    return Network(0, classes, in_class).load(flat)


def _before(step: int) -> int:
    """Rows of lanes before the first that is predicted."""
    return -(-SIDE // step)


def _sides(rows: int, step: int) -> list[tuple[int, slice]]:
    """For each side position its lane, and the rows there beside all rows that may be predicted."""
    first, last = _before(step), rows - SIDE // step
    return [(off % step, slice(first + off // step, last + off // step)) for off in _OFFSETS]


def _exp(z: np.ndarray, fill: Callable[[np.ndarray], None]) -> tuple[np.ndarray, np.ndarray | None]:
    """exp of the logits z, in their place, and its sums by row; less the row's largest value, which follows, where plain values
    could leave the range."""
    ones = np.ones(z.shape[1], z.dtype)
    with np.errstate(over="ignore"):
        sums = np.exp(z, out=z) @ ones
    if not len(sums) or (sums.min() > 1e-26 and sums.max() < 1e26):
        return sums, None
    fill(z)
    most = z.max(axis=1)
    z -= most[:, None]
    return np.exp(z, out=z) @ ones, most


def _log_share(z: np.ndarray, fill: Callable[[np.ndarray], None], of: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row of logits at one place; z is room for the logits."""
    fill(z)
    out = z[np.arange(len(of)), of]
    sums, most = _exp(z, fill)
    out -= np.log(sums)
    return out if most is None else out - most


def _share_error(z: np.ndarray, fill: Callable[[np.ndarray], None], of: np.ndarray, scale: np.float32) -> np.ndarray:
    """The gradient of the scaled loss at the logits, in their place."""
    fill(z)
    z *= (scale / _exp(z, fill)[0])[:, None]
    z[np.arange(len(of)), of] -= scale
    return z


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and each class with the bounds of its run in it."""
    order = np.argsort(cls.astype(np.uint16) if cls.max(initial=0) < 1 << 16 else cls, kind="stable")
    ranked = cls[order]
    first = np.nonzero(np.diff(ranked, prepend=-1))[0]
    return order, list(zip(ranked[first].tolist(), first.tolist(), [*first[1:].tolist(), len(cls)], strict=True))


class Words:
    """Words as ids under one vocabulary, from `words` on by the ending of a rare one, and how rare words are spelled."""

    def __init__(self, known: dict[str, int], spelling: Spelling, classes: int = CLASSES, in_class: int = IN_CLASS):
        self.known, self.spelling = known, spelling
        self.words, self.endings = classes * in_class, ENDINGS * in_class
        self.edge = self.words + self.endings
        self._names, self._ids = pa.array(list(known), pa.string()), np.array(list(known.values()), np.int64)

    def _rare(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rare words and the log probability of their spelling."""
        ends = pc.utf8_slice_codeunits(names, -3).dictionary_encode()
        own = [self.words + zlib.crc32(e.encode("utf-8", "surrogatepass")) % self.endings for e in ends.dictionary.to_pylist()]
        return np.array(own, np.int64)[ends.indices.to_numpy()], self.spelling.each(names.to_numpy(zero_copy_only=False).tolist())

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts' words in a row; for each text, how many, and the log probability of its rare words' spelling.
        Each distinct word of these texts is looked up or spelled once."""
        words, of = _split(texts)
        words = words.dictionary_encode()
        found = pc.index_in(words.dictionary, value_set=self._names)
        rare = found.is_null()
        ids, log, is_rare = np.empty(len(found), np.int64), np.zeros(len(found)), rare.to_numpy(zero_copy_only=False)
        ids[~is_rare] = self._ids[found.drop_null().to_numpy()]
        if is_rare.any():
            ids[is_rare], log[is_rare] = self._rare(words.dictionary.filter(rare))
        codes = words.indices.to_numpy()
        return ids[codes], np.bincount(of, minlength=len(texts)), np.bincount(of, log[codes], len(texts))


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to at most `most`; a larger row stands by itself."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


def _encode(words: Words, kind: str):
    names = [c.split()[0] for c in kind.split(", ")]
    dtype = np.uint16 if words.edge < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in _groups(pc.utf8_length(texts).to_pylist(), CHARACTERS):
                ids, n, spelled = words.ids(texts.slice(a, b - a))
                data = ids.astype(dtype).tobytes()
                ends = (np.cumsum(n) * dtype().itemsize).tolist()
                own = [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(spelled), pa.array(own, pa.binary())], names=names)

    return run


class Streams:
    """Rows of encoded texts as lanes with the edge around each text."""

    def __init__(self, edge: int):
        self.edge, self.dtype = edge, np.uint16 if edge < 1 << 16 else np.uint32

    def of(self, batch: pa.RecordBatch, number: int = 0, step: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some rows at a time: the lanes, the place of each text's first word in their stream, and the lengths. Of each text
        the words number, number + step, ... stand first in the rows of the lanes."""
        rows = batch.column("ids").to_pylist()
        for a, b in _groups([len(r) for r in rows], 16 * PIECE * self.dtype().itemsize):
            ids = np.frombuffer(b"".join(rows[a:b]), self.dtype)
            n = np.array([len(r) for r in rows[a:b]], np.int64) // self.dtype().itemsize
            room = -(-(n + SIDE) // step) * step
            start = np.cumsum(room) - room + SIDE + (-SIDE - number) % step
            stream = np.full(-(-int(start[-1] + n[-1] + SIDE) // step) * step, self.edge, np.int64)
            stream[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
            yield stream.reshape(-1, step), start, n


def _word_at(lanes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """The targets at the first places of the rows: any rare word is RARE."""
    ids = lanes[at, 0]
    return np.where(ids < words, ids, RARE)


def targets(length: int, number: int, rounds: int) -> np.ndarray:
    """The positions that a round trains on: each position belongs to one of the rounds."""
    return np.arange(number, length, rounds)


def _train(streams: Streams, words: int, shape: tuple[int, int], start: np.ndarray, number: int, rounds: int):
    """Train on the round's positions of all documents of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net, seen = Network(0, *shape).load(start), 0
        state = [np.zeros_like(x) for x in net.p]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def learn(least: int) -> None:
            """Step by step over what is held, until fewer than `least` places are left."""
            lanes = np.concatenate([s for s, _ in held])
            base = np.cumsum([0] + [len(s) for s, _ in held])[:-1]
            at = np.concatenate([x + k for (_, x), k in zip(held, base, strict=True)])
            done = 0
            while len(at) - done >= least and done < len(at):
                own = at[done : done + BATCH]
                low = own[0] - _before(rounds)
                part = lanes[low : own[-1] + SIDE // rounds + 1]
                net.stream_step(part, own - low, _word_at(part, own - low, words), state)
                done += len(own)
            held.clear()
            if done < len(at):
                low = at[done] - _before(rounds)
                held.append((lanes[low:], at[done:] - low))

        for batch in batches:
            for lanes, first, n in streams.of(batch, number, rounds):
                at = np.concatenate([f + targets(k, number, rounds) for f, k in zip(first.tolist(), n.tolist(), strict=True)]) // rounds
                if len(at):
                    held.append((lanes, at))
                    seen += len(at)
                    if sum(len(x) for _, x in held) >= BATCH:
                        learn(BATCH)
        if held:
            learn(1)
        if seen:
            flat, task = net.flat(), TaskContext.get().partitionId()
            for k, a in enumerate(range(0, len(flat), SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat[a : a + SLICE].tobytes()], pa.binary())], names=["slice", "task", "n", "weights"])

    return run


def _average(group: pa.Table) -> pa.Table:
    """The mean of one slice of some blocks' weights, in the order of the blocks."""
    total, n = 0.0, 0
    group = group.sort_by("task")
    for k, w in zip(group.column("n").to_pylist(), group.column("weights"), strict=True):
        total, n = total + k * np.frombuffer(w.as_buffer(), np.float32).astype(np.float64), n + k
    first = [pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("slice", "node")]
    return pa.table([*first, pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["slice", "task", "n", "weights"])


def _mean_weights(parts: DataFrame, blocks: int) -> np.ndarray | None:
    """The weights averaged over the blocks by a tree of means of at most FAN each."""
    while blocks > 1:
        grouped = parts.withColumn("node", F.expr(f"task div {FAN}").cast("int")).groupBy("slice", "node")
        parts, blocks = grouped.applyInArrow(_average, "slice int, task int, n bigint, weights binary"), -(-blocks // FAN)
    means = sorted(parts.select("slice", "weights").collect(), key=lambda r: r["slice"])
    return np.concatenate([np.frombuffer(r["weights"], np.float32) for r in means]) if means else None


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Words, Network]:
    """The encoded documents (doc_id, n, spelled, ids), their words with the spelling of rare ones, and the network, learned from all.

    Documents are dealt to blocks by a hash of their id and ids, so the result depends on the documents only and not on how
    they lie in files or partitions. The number of blocks follows from the number of words.
    """
    out = workdir(docs.sparkSession, "lm-score")
    sums, known, *shape = vocabulary(docs, out)
    spelled = sums.mapInArrow(_trigrams(known), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    words, net = Words(known, Spelling(spelled.column("key").to_numpy(), spelled.column("n").to_numpy()), *shape), Network(0, *shape)
    rows = docs.select("doc_id", text_of().alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, spelled double, ids binary"
    encoded = written(rows.mapInArrow(_encode(words, kind), kind), f"{out}/encoded")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / max(BLOCK, 8 * len(net.flat()))))
    dealt = encoded.where("n > 0").select("doc_id", "ids", F.xxhash64("doc_id", "ids").alias("key")).repartition(blocks, "key").sortWithinPartitions("key", "ids").select("ids")
    for k in range(rounds):
        parts = dealt.mapInArrow(_train(Streams(words.edge), words.words, shape, net.flat(), k, rounds), "slice int, task int, n bigint, weights binary")
        parts = written(parts, f"{out}/round{k}")
        tasks = parts.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] + 1
        means = _mean_weights(parts, tasks)
        if means is not None:
            net.load(means)
    return encoded, words, net


def _score(streams: Streams, words: int, net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.zeros(0)]
            for lanes, first, n in streams.of(batch):
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                log = np.zeros(len(at))
                for a in range(0, len(at), PIECE):
                    own = at[a : a + PIECE]
                    low = own[0] - SIDE
                    part = lanes[low : own[-1] + SIDE + 1]
                    log[a : a + PIECE] = net.stream_log_probability(part, own - low, _word_at(part, own - low, words))
                sums.append(np.bincount(np.repeat(np.arange(len(n)), n), log, len(n)))
            total = np.concatenate(sums) + batch.column("spelled").to_numpy()
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(total), pa.array(total / np.maximum(n, 1))], names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return run


def lm_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood (summed) and mean_log_likelihood for each row of docs (doc_id, text)."""
    encoded, words, net = fit(docs, rounds)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(_score(Streams(words.edge), words.words, net), f"doc_id {kind}, n_words bigint, log_likelihood double, mean_log_likelihood double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
