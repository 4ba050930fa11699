"""SentencePiece encoding and decoding with a streaming Viterbi pass over a public BPE model.

For each prefix of a text exactly one piece can end its encoding: the one that leaves a prefix whose own last piece does not
merge with it. So the best path is a chain of backpointers, filled in from left to right: an Aho-Corasick automaton over the
pieces reads each character once and tells which pieces end there, and the longest that fits the piece before it is taken.
Only positions within the automaton's match can still start a piece, and whenever the paths of all of them meet in one boundary,
the ids before it are committed and dropped from the window. White space, and characters outside the vocabulary, are such
boundaries by themselves, which lets the work between two of them be remembered (in a bounded table). The short stretches of
many texts that are not in that table take this pass side by side, one position of all of them at a time, in arrays.

The ids are those of the model's own byte-fallback BPE: a space in front of a text that is not empty, U+2581 for spaces,
bytes for characters outside the vocabulary. Decoding is exact for every text without U+2581, which reads as a space.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole;
repeated rows give equal ids; paths that tie cannot be, as each prefix has one last piece; an empty table gives an empty
result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches that the table of them is emptied at, and characters in one of them; positions between looks for a common boundary, at least.
REMEMBERED, STRETCH, LOOK = 200_000, 64, 64
#: Ids in one output batch, about; characters whose stretches are looked up together, about; stretches that go side by side at most.
BATCH_IDS, TOGETHER, LANES = 1_000_000, 1_000_000, 16_384
#: Places in a table of answers, as a power of two.
PLACES = 18


class Answers:
    """A function of arrays of whole numbers (not negative, and with answers below 1 << width), answers remembered in a table of fixed size.

    A number has one place in it, where the latest number stays."""

    def __init__(self, answer: Callable[[np.ndarray], np.ndarray], width: int):
        self._answer, self._width = answer, width
        self._table = np.full(1 << PLACES, -1, np.int64)

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        held = self._table[self._place(keys)]
        other = np.flatnonzero(held >> self._width != keys)
        if len(other):
            asked = keys[other]
            fresh = np.unique(asked)
            packed = fresh << self._width | self._answer(fresh)
            self._table[self._place(fresh)] = packed
            held[other] = packed[np.searchsorted(fresh, asked)]
        return held & ((1 << self._width) - 1)


def _found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in sorted keys, and whether it does."""
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


class Codec:
    """Encoder and decoder for the pieces of a model: (piece, score, kind) with kind 0 plain, 1 byte, 2 other."""

    def __init__(self, pieces: list[tuple[str, float, int]], tables: dict[str, np.ndarray] | None = None):
        self.pieces = pieces
        self._ready = False
        self._tables = tables

    def __reduce__(self):
        self._prepare()
        return Codec, (self.pieces, self._tables)

    @staticmethod
    def load(path: str = MODEL) -> Codec:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: 1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0
        return Codec([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.vocab_size())])

    def _prepare(self) -> None:
        if self._ready:
            return
        self._count = max(2, len(self.pieces))
        if self._tables is None:
            self._tables = self._built()
        own = self._tables
        self._class = np.zeros(0x110000, np.int32)
        self._class[own["letters"]] = np.arange(1, len(own["letters"]) + 1)
        self._classes = len(own["letters"]) + 1
        byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == 1}
        self._byte = [byte.get(b, 0) for b in range(256)]
        self._raw = [bytes([int(p[3:5], 16)]) if k == 1 else p.replace(MARK, " ").encode() if k == 0 else b"" for p, _, k in self.pieces]
        self._next = Answers(self._step, int(len(own["depth"])).bit_length())
        self._fit = Answers(self._fitting, 1)
        self._fits: dict[int, bool] = {}
        # Ids of stretches, with and without a mark in front, and of runs of marks, as the bytes of 32-bit numbers.
        self._spaced: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}
        cuts = own["run_cuts"].tolist()
        self._runs = [own["runs"][a:b].tobytes() for a, b in zip([0, *cuts], cuts)]
        self._reach = len(self._runs) - 1
        single = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == 0 and len(p) == 1}
        self._lone = np.int32(single.get(MARK, -1)).tobytes()
        self._newline = None if "\n" in single else np.int32(self._byte[10]).tobytes()
        self._ready = True

    def _built(self) -> dict[str, np.ndarray]:
        """The tables that passes read. By piece: rank of its last merge (-1: a character), its halves, its length. Which pairs of
        pieces are a piece, and its rank. By state of the automaton, a start of some piece: its steps to longer ones by letter, the
        state of the longest proper suffix that is one too, its length, its piece, and the longest suffix, itself included, that is a
        piece (0: none)."""
        plain = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == 0}
        self._score = {p: s for p, s, k in self.pieces if k == 0}
        reach = max(map(len, plain))
        # The last merge of each piece; pieces that merges cannot make get none and are never used.
        halves = {}
        for p, i in plain.items():
            if len(p) > 1 and len(parts := self._merged(p, 2)) == 2 and self._merged(p) == [p]:
                halves[i] = plain[parts[0]], plain[parts[1]]
        ids = {p: i for p, i in plain.items() if len(p) == 1 or i in halves}
        place = {v: k for k, v in enumerate(sorted({-self._score[p] for p in ids}))}
        rank, left, right = (np.full(self._count, v, np.int64) for v in (-1, 0, 0))
        for p, i in ids.items():
            if len(p) > 1:
                rank[i], (left[i], right[i]) = place[-self._score[p]], halves[i]
        pairs = sorted((ids[p[:k]] * self._count + ids[p[k:]], int(rank[i])) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        letters = {ch: k for k, ch in enumerate(sorted({ch for p in ids for ch in p}), 1)}
        steps: list[dict[int, int]] = [{}]
        depth, piece, shorter = [0], [-1], [0]
        for p, i in ids.items():
            at = 0
            for ch in p:
                to = steps[at].setdefault(letters[ch], len(steps))
                if to == len(steps):
                    steps.append({})
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                    shorter.append(0)
                at = to
            piece[at] = i
        ending = [0] * len(steps)
        level = [0]
        while level:
            after = []
            for at in level:
                for ch, to in steps[at].items():
                    back = shorter[at]
                    while back and ch not in steps[back]:
                        back = shorter[back]
                    shorter[to] = steps[back].get(ch, 0) if at else 0
                    ending[to] = to if piece[to] >= 0 else ending[shorter[to]]
                    after.append(to)
            level = after
        moves = sorted((at * (len(letters) + 1) + ch, to) for at, own in enumerate(steps) for ch, to in own.items())
        runs = [[ids[p] for p in self._merged(MARK * k)] if MARK in ids else [] for k in range(reach + 1)]
        arrays = {"rank": rank, "left": left, "right": right, "long": [len(p) for p, _, _ in self.pieces] + [0] * (self._count - len(self.pieces))}
        arrays |= {"pair": [k for k, _ in pairs] or [-1], "joint": [r for _, r in pairs] or [0], "letters": [ord(ch) for ch in letters]}
        arrays |= {"move": [k for k, _ in moves], "to": [t for _, t in moves], "shorter": shorter, "depth": depth, "piece": piece, "ending": ending}
        arrays["run_cuts"] = np.cumsum([len(r) for r in runs])
        return {k: np.asarray(v, np.int64) for k, v in arrays.items()} | {"runs": np.array([i for r in runs for i in r], np.int32)}

    def _merged(self, text: str, least: int = 1) -> list[str]:
        """The merges, by definition: the best pair first, the leftmost of equals, until `least` parts are left."""
        parts = list(text)
        while len(parts) > least:
            best = max(range(len(parts) - 1), key=lambda i: (self._score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self._score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The state after each state * classes + letter."""
        own, out, lane = self._tables, np.zeros(len(keys), np.int64), np.arange(len(keys))
        state, letter = np.divmod(keys, self._classes)
        while len(lane):
            at, there = _found(own["move"], state * self._classes + letter)
            out[lane[there]] = own["to"][at[there]]
            on = ~there & (state > 0)
            lane, state, letter = lane[on], own["shorter"][state[on]], letter[on]
        return out

    def _fitting(self, keys: np.ndarray) -> np.ndarray:
        """Whether a stays apart from b where b follows a, for each a * pieces + b.

        The merges that made both are undone from the last to the first. Wherever the parts that then meet could merge
        earlier than the merge just undone (or, right of the seam, no later than it: the leftmost goes first), they would have.
        """
        own, out, lane = self._tables, np.ones(len(keys), np.int64), np.arange(len(keys))
        a, b = np.divmod(keys, self._count)
        before_a = before_b = np.full(len(keys), 1 << 60)
        while len(lane):
            at, joins = _found(own["pair"], a * self._count + b)
            joint = own["joint"][at]
            joins &= (joint < before_a) & (joint <= before_b)
            out[lane[joins]] = 0
            ra, rb = own["rank"][a], own["rank"][b]
            on = ~joins & ((ra >= 0) | (rb >= 0))
            lane, a, b, ra, rb, before_a, before_b = (x[on] for x in (lane, a, b, ra, rb, before_a, before_b))
            first = ra > rb
            before_a, before_b = np.where(first, ra, before_a), np.where(first, before_b, rb)
            a, b = np.where(first, own["right"][a], a), np.where(first, b, own["left"][b])
        return out

    def _side_by_side(self, texts: list[str]) -> list[bytes]:
        """The ids of short stretches without inner boundaries, one position of all of them at a time."""
        own, n = self._tables, len(texts)
        long = np.fromiter(map(len, texts), np.int64, n)
        starts = np.cumsum(long) - long
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letters = self._class[codes]
        order = np.argsort(-long, kind="stable")
        long, starts = long[order], starts[order]
        last = np.empty((int(long[0]) + 1, n), np.int32)  # the piece that ends the encoding of each prefix; -1 - code outside the vocabulary
        last[0] = -1
        state = np.zeros(n, np.int64)
        for i in range(1, int(long[0]) + 1):
            k = int(np.searchsorted(-long, -i, "right"))
            at = starts[:k] + (i - 1)
            state = self._next(state[:k] * self._classes + letters[at])
            row = last[i]
            row[:k] = -1 - codes[at]
            found = own["ending"][state]
            lane = np.flatnonzero(found)
            found = found[lane]
            while len(lane):
                before, piece = last[i - own["depth"][found], lane], own["piece"][found]
                fits = before < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self._fit(before[inner].astype(np.int64) * self._count + piece[inner]) == 1
                row[lane[fits]] = piece[fits]
                lane, found = lane[~fits], own["ending"][own["shorter"][found[~fits]]]
                lane, found = lane[found > 0], found[found > 0]
        # Back along the paths.
        lane, end, counts, steps = np.arange(n), long.copy(), np.zeros(n, np.int64), []
        while len(lane):
            piece = last[end, lane]
            steps.append((lane, piece))
            counts[lane] += 1
            end = end - np.where(piece < 0, 1, own["long"][piece])
            lane, end = lane[end > 0], end[end > 0]
        sizes = np.empty(n, np.int64)
        sizes[order] = counts
        ends = np.cumsum(sizes)
        ids = np.empty(int(ends[-1]), np.int32)
        ends_of = ends[order]
        for k, (lane, piece) in enumerate(steps, 1):
            ids[ends_of[lane] - k] = piece
        whole, cuts = ids.tobytes(), (4 * ends).tolist()
        out = [whole[a:b] for a, b in zip([0, *cuts], cuts)]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist():
            out[k] = self._emit(np.frombuffer(out[k], np.int32).tolist())
        return out

    @cached_property
    def _plain(self) -> tuple[dict, dict, dict, dict[str, list]]:
        """Moves, ranks of pairs and letters as dictionaries and the other tables as lists, for the pass over one long stretch."""
        own = self._tables
        moves, pairs = (dict(zip(own[k].tolist(), own[v].tolist())) for k, v in (("move", "to"), ("pair", "joint")))
        letters = {chr(c): k for k, c in enumerate(own["letters"].tolist(), 1)}
        return moves, pairs, letters, {k: v.tolist() for k, v in own.items()}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a stays apart from b where b follows a: _fitting for one pair."""
        _, pairs, _, own = self._plain
        rank, left, right = own["rank"], own["left"], own["right"]
        before_a = before_b = 1 << 60
        while True:
            joint = pairs.get(a * self._count + b)
            if joint is not None and joint < before_a and joint <= before_b:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before_a, a = ra, right[a]
            else:
                before_b, b = rb, left[b]

    def _viterbi(self, text: str) -> Iterator[int]:
        """The ids of a stretch without inner boundaries, committed as soon as all surviving paths agree on them.

        Characters outside the vocabulary go by -1 - code.
        """
        moves, _, letters, own = self._plain
        shorter, depth, pieces, ending, classes = own["shorter"], own["depth"], own["piece"], own["ending"], self._classes
        fits, state, look = self._fits, 0, LOOK
        last = [-1]  # the piece that ends the encoding of each prefix, from the one on that is committed
        for i, ch in enumerate(text, 1):
            letter = letters.get(ch, 0)
            to = moves.get(state * classes + letter)
            while to is None and state:
                state = shorter[state]
                to = moves.get(state * classes + letter)
            state = to or 0
            found = ending[state]
            while found:
                piece, before = pieces[found], last[-depth[found]]
                if before < 0:
                    break
                pair = before << 20 | piece
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) > REMEMBERED:
                        fits.clear()
                    fit = fits[pair] = self._compatible(before, piece)
                if fit:
                    break
                found = ending[shorter[found]]
            else:
                piece = -1 - ord(ch)
            last.append(piece)
            if i == look:
                # Later pieces start at one of the positions that the state covers.
                end = len(last) - 1
                paths = set(range(end - depth[state], end + 1))
                while len(paths) > 1:
                    at = max(paths)
                    paths.remove(at)
                    paths.add(at - (1 if last[at] < 0 else own["long"][last[at]]))
                to = paths.pop()
                yield from self._path(last, to)
                del last[:to]
                look = i + max(LOOK, len(last))
        yield from self._path(last, len(last) - 1)

    def _path(self, last: list[int], end: int) -> list[int]:
        out, long = [], self._plain[3]["long"]
        while end > 0:
            piece = last[end]
            out.append(piece)
            end -= 1 if piece < 0 else long[piece]
        return out[::-1]

    def _emit(self, found: Iterable[int]) -> bytes:
        out: list[int] = []
        for i in found:
            if i < 0:
                out += [self._byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return np.array(out, np.int32).tobytes()

    def _learn(self, known: dict[str, bytes], words: set[str], mark: str) -> None:
        """Enter the short ones of words into the table."""
        new = words.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = words
        new = [w for w in new if 0 < len(w) <= STRETCH]
        for at in range(0, len(new), LANES):
            part = new[at : at + LANES]
            known.update(zip(part, self._side_by_side([mark + w for w in part])))

    def _run(self, n: int) -> bytes:
        """The ids of n marks in a row that no word takes."""
        longest = self._reach
        return self._runs[longest] * (n // longest) + self._runs[n % longest]

    def _joined(self, lines: list[list[str]]) -> bytes:
        """The ids of lines of words, the short ones of which are in the tables."""
        spaced, bare, lone = self._spaced, self._bare, self._lone
        ids: list[bytes] = []
        for number, words in enumerate(lines):
            if number:
                ids.append(self._newline)
            if first := words[0]:
                ids.append(bare[first] if len(first) <= STRETCH else self._emit(self._viterbi(first)))
            del words[0]
            try:
                ids += [spaced[word] for word in words]
                continue
            except KeyError:  # more than one space in a row, or a long stretch
                waiting = 0  # marks that belong to no word yet
            for word in words:
                if not word:
                    waiting += 1
                    continue
                got = spaced.get(word)
                if got is None:
                    got = self._emit(self._viterbi(MARK + word))
                if waiting:
                    if got[:4] == lone:
                        ids.append(self._run(waiting + 1))
                        got = got[4:]
                    else:
                        ids.append(self._run(waiting))
                    waiting = 0
                ids.append(got)
            if waiting:
                ids.append(self._run(waiting))
        return b"".join(ids)

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """A text with a space in front, cut at first spaces after other characters, which leaves the ids as they are."""
        text, at = " " + text.replace(MARK, " "), 0
        while len(text) - at > TOGETHER:
            cut = text.find(" ", at + TOGETHER)
            while cut > 0 and text[cut - 1] == " ":
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text, in order."""
        self._prepare()
        group: list[tuple[list[list[str]], bool]] = []  # the lines of a part of a text, and whether it is the text's last
        size, begun = 0, []

        def done() -> Iterator[np.ndarray]:
            self._learn(self._bare, {words[0] for lines, _ in group for words in lines}, "")
            self._learn(self._spaced, set().union(*(words[1:] for lines, _ in group for words in lines)), MARK)
            for lines, end in group:
                begun.append(self._joined(lines))
                if end:
                    yield np.frombuffer(b"".join(begun), np.int32)
                    begun.clear()
            group.clear()

        for text in texts:
            parts = list(self._parts(text)) if text else [""]
            for k, part in enumerate(parts, 1):
                group.append(([line.split(" ") for line in (part.split("\n") if self._newline else [part])], k == len(parts)))
                size += len(part)
                if size >= TOGETHER:
                    yield from done()
                    size = 0
        yield from done()

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return next(self.encode_all([text])).tolist()

    def decode(self, ids) -> str:
        self._prepare()
        text = b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_pieces, ids and round_trip (whether decoding gives the text back) for each row of docs."""
    codec = Codec.load(model)
    rows = docs.select(*carry, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, total, cuts, ids, ok = [t or "" for t in batch.column("text").to_pylist()], 0, 0, [0], [], []

            def out(a: int, b: int) -> pa.RecordBatch:
                own = pa.ListArray.from_arrays(pa.array(np.array(cuts, np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                cols = [batch.column(c).slice(a, b - a) for c in carry]
                return pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(cuts).astype(np.int64)), own, pa.array(ok, pa.bool_())], names=[*carry, "n_pieces", "ids", "round_trip"])

            for i, found in enumerate(codec.encode_all(texts)):
                ok.append(codec.decode(found.tolist()) == texts[i])
                ids.append(found)
                total += len(found)
                cuts.append(total)
                if total >= BATCH_IDS:
                    yield out(at, i + 1)
                    at, total, cuts, ids, ok = i + 1, 0, [0], [], []
            if len(cuts) > 1:
                yield out(at, len(texts))

    return rows.mapInArrow(run, f"{kinds}, n_pieces bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with a column text in place of ids."""
    codec = Codec.load(model)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(codec.decode)

    return encoded.withColumn("text", text("ids")).drop("ids")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
