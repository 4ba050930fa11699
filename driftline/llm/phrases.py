"""Collocations: phrases of 2 to 5 words whose words come together more often than by chance, from suffix arrays of word ids.

1. Shards: texts of a task are cut into pieces and words, and become blocks of word numbers of bounded size. The words of a
   block, with their counts, go to ranges by a hash of the word; a range sums them and gives numbers to those that reach
   `least`, which hold for all blocks. The others part phrases from then on, since no phrase with one of them can reach `least`.
2. Levels, m = 2 to 5: each block orders its suffixes by their first m words by prefix doubling; the intervals of the common
   prefixes are its phrases of m words with their counts. A phrase is the number of its first m - 1 words, which must have
   stayed as a phrase, and the number of its last word; its last m - 1 words must have stayed too. Ranges sum these pairs, after
   one sum per block, and give numbers to those that reach `least`; the blocks that hold them get the numbers back.
3. The pairs of a block in a range are one row, sorted, as differences. A phrase has one entry a block, however often it is there,
   and the number of ranges follows that of the words, so that a range fits into a task at every size. (A block has a
   million pairs or so: with more than some ten thousand ranges, beyond a terabyte of text, a row holds few of them, and a
   pair then costs as much as a plain row.) All counts are exact: words are compared as such, phrases by numbers.
4. The few phrases that stay get their words back by joins. Cuts and longer phrases are looked up in the table of these
   phrases; all parts of a phrase that counts often do so themselves.

Defined results: a null text is empty; a null language is `und`; texts without words give nothing; an empty table gives an empty
result. Only A-Z are lower-cased. Repeated rows count as often as they stand there. A long text is cut between pieces, or between
words with four words of context that are not counted again; a word is never cut. Only text and lang are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import corpus_size, discard, lookup, parallelism, release, table, text_of, workdir, written
from .shingles import mix, runs

LONGEST, LEAST, SCALE, FIRST = 5, 100, 1000, 2000
#: Bytes of text in a block, words for each range of pairs, rows of an Arrow batch that goes out.
BLOCK, RANGE, ROWS = 6 << 20, 1_000_000, 20_000
_U = np.uint64
#: The characters between pieces, and those between words of a piece.
_BETWEEN, _BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _BETWEEN, bytes(range(97, 123)) + b"\n" * len(_BETWEEN))
_ZSTD = pa.Codec("zstd", compression_level=3)
#: Stands for the end of a piece among the words, of which none has a full stop.
_BREAK = b"."

#: Kinds of rows: the state of a block, what it has in one range, the numbers that a range gives back to a block, what has stayed
#: in a range, and the words of a language.
STATE, PART, REPLY, STAYED, TOTAL = range(5)
_BINARY = ("tokens", "firsts", "lasts", "counts", "numbers", "ids", "names", "grams", "gram_names", "skip")
_STEP = "kind int, block bigint, bucket int, n bigint, text binary, first bigint, last bigint, number bigint, " + ", ".join(f"{c} binary" for c in _BINARY)
_ARROW = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("text", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("number", pa.int64())]
    + [(c, pa.binary()) for c in _BINARY]
)


def packed(data: bytes) -> bytes:
    """data as it is (after 0) or compressed by zstd (after 1 and its size), whichever is shorter: what is sent between tasks is
    compressed by Spark's shuffle for speed only, and so takes more disk."""
    small = _ZSTD.compress(data, asbytes=True)
    return b"\1" + len(data).to_bytes(4, "little") + small if len(small) + 4 < len(data) else b"\0" + data


def unpacked(data: bytes) -> bytes:
    return _ZSTD.decompress(data[5:], int.from_bytes(data[1:5], "little"), asbytes=True) if data[0] else data[1:]


def planes(x: np.ndarray) -> bytes:
    """Whole numbers, 0 or more, as the number of bytes that the largest takes, all first bytes, all second ones, and so on: most
    numbers are small, so that the later ones compress."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return packed(bytes([width]) + x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unplaned(data: bytes) -> np.ndarray:
    data = unpacked(data)
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<i8")[:, 0]


def parts_of(text: bytes, limit: int = BLOCK, context: int = LONGEST - 1) -> Iterator[tuple[bytes, int]]:
    """Parts of a translated text, and how many words at the end of each are context, which the next part holds too."""
    at = 0
    while len(text) - at > limit:
        end = text.rfind(b"\n", at, at + limit)
        if end > at:
            yield text[at:end], 0
            at = end + 1
            continue
        end = max(text.rfind(b, at, at + limit) for b in (b" ", b"\t"))
        if end <= at:  # one word is longer than the limit
            ends = [e for e in (text.find(b, at + limit) for b in (b" ", b"\t", b"\n")) if e >= 0]
            end = min(ends, default=len(text))
        stop = text.find(b"\n", end)
        more = text[end : stop if stop >= 0 else len(text)].split(None, context)[:context]
        yield text[at:end] + b" " + b" ".join(more), len(more)
        at = end
    yield text[at:], 0


class Block:
    """Word numbers of pieces, 0 between them. names: of each number in the block that in all blocks (of 0, 0); grams: at each
    place the number in the block of the phrase of the level before that starts there, 0 for none; skip: places of context."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, grams: np.ndarray, gram_names: np.ndarray, skip: np.ndarray):
        self.ids, self.names, self.grams, self.gram_names, self.skip = ids, names, grams, gram_names, skip

    @staticmethod
    def read(row: dict) -> Block:
        ids, names, grams, gram_names = (unplaned(row[c]) for c in ("ids", "names", "grams", "gram_names"))
        skip = np.zeros(len(ids), dtype=bool)
        skip[unplaned(row["skip"])] = True
        return Block(ids, names, grams, gram_names, skip) if len(grams) else Block(ids, names, ids, names, skip)

    def row(self, block: int) -> dict:
        """The state; phrases of one word, which are the words, are not written twice."""
        own = self if self.grams is not self.ids else Block(self.ids, self.names, self.ids[:0], self.names[:0], self.skip)
        return {"kind": STATE, "block": block, "skip": planes(np.nonzero(self.skip)[0]), **{c: planes(getattr(own, c)) for c in ("ids", "names", "grams", "gram_names")}}

    def intervals(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of m words both of whose parts of m - 1 words have stayed: first place and count without context of each, all
        places in the order of the phrases, and where each phrase begins there."""
        start = (self.grams > 0) & np.append(self.grams[1:] > 0, False)
        order = suffix_array(self.ids, m)
        order = order[start[order]]
        if not len(order):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        head = np.concatenate([[0], np.nonzero(common_prefixes(self.ids, order, m) < m)[0] + 1])
        return order[head], np.add.reduceat((~self.skip[order]).astype(np.int64), head), order, head

    def pairs(self, m: int, bits: int) -> tuple[np.ndarray, ...]:
        """Of the phrases of m words the range, first part, last word and count, sorted, and all places and where a phrase begins,
        in the same order."""
        at, count, order, head = self.intervals(m)
        first, last = self.gram_names[self.grams[at]], self.names[self.ids[at + m - 1]]
        bucket = ranges(mix(mix(first.astype(np.uint64)) + last.astype(np.uint64)), bits)
        by = np.lexsort((last, first, bucket))
        size = np.diff(np.append(head, len(order)))
        return bucket[by], first[by], last[by], count[by], order, head[by], size[by]

    def narrowed(self, grams: np.ndarray, gram_names: np.ndarray, m: int) -> Block | None:
        """The block of what is covered by the phrases of m words that start where grams is not 0; None if there are none."""
        if not grams.any():
            return None
        cover = np.cumsum((grams > 0).astype(np.int64))
        cover[m:] -= cover[:-m].copy()
        inside = cover > 0
        keep = inside | np.concatenate([[True], inside[:-1]])  # one break after each stretch
        ids, grams, skip = np.where(inside, self.ids, 0)[keep], grams[keep], self.skip[keep]
        pad = np.zeros(LONGEST, np.int64)
        ids, grams, skip = np.concatenate([ids, pad]), np.concatenate([grams, pad]), np.append(skip, pad > 0)
        used, short = np.unique(ids, return_inverse=True)
        kept, own = np.unique(grams, return_inverse=True)
        return Block(short, self.names[used], own, gram_names[kept], skip)


def ranges(key: np.ndarray, bits: int) -> np.ndarray:
    """The range of a hash, of which there are 2**bits."""
    return (key >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def encoded(parts: dict[str, list[tuple[bytes, int]]], bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes, np.ndarray]], dict[str, int]]:
    """Of translated parts of texts by language: the word numbers in the block, the places of context, for each range its words with
    their counts in the order of their numbers, and the number of words of each language.

    A word is its text, a space, and its language, quoted so that no space or line break is in it.
    """
    ids, skip, words, totals, at = [np.zeros(1, np.int64)], [], [], {}, 1
    for lang in sorted(parts):
        tokens: list[bytes] = []
        context = 0
        for text, more in parts[lang]:
            tokens += text.replace(b"\n", b" . ").split()
            skip += range(at + len(tokens) - more, at + len(tokens))
            context += more
            tokens.append(_BREAK)
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        own = coded.dictionary.to_pylist()
        number = np.arange(len(own), dtype=np.int64) + len(words) + 1
        pause = own.index(_BREAK)
        number[pause], number[pause + 1 :] = 0, number[pause + 1 :] - 1
        tail = b" " + quote(lang, safe="", errors="surrogatepass").encode()
        words += [w + tail for w in own[:pause] + own[pause + 1 :]]
        found = number[coded.indices.to_numpy()]
        totals[lang] = int((found > 0).sum()) - context
        ids.append(found)
        at += len(tokens)
    all_ids = np.concatenate([*ids, np.zeros(LONGEST, np.int64)])
    flags = np.zeros(len(all_ids), dtype=bool)
    flags[skip] = True
    if not words:
        return all_ids, flags, [], totals
    # Numbers by range, then by word: the numbers that come back are in this order.
    key = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), np.uint64)
    bucket = ranges(key, bits)
    order = np.array(sorted(range(len(words)), key=lambda i: (bucket[i], words[i])))
    place = np.zeros(len(words) + 1, np.int64)
    place[order + 1] = np.arange(1, len(words) + 1)
    all_ids = place[all_ids]
    count = np.bincount(all_ids[~flags], minlength=len(words) + 1)[1:]
    cut = [(int(bucket[order[a]]), b"\n".join(words[i] for i in order[a:b]), count[a:b]) for a, b in runs(bucket[order])]
    return all_ids, flags, cut, totals


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first `depth` ids or more, by prefix doubling: ranks of h ids make those of 2 h.
    What is behind the end counts as 0, as breaks do."""
    rank, h = ids, 1
    n = len(ids)
    while h < depth:
        far = np.zeros(n, np.int64)
        far[: max(0, n - h)] = rank[h:]
        both = rank * (int(rank.max(initial=0)) + 1) + far
        order = np.argsort(both)
        new = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
    return np.argsort(rank)


def common_prefixes(ids: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Ids that each suffix of the order but the first shares with the one before, up to cap."""
    a, b, last = order[1:], order[:-1], len(ids) - 1
    same, out = np.ones(len(a), dtype=bool), np.zeros(len(a), np.int64)
    for k in range(cap):
        same &= ids[np.minimum(a + k, last)] == ids[np.minimum(b + k, last)]
        out += same
    return out


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ARROW)


def _blocks(limit: int, bits: int):
    """Blocks of texts, their words by range, and the number of words of each language."""

    def flushed(parts: dict[str, list], number: int) -> pa.Table:
        block = (TaskContext.get().partitionId() << 32) + number
        ids, skip, cut, totals = encoded(parts, bits)
        none = np.zeros(0, np.int64)
        rows = [Block(ids, none, none, none, skip).row(block)]
        rows += [{"kind": PART, "block": block, "bucket": r, "tokens": packed(words), "counts": planes(count), "n": len(count)} for r, words, count in cut]
        return _table(rows + [{"kind": TOTAL, "text": lang.encode("utf-8", "surrogatepass"), "n": n} for lang, n in totals.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, number = {}, 0, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                for part in parts_of(text.as_buffer().to_pybytes().translate(_LOWER), limit):
                    parts.setdefault(lang.as_py(), []).append(part)
                    size += len(part[0]) + 1
                    if size >= limit:
                        yield from flushed(parts, number).to_batches(ROWS)
                        parts, size, number = {}, 0, number + 1
        if parts:
            yield from flushed(parts, number).to_batches(ROWS)

    return run


def _numbered(total: np.ndarray, least: int, bucket: int, bits: int) -> np.ndarray:
    """Numbers, unlike in all ranges, of the entries of a range whose total reaches `least`; 0 for the others."""
    stay = total >= least
    out = np.zeros(len(total), np.int64)
    out[stay] = (np.arange(stay.sum(), dtype=np.int64) << bits | bucket) + 1
    return out


def _replies(rows: pa.Table, numbers: np.ndarray, sizes: list[int], bucket: int) -> list[dict]:
    """For each block of which anything stays the numbers of what it has sent, in its order."""
    cuts = np.cumsum([0, *sizes])
    parts = [(block, numbers[a:b]) for block, a, b in zip(rows.column("block").to_pylist(), cuts, cuts[1:], strict=False)]
    return [{"kind": REPLY, "block": block, "bucket": bucket, "numbers": planes(own)} for block, own in parts if own.any()]


def _often_words(least: int, bits: int):
    """The words of one range: their sums over all blocks, exactly, and numbers for those that stay."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        lists = [unpacked(x.as_py()).split(b"\n") for x in rows.column("tokens")]
        place: dict[bytes, int] = {}
        every = np.fromiter((place.setdefault(w, len(place)) for own in lists for w in own), np.int64)
        total = np.zeros(len(place), np.int64)
        np.add.at(total, every, np.concatenate([unplaned(x.as_py()) for x in rows.column("counts")]))
        number = _numbered(total, least, bucket, bits)
        out = [{"kind": STAYED, "number": int(number[i]), "text": w, "n": int(total[i])} for w, i in place.items() if number[i]]
        return _table(out + _replies(rows, number[every], [len(x) for x in lists], bucket))

    return run


def _often_pairs(least: int, bits: int):
    """The same for pairs of a part and a last word."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        column = lambda name: [unplaned(x.as_py()) for x in rows.column(name)]
        firsts = [np.cumsum(x) for x in column("firsts")]
        first, last, count = np.concatenate(firsts), np.concatenate(column("lasts")), np.concatenate(column("counts"))
        by = np.lexsort((last, first))
        new = (np.diff(first[by], prepend=-1) != 0) | (np.diff(last[by], prepend=-1) != 0)
        head = np.nonzero(new)[0]
        total = np.add.reduceat(count[by], head)
        number = _numbered(total, least, bucket, bits)
        spread = np.empty(len(by), np.int64)
        spread[by] = number[np.cumsum(new) - 1]
        stay = np.nonzero(number)[0]
        out = [{"kind": STAYED, "number": int(number[i]), "first": int(first[by[head[i]]]), "last": int(last[by[head[i]]]), "n": int(total[i])} for i in stay]
        return _table(out + _replies(rows, spread, [len(x) for x in firsts], bucket))

    return run


def _parts(block: int, found: Block, m: int, bits: int) -> list[dict]:
    bucket, first, last, count, *_ = found.pairs(m, bits)
    return [{"kind": PART, "block": block, "bucket": int(bucket[a]), "firsts": planes(np.diff(first[a:b], prepend=0)), "lasts": planes(last[a:b]), "counts": planes(count[a:b])} for a, b in runs(bucket)]


def _numbers(bucket: np.ndarray, back: pa.Table) -> np.ndarray:
    """The numbers that came back, for entries in the order of their ranges; 0 where a range sent none."""
    out = np.zeros(len(bucket), np.int64)
    for b, own in zip(back.column("bucket").to_pylist(), back.column("numbers"), strict=True):
        a = np.searchsorted(bucket, b)
        own = unplaned(own.as_py())
        out[a : a + len(own)] = own
    return out


def _level(m: int, longest: int, bits: int):
    """A block after what came back for its phrases of m words, and its phrases of m + 1 words by range."""

    def run(state: pa.Table, back: pa.Table) -> pa.Table:
        if not state.num_rows or not back.num_rows or m == longest:
            return _table([])
        row = state.to_pylist()[0]
        found, block = Block.read(row), row["block"]
        if m == 1:
            # The numbers of a word in the block follow the ranges, of which only those with words that stay came back.
            names = np.zeros(int(found.ids.max(initial=0)) + 1, np.int64)
            for start, own in zip(back.column("n").to_pylist(), back.column("numbers"), strict=True):
                own = unplaned(own.as_py())
                names[start : start + len(own)] = own
            grams = np.where(names[found.ids] > 0, found.ids, 0)
            narrow = Block(found.ids, names, grams, names, found.skip).narrowed(grams, names, 1)
            if narrow is not None:
                narrow.grams, narrow.gram_names = narrow.ids, narrow.names
        else:
            bucket, _, _, _, order, head, size = found.pairs(m, bits)
            number = _numbers(bucket, back)
            grams, kept = np.zeros(len(found.ids), np.int64), np.nonzero(number)[0]
            # All places of the phrases that stay.
            spot = np.repeat(head[kept] - np.concatenate([[0], np.cumsum(size[kept])[:-1]]), size[kept]) + np.arange(size[kept].sum()) if len(kept) else kept
            grams[order[spot]] = np.repeat(np.arange(1, len(kept) + 1), size[kept])
            narrow = found.narrowed(grams, np.append(0, number[kept]), m)
        return _table([] if narrow is None else [narrow.row(block), *_parts(block, narrow, m + 1, bits)])

    return run


def _parted(rows: DataFrame, path: str) -> None:
    """Write rows with a folder for each of their kinds, so that a kind can be deleted when it has been read for the last time."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)


def _of(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """The rows of one kind, none if there is no folder for it."""
    return spark.read.schema(_STEP).parquet(path).where(F.col("kind") == kind)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of up to `longest` words that stand in the texts `least` times or more, exactly, and
    (lang, n), the number of words of each language."""
    spark = docs.sparkSession
    folder = workdir(spark, "phrases")
    rows = docs.select(text_of("text").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    # A word takes a byte and a space at least.
    bits = max(0, math.ceil(math.log2(max(1, corpus_size(docs)[1] / 2 / RANGE))))
    _parted(rows.mapInArrow(_blocks(limit, bits), _STEP), f"{folder}/level0")
    totals = _of(spark, f"{folder}/level0", TOTAL).groupBy(F.col("text").cast("string").alias("lang")).agg(F.sum("n").alias("n"))
    totals = written(totals, f"{folder}/totals")
    phrases = []
    for m in range(1, longest + 1):
        last, asked = f"{folder}/level{m - 1}", f"{folder}/ranges{m}"
        parts = _of(spark, last, PART)
        sent = parts.select("block", "bucket", *(("tokens",) if m == 1 else ("firsts", "lasts")), "counts")
        _parted(sent.groupBy("bucket").applyInArrow((_often_words if m == 1 else _often_pairs)(least, bits), _STEP), asked)
        release(spark)
        stayed, back = _of(spark, asked, STAYED), _of(spark, asked, REPLY).select(F.col("block").alias("at"), "bucket", "numbers")
        if m == 1:
            # A block's words are numbered from range to range: where those of a range start.
            sizes = parts.select("block", "bucket", F.col("n").alias("k"))
            before = F.coalesce(F.sum("k").over(Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            starts = written(sizes.select(F.col("block").alias("at"), "bucket", (before + 1).alias("n")), f"{folder}/starts")
            back = back.join(starts, ["at", "bucket"])
            quoted = F.split(F.col("text").cast("string"), " ")
            words = stayed.select("number", F.url_decode(quoted[1]).alias("lang"), quoted[0].alias("phrase"), F.col("n").alias("f"))
            phrases.append(words)
        else:
            part = phrases[-1].select(F.col("number").alias("first"), "lang", F.col("phrase").alias("head"))
            word = phrases[0].select(F.col("number").alias("last"), F.col("phrase").alias("tail"))
            own = stayed.select("number", "first", "last", F.col("n").alias("f")).join(part, "first").join(word, "last")
            phrases.append(written(own.select("number", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), f"{folder}/phrases{m}"))
        # What has been summed is not read again, and the numbers only by the next level.
        discard(spark, f"{last}/kind={PART}")
        if m < longest:
            state = _of(spark, last, STATE).select("block", "ids", "names", "grams", "gram_names", "skip")
            _parted(state.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(_level(m, longest, bits), _STEP), f"{folder}/level{m}")
        discard(spark, last)
        discard(spark, f"{asked}/kind={REPLY}")
        release(spark)
    every = phrases[0].select("lang", "phrase", F.lit(1).alias("m"), "f")
    for m, more in enumerate(phrases[1:], 2):
        every = every.unionByName(more.select("lang", "phrase", F.lit(m).alias("m"), "f"))
    return written(every, f"{folder}/phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, limit: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases by score."""
    counts, totals = phrase_counts(docs, least, longest, limit)
    words = F.split("phrase", " ")
    candidates = counts.where("m >= 2").withColumnRenamed("f", "a")
    # Each cut has two parts, which are looked up in one join; a frequent word is a part of many candidates.
    cut = candidates.select("lang", "phrase", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    left, right = F.array_join(F.slice(words, 1, F.col("k")), " "), F.array_join(F.slice(words, F.col("k") + 1, F.col("m") - F.col("k")), " ")
    sides = cut.select("lang", "phrase", "a", "k", F.posexplode(F.array(left, right)).alias("side", "part"))
    sizes = sides.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    known = lookup(sides, counts.select(F.col("phrase").alias("part"), "lang", "f"), ["part", "lang"], sizes, counts.count() * 2 * (longest - 1), ["phrase"])
    pairs = known.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    per_lang = candidates.groupBy("lang").agg(F.count(F.lit(1)).alias("m"))
    pairs = lookup(pairs, totals, ["lang"], per_lang, counts.count(), ["phrase"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    pairs = pairs.withColumn("top", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(SCALE).cast("decimal(4,0)")).withColumn("below", wide("l") * wide("r"))
    best = pairs.withColumn("score", F.expr("top div below")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # A longer phrase that counts as often holds one that is longer by one word and does so too.
    longer = counts.where("m >= 3").select("lang", "f", F.explode(F.array(F.array_join(F.slice(words, 1, F.col("m") - 1), " "), F.array_join(F.slice(words, 2, F.col("m") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left_over = best.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < a")
    ranked = left_over.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's first rows are among the first rows of each of its parts, so that no task gets a whole language.
    slices = F.pmod(F.xxhash64("phrase"), F.lit(parallelism(docs.sparkSession)))
    near = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", slices).orderBy(*order))).where(F.col("rank") <= first).drop("rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
      SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    )
  ) WHERE len(words) > 0
), t AS (SELECT lang, sum(len(words)) AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, m, list_slice(words, i, i + m - 1) AS ws FROM (
    SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM p, range(1, 6) AS r(m) WHERE len(words) >= m
  )
), f AS MATERIALIZED (SELECT lang, m, ws, count(*) AS f FROM g GROUP BY lang, m, ws HAVING count(*) >= 100
), c AS (
  SELECT x.lang, x.ws, x.m, x.f AS a, k, y.f AS l, z.f AS r, CAST((CAST(1000 AS HUGEINT) * x.f * t.n) // (CAST(y.f AS HUGEINT) * z.f) AS BIGINT) AS score, t.n
  FROM f AS x, range(1, 5) AS q(k), f AS y, f AS z, t
  WHERE x.m >= 2 AND k < x.m AND y.lang = x.lang AND z.lang = x.lang AND t.lang = x.lang AND y.ws = x.ws[1:k] AND z.ws = x.ws[k + 1:]
), b AS (SELECT lang, ws, m, a, n, min({'score': score, 'k': k, 'l': l, 'r': r}) AS b FROM c GROUP BY lang, ws, m, a, n
), o AS (
  SELECT lang, array_to_string(ws, ' ') AS phrase, a, b.l AS l, b.r AS r, CAST(n AS BIGINT) AS n, b.score AS score FROM b
  WHERE NOT EXISTS (SELECT 1 FROM f, range(1, 6) AS s(i) WHERE f.lang = b.lang AND f.m > b.m AND i + b.m - 1 <= f.m AND f.ws[i:i + b.m - 1] = b.ws AND 100 * f.f >= 100 * b.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000"""
