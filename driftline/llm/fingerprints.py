"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies within a band of shares, which is inverse document frequency
within a band; since a document has a bounded mean number of terms, the lower share bounds the lexicon's size whatever the
number of documents. Several random subsets of the lexicon are drawn at each of several densities; a document's distinct
terms (words, by their hashes) in a subset are sorted and hashed. The fingerprint lists the hashes. Two fingerprints are compared at the density
that tells most: the share of equal hashes among the subsets that are not empty in both.

Defined results: null counts as empty; a text without terms in the lexicon has a digest of itself as its fingerprint and is
like equal texts only; the next document is by descending doc_id, then by a hash of the text, null ids come last, and
the last one is followed by the first; with a single document the next one is itself; repeated rows are neighbours of
each other; texts of any length are read whole; an empty table gives an empty result. Ids may be of any type that can be sorted. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import corpus_size, parallelism, release, table, text_of, workdir, written
from .shingles import NOT_LETTERS, batch_shingles, runs

#: Shares of all documents a term of the lexicon is in.
BAND = (0.001, 0.15)
#: One over the density of the lexicon subsets, and subsets at each.
DENSITIES, SUBSETS = (2, 8, 32, 128, 512, 2048), 16
#: Distinct terms that a task counts before it hands them on, and terms per hash range.
FLUSH, RANGE = 1_000_000, 500_000
#: Bytes of text in a range of the documents' order, about.
RANGE_BYTES = 64 << 20
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
EDGES = ["bucket", "edge", "text"]


def terms(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its words: runs without ASCII signs and digits, with A-Z as a-z."""
    return batch_shingles([t.encode("utf-8", "surrogatepass") for t in texts], 1, NOT_LETTERS)


def _frequencies(bits: int):
    """Terms of the task and the number of texts they are in, packed by hash range."""

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        term, n = np.unique(np.concatenate(found), return_counts=True)
        bucket = (term >> np.uint64(64 - bits)).astype(np.int64)
        small = n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32)
        rows = [(int(bucket[a]), small.itemsize, term[a:b].tobytes(), small[a:b].tobytes()) for a, b in runs(bucket)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "width", "terms", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for own in terms([t or "" for t in batch.column(0).to_pylist()]):
                found.append(own)
                held += len(own)
                if held > 8 * FLUSH:
                    yield out(found)
                    found, held = [], 0
        if found:
            yield out(found)

    return run


def _in_band(low: float, high: float):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        term = np.concatenate([np.frombuffer(r["terms"], np.uint64) for r in rows])
        n = np.concatenate([np.frombuffer(r["counts"], np.uint8 if r["width"] == 1 else np.uint32).astype(np.int64) for r in rows])
        by = np.argsort(term)
        term, n = term[by], n[by]
        first = np.nonzero(np.concatenate([[True], term[1:] != term[:-1]]))[0]
        df = np.add.reduceat(n, first)
        return pa.table({"term": pa.array(term[first][(df >= low) & (df <= high)].view(np.int64))})

    return run


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, total: tuple[int, int] | None = None) -> np.ndarray:
    """The sorted hashes of the terms whose document frequency is within the band; at most mean terms per document / band[0]."""
    n, size = total or corpus_size(docs)
    if not n:
        return np.zeros(0, np.uint64)
    bits = min(24, max(3, math.ceil(math.log2(max(1, size / 40 / RANGE)))))
    counts = docs.select(text_of().alias("text")).mapInArrow(_frequencies(bits), "bucket int, width int, terms binary, counts binary")
    found = counts.groupBy("bucket").applyInArrow(_in_band(max(2.0, band[0] * n), max(2.0, band[1] * n)), "term bigint").toPandas()
    return np.sort(found["term"].to_numpy(np.int64).view(np.uint64))


class Fingerprints:
    """Fingerprints under one lexicon."""

    def __init__(self, words: np.ndarray, seed: int = 0):
        self.words, self.seed, self._ready = words, seed, None

    def __reduce__(self):
        return Fingerprints, (self.words, self.seed)

    def _tables(self):
        if self._ready is None:
            draw = np.random.default_rng(self.seed)
            n = len(self.words)
            shares = np.repeat(1.0 / np.array(DENSITIES), SUBSETS)
            member = np.empty((n, len(shares)), dtype=bool)
            for k, share in enumerate(shares):
                member[:, k] = draw.random(n) < share
            self._ready = member
        return self._ready

    def of_all(self, texts: list[str]) -> list[tuple[str, np.ndarray | None]]:
        return [self._of(text, own) for text, own in zip(texts, terms(texts), strict=True)]

    def _of(self, text: str, own: np.ndarray) -> tuple[str, np.ndarray | None]:
        """The fingerprint as text, and its hashes (0: empty subset), from the text's sorted distinct terms."""
        member, keys = self._tables(), self.words
        ids = np.searchsorted(keys, own)
        ids = ids[(ids < len(keys)) & (keys[np.minimum(ids, len(keys) - 1)] == own)] if len(keys) else ids[:0]
        if not len(ids):
            return "-" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), None
        own = member[ids]
        hashes = np.zeros(own.shape[1], dtype=np.uint64)
        # In sorted order, each term's key is folded into the hash of every subset that holds it.
        row, col = np.nonzero(own)
        if len(row):
            rank = own.cumsum(axis=0, dtype=np.uint32)[row, col].astype(np.uint64)
            mixed = (keys[ids[row]] ^ (rank * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            order = np.argsort(col, kind="stable")
            starts = np.nonzero(np.diff(col[order], prepend=-1))[0]
            hashes[col[order][starts]] = np.add.reduceat(mixed[order], starts)
        short = ((hashes * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.uint16)
        short = np.where(own.any(axis=0), np.maximum(short, 1), 0).astype(">u2")
        return short.tobytes().hex(), short

    @staticmethod
    def likeness(a: tuple[str, np.ndarray | None], b: tuple[str, np.ndarray | None]) -> float:
        if a[0] == b[0]:
            return 1.0
        if a[1] is None or b[1] is None:
            return 0.0
        x, y = a[1].reshape(-1, SUBSETS), b[1].reshape(-1, SUBSETS)
        some = ((x != 0) | (y != 0)).sum(axis=1)
        same = ((x == y) & (x != 0)).sum(axis=1)
        # The sparsest densities say little, since few of their subsets hold anything.
        return float((same / np.maximum(some, SUBSETS // 2)).max())


def edited(text: str, following: str) -> str:
    """text, the last third of whose code points are replaced by as many of the following text, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


class Neighbours:
    """The pass over one range of the documents in their order: each row against the one after it.

    The first and the last row of a range (edge 1 and 2) go out with their texts, since what precedes and follows them is in another range.
    """

    def __init__(self, made: Fingerprints, kind: pa.DataType):
        self.made, self.kind = made, kind

    def result(self, pairs: list[tuple]) -> list[tuple]:
        """Results of (id, text, fingerprint, following text, its fingerprint)."""
        changed = [edited(text, following) for _, text, _, following, _ in pairs]
        out = []
        for (doc, text, own, _, after), cut, other in zip(pairs, changed, self.made.of_all(changed), strict=True):
            sha = hashlib.sha256(cut.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc, len(text), sha, own[0], other[0], self.made.likeness(own, other), self.made.likeness(own, after)))
        return out

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [self.kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()][: len(rows[0]) if rows else 10]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=(COLUMNS + EDGES)[: len(kinds)])

    def along(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, bucket = None, 0  # id, text and fingerprint of the row whose next one is still to come
        at_edge = lambda doc, text, edge: (doc, None, None, None, None, None, None, bucket, edge, text)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cut = batch.slice(at, 500)
                ids, texts = cut.column("doc_id").to_pylist(), cut.column("text").to_pylist()
                out, pairs = [], []
                if before is None:
                    bucket = cut.column("bucket")[0].as_py()
                    out.append(at_edge(ids[0], texts[0], 1))
                for doc, text, own in zip(ids, texts, self.made.of_all(texts), strict=True):
                    if before is not None:
                        pairs.append((*before, text, own))
                    before = (doc, text, own)
                yield self.batch(out + [(*r, bucket, 0, None) for r in self.result(pairs)])
        if before is not None:
            yield self.batch([at_edge(before[0], before[1], 2)])

    def across(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, following in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "following")], strict=True):
                own, after = self.made.of_all([text, following])
                yield self.batch(self.result([(doc, text, own, following, after)]))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, per_range: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    One range-sort along the order of the documents; a range is read once and as a stream. Rows alike in id and text may stand in
    any order, so a place in the input parts them, and no id or text has to fit into one range. The few rows on both sides of
    a border between ranges are matched afterwards.
    """
    spark = docs.sparkSession
    total = corpus_size(docs)
    made = Fingerprints(lexicon(docs, band, total))
    release(spark)
    n = max(parallelism(spark), -(-total[1] // per_range))
    text = text_of()
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").desc_nulls_last(), F.desc("key"), F.col("place")]
    ranges = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("bucket"))
    kind = rows.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    work = Neighbours(made, to_arrow_type(kind))
    found = written(ranges.mapInArrow(work.along, f"{schema}, bucket int, edge int, text string"), f"{workdir(spark, 'fingerprints')}/found")
    # As many numbers as there are ranges with rows; the last range is followed by the first.
    buckets = sorted(r["bucket"] for r in found.where("edge = 1").select("bucket").collect())
    after = spark.createDataFrame(list(zip(buckets, buckets[1:] + buckets[:1], strict=True)), "bucket int, to int")
    heads = found.where("edge = 1").select(F.col("bucket").alias("to"), F.col("text").alias("following"))
    ends = found.where("edge = 2").select("doc_id", "text", "bucket").join(after, "bucket").join(heads, "to").select("doc_id", "text", "following")
    return found.where("edge = 0").select(*COLUMNS).unionByName(ends.mapInArrow(work.across, schema))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
