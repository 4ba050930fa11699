"""Jaccard self-join on word n-grams by vertical partitioning, and its connected components.

1. Every document's distinct shingles are hashed. Packed by hash range, they are counted over all documents, and the ones
   that occur in two documents or more travel back, packed, to their documents with the band of their frequency.
2. The global order of shingles is by (band, hash), the unique ones first. A document whose unique shingles exceed the
   difference allowed at the threshold is linked with nothing. The others list their prefixes in that order.
3. Documents with equal sets are one class. Within each prefix list the classes meet their most typical member first; pairs
   that pass the size, uniqueness and position bounds are verified and joined into components. Lists that then still hold
   several components offer the pairs between those components, so that no link between components is lost. A list, class or
   component that holds many rows is dealt to several tasks in each join.
4. Verification is vertical: the global order is cut into fragments, overlaps are counted in each fragment by itself, and
   the counts are summed per pair.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with nothing, not even with
each other; fewer words than the size of a shingle make one shingle; repeated rows are linked if they hold words; a null
doc_id never names a component that has other ids. Whole texts of any length count; of equal ids or sets the order does not
matter, since a component is named by its least id; an empty table gives an empty result. Ids are whole numbers: an id that is no
number is an error of the cast. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import corpus_size, heavy_keys, lookup, release, table, workdir, written
from .components import connected_components
from .shingles import batch_shingles, mix, runs

SIZE, PERCENT = 5, 80
#: Shingles per packed block and, about, per range of hashes.
BLOCK, RANGE = 800_000, 800_000
FRAGMENTS = 8
_BLOB = "block string, bucket int, kind int, docs int, ids binary, counts binary, hashes binary"


def _range_bits(size: int) -> int:
    """So many leading bits of the hash that a range holds about RANGE shingles (one per six bytes of text)."""
    return min(24, max(3, math.ceil(math.log2(max(1, size / 6 / RANGE)))))


def _pack(size: int, bits: int):
    """Blocks of documents as packed shingles by hash range (kind 0), and one row for the documents themselves (kind 1)."""
    import os

    def out(ids: list, sets: list[np.ndarray], name: str) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], dtype=np.uint32)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint32), n)
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, hashes, doc = bucket[order], hashes[order], doc[order]
        rows = []
        for a, b in runs(bucket):
            rows.append((name, int(bucket[a]), 0, len(sets), None, _counts_out(np.bincount(doc[a:b], minlength=len(sets))), _short(hashes[a:b])))
        digest = np.zeros((len(sets), 2), dtype=np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                digest[i] = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        where = int(np.frombuffer(name.encode(), np.uint8).astype(np.int64).sum() * 2654435761 % (1 << bits))
        rows.append((name, where, 1, len(sets), _ids_out(ids), n.tobytes(), digest.tobytes()))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[p.split()[0] for p in _BLOB.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, sets, total = [], [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc, found in zip(batch.column("doc_id").to_pylist(), batch_shingles([t or b"" for t in texts], size), strict=True):
                ids.append(doc), sets.append(found)
                total += len(found) + 1
                if total >= BLOCK:
                    yield out(ids, sets, f"{part}-{number}")
                    ids, sets, total, number = [], [], 0, number + 1
        if ids:
            yield out(ids, sets, f"{part}-{number}")

    return run


def _counts_out(counts: np.ndarray) -> bytes:
    """Counts by document, in one byte each if they fit."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def _counts_in(data: bytes, docs: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == docs else np.uint32).astype(np.int64)


def _short(hashes: np.ndarray) -> bytes:
    """The lower six bytes of each hash; with the range they come to 51 bits or more."""
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes, bucket: int, bits: int) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | (np.uint64(bucket) << np.uint64(64 - bits))


def _ids_out(ids: list) -> bytes:
    null = np.array([i is None for i in ids], dtype=np.uint8)
    return np.array([i or 0 for i in ids], dtype=np.int64).tobytes() + null.tobytes()


def _ids_in(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data[: 8 * n], np.int64), np.frombuffer(data[8 * n :], np.uint8).astype(bool)


def _count(bits: int):
    """In one hash range: keep the shingles of two documents or more, with the band of their document frequency."""

    def run(group: pa.Table) -> pa.Table:
        blobs = group.to_pylist()
        plain = [r for r in blobs if r["kind"] == 0]
        rows = [(r["block"], 1, r["docs"], r["ids"], r["counts"], r["hashes"], None) for r in blobs if r["kind"] == 1]
        if plain:
            hashes = np.concatenate([_long(r["hashes"], r["bucket"], bits) for r in plain])
            order = np.argsort(hashes)
            ranked = hashes[order]
            first = np.nonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))[0]
            times = np.diff(np.append(first, len(ranked)))
            band = np.empty(len(hashes), dtype=np.uint8)
            band[order] = np.repeat(np.log2(times).astype(np.uint8), times)
            at = 0
            for r in plain:
                counts = _counts_in(r["counts"], r["docs"])
                k = int(counts.sum())
                own = band[at : at + k]
                keep = own > 0
                if keep.any():
                    doc = np.repeat(np.arange(r["docs"]), counts)[keep]
                    rows.append((r["block"], 0, r["docs"], None, _counts_out(np.bincount(doc, minlength=r["docs"])), hashes[at : at + k][keep].tobytes(), own[keep].tobytes()))
                at += k
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = ["block", "kind", "docs", "ids", "counts", "hashes", "bands"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=names)

    return run


def allowed(n: int, percent: int) -> int:
    """How many of n shingles a partner may lack."""
    return n - -(-percent * n // 100)


def _gather(percent: int):
    """Per block: each document with its class and, if it can have links, its shared shingles in the global order."""

    def run(group: pa.Table) -> pa.Table:
        blobs = group.to_pylist()
        head = next(r for r in blobs if r["kind"] == 1)
        n_docs = head["docs"]
        ids, null = _ids_in(head["ids"], n_docs)
        n = np.frombuffer(head["counts"], np.uint32)
        digest = np.frombuffer(head["hashes"], np.uint64).reshape(n_docs, 2)
        plain = [r for r in blobs if r["kind"] == 0]
        if plain:
            doc = np.concatenate([np.repeat(np.arange(n_docs), _counts_in(r["counts"], n_docs)) for r in plain])
            hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in plain])
            bands = np.concatenate([np.frombuffer(r["bands"], np.uint8) for r in plain])
        else:
            doc, hashes, bands = np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        shared = np.bincount(doc, minlength=n_docs)
        able = (n > 0) & (n - shared <= [allowed(int(k), percent) for k in n])
        keep = able[doc]
        doc, hashes, bands = doc[keep], hashes[keep], bands[keep]
        order = np.lexsort((hashes, bands, doc))
        doc, hashes, bands = doc[order], hashes[order], bands[order]
        ends = np.searchsorted(doc, np.arange(n_docs + 1))
        cls = [f"{int(a):016x}{int(b):016x}" if ok else None for (a, b), ok in zip(digest, able, strict=True)]
        arrays = [
            pa.array(ids, pa.int64(), mask=null),
            pa.array(n.astype(np.int64)),
            pa.array(cls, pa.string()),
            pa.array([hashes[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], able, strict=True)], pa.binary()),
            pa.array([bands[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], able, strict=True)], pa.binary()),
        ]
        return pa.Table.from_arrays(arrays, names=["doc_id", "n", "cls", "hashes", "bands"])

    return run


def _fragment(hashes: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The fragment of the global order, from 0 to FRAGMENTS - 1: bands 1 to 3 in two halves by hash, then 4 to 7, then the rest."""
    half = (hashes >> np.uint64(63)).astype(np.int64)
    b = bands.astype(np.int64)
    return np.where(b <= 3, (b - 1) * 2 + half, np.where(b <= 7, 6, 7))


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, cls, size, unique, pos = [], [], [], [], []
            for c, n, raw in zip(*[batch.column(k).to_pylist() for k in ("cls", "n", "hashes")], strict=True):
                hashes = np.frombuffer(raw, np.int64)
                u = n - len(hashes)
                k = allowed(n, percent) + 1 - u
                key.append(hashes[:k])
                m = len(key[-1])
                cls += [c] * m
                size.append(np.full(m, n)), unique.append(np.full(m, u)), pos.append(np.arange(u, u + m))
            cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(key), pa.int64()), pa.array(cls, pa.string()), *[pa.array(cat(v), pa.int64()) for v in (size, unique, pos)]], names=["key", "cls", "n", "u", "pos"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's shared shingles by fragment."""
    for batch in batches:
        cls, frag, own = [], [], []
        for c, raw, band in zip(*[batch.column(k).to_pylist() for k in ("cls", "hashes", "bands")], strict=True):
            hashes, bands = np.frombuffer(raw, np.uint64), np.frombuffer(band, np.uint8)
            where = _fragment(hashes, bands)
            for f in np.unique(where):
                cls.append(c), frag.append(int(f)), own.append(hashes[where == f].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.string()), pa.array(frag, pa.int32()), pa.array(own, pa.list_(pa.int64()))], names=["cls", "frag", "shingles"])


def _possible(a: str, b: str, percent: int) -> Column:
    """Bounds on the overlap of two list entries: sizes, what neither can share, and what is left after their positions."""
    c = lambda side, k: F.col(f"{side}{k}")
    sizes = 100 * F.least(c(a, "n"), c(b, "n")) >= percent * F.greatest(c(a, "n"), c(b, "n"))
    most = F.least(c(a, "n") - F.greatest(c(a, "pos"), c(a, "u")), c(b, "n") - F.greatest(c(b, "pos"), c(b, "u")))
    return sizes & ((100 + percent) * most >= percent * (c(a, "n") + c(b, "n")))


def _verified(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed fragment overlaps reach the threshold."""
    left = fragments.select(F.col("cls").alias("a"), "frag", F.col("shingles").alias("left"))
    right = fragments.select(F.col("cls").alias("b"), "frag", F.col("shingles").alias("right"))
    total, pairs = pairs.count(), pairs.select("a", "b", "na", "nb")
    times = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("m"))
    part = lookup(pairs, left, ["a"], times("a"), total, ["b"])
    part = lookup(part, right, ["b", "frag"], times("b"), total, ["a", "frag"])
    overlap = part.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("left", "right"))).alias("same"))
    return overlap.where(F.lit(100 + percent) * F.col("same") >= F.lit(percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _tiled(x: DataFrame, lists: DataFrame, lengths: DataFrame, total: int, percent: int) -> DataFrame:
    """All meetings of two entries of a list whose sizes allow a link. A heavy list is cut by size, since partners have nearly the
    same, and each side into parts: part i of one side meets part j of the other in a task of its own."""
    y = lists.select("key", *[F.col(c).alias(f"b{c}") for c in ("cls", "n", "u", "pos", "comp")])
    heavy = heavy_keys(lengths, "key", total)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    every = F.sequence(F.lit(0), parts - 1)
    own = lambda c: F.pmod(F.xxhash64(c), parts).cast("int")
    # A little more than the largest ratio of sizes, so that rounding cannot put partners two steps apart.
    step = lambda c: F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.floor(F.log(F.col(c)) / math.log(100.1 / percent)).cast("int"))
    sides = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    x = x.join(heavy, x["key"] == F.col("_key"), "left").select(*x.columns, step("an").alias("_step"), own("acls").alias("_i"), F.explode(every).alias("_j"))
    y = y.join(heavy, y["key"] == F.col("_key"), "left").select(*y.columns, step("bn").alias("_at"), own("bcls").alias("_j"), F.explode(every).alias("_i"), sides.alias("_sides"))
    y = y.select("*", F.explode("_sides").alias("_side")).withColumn("_step", F.col("_at") + F.col("_side")).drop("_sides", "_side", "_at")
    return x.join(y, ["key", "_step", "_i", "_j"]).drop("_step", "_i", "_j")


def ngram_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, rounds: int = 1, crowd: float = 20.0) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    rounds: how often lists with several components meet one more member before all pairs between components are offered;
    that happens as soon as those pairs are at most `crowd` times the list entries.
    """
    spark = docs.sparkSession
    out = workdir(spark, "ngram-join")
    _, total = corpus_size(docs)
    bits = _range_bits(total)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(size, bits), _BLOB)
    counted = packed.groupBy("bucket").applyInArrow(_count(bits), "block string, kind int, docs int, ids binary, counts binary, hashes binary, bands binary")
    gathered = written(counted.groupBy("block").applyInArrow(_gather(percent), "doc_id bigint, n bigint, cls string, hashes binary, bands binary"), f"{out}/documents")
    release(spark)
    able = gathered.where("cls is not null")
    rows = able.count()
    sets = written(able.groupBy("cls").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("m")), f"{out}/sets")
    copies = sets.select("cls", "m")
    # What a class has in the lists: its shared shingles, less those that a partner must share.
    spread = sets.select("cls", F.expr(f"octet_length(hashes) div 8 - ({percent} * n + 99) div 100 + 1").alias("m"))
    fragments = written(sets.select("cls", "hashes", "bands").mapInArrow(_cut, "cls string, frag int, shingles array<bigint>"), f"{out}/fragments")
    entries = sets.select("cls", "n", "hashes").mapInArrow(_prefixes(percent), "key bigint, cls string, n bigint, u bigint, pos bigint")
    entries = written(entries, f"{out}/entries")
    # The smaller of two partners shares at least percent / (100 + percent) of both sizes, so what an entry can share bounds
    # its partner's size: entries that no other size in their list can match are left out.
    total = entries.count()
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1")
    shared = written(shared, f"{out}/shared")
    lengths = shared.select("key", "m")
    room = F.lit(100 + percent) * (F.col("n") - F.greatest("pos", "u")) >= F.lit(percent) * (F.col("n") + F.col("least"))
    lists = lookup(entries, shared.select("key", "least"), ["key"], lengths, total, ["cls"])
    lists = written(lists.where(room).select("key", "cls", "n", "u", "pos"), f"{out}/lists")
    links = spark.createDataFrame([], "a string, b string")
    tested = spark.createDataFrame([], "a string, b string")
    roots = spark.createDataFrame([], "node string, root string")
    for k in range(rounds + 1):
        # The lists that hold more than one component, and how many pairs lie between those components.
        now = lookup(lists, roots.select(F.col("node").alias("cls"), "root"), ["cls"], spread, total, ["key"], "left").select(*lists.columns, F.coalesce("root", "cls").alias("comp"))
        by = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"), F.count(F.lit(1)).alias("comps"))
        still = written(by.where("comps > 1"), f"{out}/open{k}")
        left = still.agg(F.sum("m").alias("m"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2).alias("pairs")).first()
        if not left["m"]:
            break
        lists = written(lookup(now, still.select("key"), ["key"], lengths, total, ["cls"]).select("key", "cls", "n", "u", "pos", "comp"), f"{out}/lists{k}")
        last = k > 0 and (k == rounds or left["pairs"] <= crowd * left["m"])
        x = lists.select("key", *[F.col(c).alias(f"a{c}") for c in ("cls", "n", "u", "pos", "comp")])
        if last:
            met = _tiled(x, lists, lengths, total, percent)
        else:
            # The first round's member is the one with the fewest unique shingles; later ones are drawn anew.
            rank = F.col("u") if k == 0 else F.xxhash64("cls", F.lit(k))
            hub = lists.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "cls", "n", "u", "pos", "comp")).alias("hub"))
            met = lookup(x, hub.select("key", *[F.col(f"hub.{c}").alias(f"b{c}") for c in ("cls", "n", "u", "pos", "comp")]), ["key"], lengths, total, ["acls"])
        near = (F.col("acomp") != F.col("bcomp")) & _possible("a", "b", percent)
        if last:
            near = near & (F.col("acls") < F.col("bcls"))
        pairs = met.where(near)
        swap = F.col("acls") < F.col("bcls")
        pairs = pairs.select(F.when(swap, F.col("acls")).otherwise(F.col("bcls")).alias("a"), F.when(swap, F.col("bcls")).otherwise(F.col("acls")).alias("b"), F.when(swap, F.col("an")).otherwise(F.col("bn")).alias("na"), F.when(swap, F.col("bn")).otherwise(F.col("an")).alias("nb")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti") if k else pairs, f"{out}/pairs{k}")
        found = written(_verified(pairs, fragments, percent), f"{out}/links{k}")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = connected_components(links, f"{out}/components{k}")
        tested = tested.unionByName(pairs.select("a", "b"))
        lists = lists.drop("comp")
        if last:
            break
    members = lookup(able.select("doc_id", "n", "cls"), roots.select(F.col("node").alias("cls"), "root"), ["cls"], copies, rows, ["doc_id"], "left")
    members = written(members.select("doc_id", "n", F.coalesce("root", "cls").alias("comp")), f"{out}/members")
    least = members.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    linked = lookup(members, least.select("comp", "component_id"), ["comp"], least.select("comp", "m"), rows, ["doc_id"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = gathered.where("cls is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * same >= 80 * (p.n + q.n - same)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
