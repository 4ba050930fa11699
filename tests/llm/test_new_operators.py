"""Phrases, archives and balls against brute force, with nulls, empties, ties, repeats, long texts and clashing columns."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import ball_kmeans, phrases, warc
from driftline.llm.common import workdir

# --- phrases


def plain_phrases(rows, least, longest=5, first=2000):
    """The rule of the contract, word by word."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = set()
    for lang, counts in f.items():
        found = []
        for ws, a in counts.items():
            if len(ws) < 2 or a < least:
                continue
            if any(len(v) > len(ws) and b >= a and any(v[i : i + len(ws)] == ws for i in range(len(v) - len(ws) + 1)) for v, b in counts.items() if b >= least):
                continue
            cuts = [(1000 * a * n[lang] // (counts[ws[:k]] * counts[ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(ws).encode(), counts[ws[:k]], counts[ws[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:first])}
    return out


def texts(seed, n):
    draw = random.Random(seed)
    words = ["A", "b", "c", "D", "é", "of", "x\x01y", "日本", "-"]
    fixed = ["a b c d of", "B c d", "of of of of", "x\x01y -"]
    out = [(None, "en"), ("", None), (" \t ", "en"), ("...\n!", "de"), ("one", "xx")]
    for _ in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.4 else " ".join(draw.choice(words) for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 5))]
        out.append((draw.choice([". ", ",", "\n", "  ", "\t", "\x0b", "!?"]).join(parts), draw.choice(["en", "en", "en", "de", None])))
    return out + out[5:9]


def phrase_rows(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize(("seed", "limit"), [(1, 12 << 20), (2, 400), (3, 61)])
def test_phrases_equal_the_plain_count(spark, seed, limit):
    """Also with blocks so small that texts are cut between words."""
    rows = texts(seed, 120)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1)).withColumn("key", F.lit(0))
    got = phrases.collocations(docs, least=12, limit=limit)
    assert phrase_rows(got) == plain_phrases(rows, 12) and got.count() == len(plain_phrases(rows, 12))


def test_phrases_first_rows_and_ties(spark):
    rows = [(" . ".join(f"{a} {b}" for a in "pqrs" for b in "tuvw"), "en")] * 6
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = phrase_rows(phrases.collocations(docs, least=3, first=5))
    assert got == plain_phrases(rows, 3, first=5) and [r[2] for r in sorted(got, key=lambda r: r[1])] == ["p t", "p u", "p v", "p w", "q t"]


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert phrases.collocations(docs.limit(0)).count() == 0 and phrases.collocations(docs).count() == 0
    assert "phrase" in phrases.collocations(docs.limit(0)).columns


def test_parts_of_long_texts_count_nothing_twice():
    text = ("aa bb cc dd ee ff " * 40 + "\n" + "w" * 300 + " zz\tyy ").encode()
    for limit in (30, 64, 1000):
        words = []
        for part, context in phrases.parts_of(text, limit):
            own = part.split()
            words += own[: len(own) - context]
        assert words == text.split()


def test_suffix_array_and_common_prefixes_are_plain():
    draw = np.random.default_rng(0)
    ids = np.append(draw.integers(0, 4, 300), [0] * 5)
    padded = [*ids.tolist(), 0, 0, 0, 0, 0]
    for depth in (1, 2, 3, 5):
        order = phrases.suffix_array(ids, depth)
        keys = [tuple(padded[i : i + depth]) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(305))
        same = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(keys[1:], keys)]
        got = phrases.common_prefixes(ids, order, depth)
        assert all(g == s for g, s, i, j in zip(got, same, order[1:], order) if max(i, j) + depth <= 305)


# --- archives


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return df.withColumn("record", F.lit("x")).withColumn("member", F.lit(1)).withColumn("p", F.lit(2)).withColumn("top", F.lit(3))


HTML = [None, "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n\r\n", "\x00\x1f", "x" * 5000, "<p>a</p>", "", "b" * 100_000]


def page_rows(n=40):
    draw = random.Random(3)
    return [(i * 31 % 997, draw.choice([None, f"http://h/{i}", "http://h/\r\nX: 1"]), draw.choice(HTML) if i % 3 else f"<b>{i}</b>") for i in range(n)]


def plain_warc(rows, least=0):
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= least and best[html or ""] != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", best[html or ""] if revisit else None))
    return sorted(out)


def through(spark, df, least=0):
    folder = workdir(spark, "test-warc")
    warc.write_archives(df, f"{folder}/raw")
    warc.deduplicated(spark, f"{folder}/raw", f"{folder}/out", least=least)
    got = warc.resolved(spark, f"{folder}/out").collect()
    return folder, [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got]


@pytest.mark.parametrize("least", [0, 9])
def test_archives_equal_the_plain_rule(spark, least):
    rows = page_rows()
    _, got = through(spark, pages(spark, rows), least)
    assert sorted(got) == plain_warc(rows, least)


def test_archive_files_hold_one_member_a_record(spark):
    """The files as any other reader sees them: gzip members, each with one record whose payload is the html."""
    rows = [(1, "http://h/1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None)]
    folder, _ = through(spark, pages(spark, rows))
    seen = {}
    for r in spark.read.format("binaryFile").load(f"{folder}/out").collect():
        data = bytes(r["content"])
        while data:
            unpack = zlib.decompressobj(31)
            record = unpack.decompress(data)
            assert unpack.eof and record.endswith(b"\r\n\r\n")
            data = unpack.unused_data
            fields, http, payload = warc.parsed(record)
            assert len(record) == record.index(b"\r\n\r\n") + 4 + int(fields["content-length"]) + 4
            seen[int(fields["x-page-id"])] = (fields["warc-type"], payload.decode(), fields.get("warc-refers-to"), fields["warc-record-id"], fields.get("warc-target-uri"))
    assert seen[2][:2] == ("response", "<p>é</p>") and seen[3][:2] == ("response", "")
    assert seen[1][:3] == ("revisit", "", seen[2][3]) and seen[1][4] == "http://h/1" and seen[2][4] is None


def test_members_never_hold_the_mark_of_another():
    for n in range(300):
        packed = warc.member(struct.pack("<I", n * 2654435761 % 2**32) * (n % 7 + 1))
        assert packed.startswith(warc.MAGIC) and warc.MAGIC not in packed[1:]


def test_members_that_are_cut_are_put_together():
    body = zlib.compressobj(0, zlib.DEFLATED, 31)
    packed = body.compress(b"ab" + warc.MAGIC + b"cd") + body.flush()
    plain = warc.member(b"next")
    data = packed + plain
    assert [r for _, r in warc.members(iter(data.split(warc.MAGIC)))] == [b"ab" + warc.MAGIC + b"cd", b"next"]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(iter(data[:-4].split(warc.MAGIC))))


def test_archives_in_many_splits(spark):
    rows = [(i, f"u{i}", hashlib.sha256(str(i % 50).encode()).hexdigest() * 9) for i in range(400)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    folder = workdir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), f"{folder}/raw")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        heads = warc.headers(spark, f"{folder}/raw")
        assert heads.rdd.getNumPartitions() > 4 and sorted(int(r["page_id"]) for r in heads.collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archives_repeats_nulls_revisits_of_old_and_nothing(spark):
    folder, got = through(spark, pages(spark, [(7, "u", "a"), (7, "u", "a"), (None, "u", "a"), (None, None, "z")]))
    assert sorted(got, key=repr) == sorted([(7, 1, warc_digest("a"), "response", None), (7, 1, warc_digest("a"), "revisit", 7), (None, 1, warc_digest("a"), "revisit", 7), (None, 1, warc_digest("z"), "response", None)], key=repr)
    # Deduplicated once more, revisits keep their originals.
    warc.deduplicated(spark, f"{folder}/out", f"{folder}/again")
    again = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.resolved(spark, f"{folder}/again").collect()]
    assert sorted(again, key=repr) == sorted(got, key=repr)
    assert through(spark, pages(spark, [(1, "u", "a")]).limit(0))[1] == []


def warc_digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_long_records_are_members_too(spark):
    """16 MiB and more: the highest byte of the length is no zero then."""
    long = "0123456789abcdef" * (17 << 16)
    folder, got = through(spark, spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "s")], "page_id bigint, url string, html string"))
    assert sorted(got) == plain_warc([(1, "u", long), (2, "u", long), (3, "u", "s")])


# --- balls


def plain_kmeans(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(e)) for e in v]) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    centroids = [x for _, x in first]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]
        if step < rounds:
            for j in range(len(centroids)):
                own = [x for (_, x), (_, c) in zip(kept, near) if c == j]
                if own:
                    centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    sums = Counter()
    for d, c in near:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), sha[c]) for (i, _), (d, c) in zip(kept, near)), key=repr)


def vectors(seed, n):
    draw = random.Random(seed)
    centres = [[draw.uniform(-2, 2) for _ in range(64)] for _ in range(6)]
    rows = [(i, [c + draw.gauss(0, 0.3) for c in draw.choice(centres)]) for i in range(n)]
    odd = [(n, None), (n + 1, [0.5] * 63), (n + 2, [None] + [0.0] * 63), (n + 3, [float("nan")] + [0.0] * 63), (n + 4, [float("inf")] * 64), (None, [0.25] * 64), (3, rows[3][1]), (3, rows[3][1]), (n + 5, []), (n + 6, [-0.001] * 64)]
    return rows + odd


def ball_rows(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "n", "kind"), [(1, 300, "double"), (2, 120, "float"), (3, 4, "double")])
def test_balls_equal_plain_kmeans(spark, seed, n, kind):
    rows = vectors(seed, n)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    df = df.withColumn("cluster", F.lit("x")).withColumn("x", F.lit(None).cast("int")).withColumn("distance", F.lit(0.0))
    if kind == "float":
        rows = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    assert ball_rows(ball_kmeans.clusters(df)) == plain_kmeans(rows)


def test_balls_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 4)] + [0.0] * 63) for i in range(40)]
    assert ball_rows(ball_kmeans.clusters(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))) == plain_kmeans(rows)


def test_balls_compare_relevant_neighbours_only():
    draw = np.random.default_rng(5)
    centroids = draw.integers(-100, 100, (12, 8))
    x = centroids[draw.integers(0, 12, 500)] + draw.integers(-3, 4, (500, 8))
    plain = ball_kmeans.Balls(centroids, None)
    before, d = plain.all_compared(x)
    radius = np.array([math.sqrt(d[before == c].max(initial=0)) for c in range(12)])
    balls = ball_kmeans.Balls(centroids, radius)
    assert sum(len(balls.neighbours(c)) for c in range(12)) < 12 * 11 / 2
    for start in (before, draw.integers(0, 12, 500).astype(np.int32)):
        wide = ball_kmeans.Balls(centroids, np.array([math.sqrt(((x[start == c] - centroids[c]) ** 2).sum(axis=1).max(initial=0)) for c in range(12)]))
        got = wide.assign(x, start)
        assert (got[0] == before).all() and (got[1] == d).all()


def test_balls_of_nothing_and_of_too_much(spark):
    df = spark.createDataFrame([(1, [1.0] * 64)], "vec_id bigint, embedding array<double>")
    assert ball_kmeans.clusters(df.limit(0)).count() == 0
    assert [r["cluster"] for r in ball_kmeans.clusters(df).collect()] == [0]
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.clusters(spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")).collect()
